"""Table jobs: DataFrames in, DataFrames out. `KEY` is the identity of a conversation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["platform", "source_id"]


def settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a costly column that later filters read.

    A filter on a plain projection is pushed below it, and the expression runs twice: in the filter
    and in the projection. Filters stop at a generator, so this one runs once.
    """
    return rows.withColumn(name, F.explode(F.array(value)))
