"""What the two vector searches share: which vectors take part, and the grid of query blocks by candidate blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component finite."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def blocks_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of one length as a matrix."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], type=column.type)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def best_per_query(found: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each query_id in ``order`` as rank 1 … k; Spark limits each task's groups first."""
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("int"))
    return ranked.where(F.col("rank") <= k)
