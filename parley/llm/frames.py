"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let Arrow batches end at ``most`` bytes as well as by rows, unless the job has set a smaller bound."""
    if int(spark.conf.get(BATCH_BYTES).rstrip("bB")) > most:
        spark.conf.set(BATCH_BYTES, str(most))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
                most: int = 4 << 20) -> DataFrame:
    """``fn`` on every Arrow batch; batches stay bounded whatever the length of the texts."""
    bounded_batches(df.sparkSession, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (made := fn(batch)) is not None:
                yield made

    return df.mapInArrow(run, schema)


def ids_and_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, so that the scan reads no more; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
