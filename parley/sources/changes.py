"""Tables that grow by changes: a micro-batch appends the rows it changed, a reader takes the last of each key.

A log is two plain parquet folders. `changes` holds one partition a batch (`n`), written by overwriting that partition, so
that a retried batch replaces itself; `base` holds one partition a compaction (`through`): the table as of that batch.
Compaction is a job apart and moves nothing under a reader's feet: until its partition is complete, readers merge the
earlier base with the changes after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley import schemas
from parley.operators import KEY


class ChangeLog:
    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str]):
        self.spark, self.root, self.schema, self.keys = spark, root.rstrip("/"), schema, keys
        self.columns = spark.createDataFrame([], schema).columns

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _exists(self, name: str) -> bool:
        path = self._path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _compacted(self) -> int | None:
        """The batch the newest complete base goes up to."""
        if not self._exists("base"):
            return None
        fs = self._path("base").getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(self._path("base"))]
        return max((int(n.removeprefix("through=")) for n in names if self._exists(f"base/{n}/_SUCCESS")), default=None)

    def append(self, rows: DataFrame, n: int) -> None:
        """The rows that batch ``n`` leaves behind, one a key; bytes written follow the batch."""
        rows.select(*self.columns).write.mode("overwrite").parquet(f"{self.root}/changes/n={n}")

    def changes(self, after: int | None = None) -> DataFrame:
        """All change rows with their batch `n`; ``after``: of later batches only."""
        if not self._exists("changes"):
            return self.spark.createDataFrame([], f"{self.schema}, n bigint")
        rows = self.spark.read.schema(f"{self.schema}, n bigint").option("basePath", f"{self.root}/changes").parquet(
            f"{self.root}/changes")
        return rows if after is None else rows.where(F.col("n") > after)

    def known(self, before: int | None = None) -> DataFrame:
        """The table: of each key the row of the last batch that has it; ``before``: as it was before that batch."""
        at = self._compacted()
        rows = self.changes(at)
        if before is not None:
            rows = rows.where(F.col("n") < before)
        if at is not None:
            base = self.spark.read.schema(self.schema).parquet(f"{self.root}/base/through={at}")
            rows = rows.unionByName(base.withColumn("n", F.lit(-1).cast("bigint")))
        return last_of(rows, self.keys, "n").select(*self.columns)

    def compact(self, through: int) -> None:
        """Write the table as of batch ``through`` as a base. Older bases and changes may be removed once unread."""
        self.known(through + 1).write.mode("overwrite").parquet(f"{self.root}/base/through={through}")


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row with the greatest ``order``; combined before the shuffle."""
    rest = [x for x in rows.columns if x not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def archive_logs(spark: SparkSession, root: str) -> dict[str, ChangeLog]:
    """The two archive tables."""
    return {"conversations": ChangeLog(spark, f"{root}/conversations", schemas.CONVERSATIONS, KEY),
            "revisions": ChangeLog(spark, f"{root}/revisions", schemas.REVISIONS, [*KEY, "revision"])}
