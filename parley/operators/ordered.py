"""Order-dependent aggregation that holds up when one conversation has a third of all rows.

There is one way for every size: texts are joined within stretches of positions, and a digest over a whole
conversation runs through its sorted rows in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators import KEY

ROWS_PER_PART = 10_000


def ordered_texts(order: Column, text: Column, where: Column | None = None) -> Column:
    """Texts of a group in ``order`` (collect_list alone has no order after a shuffle)."""
    row = F.struct(order.alias("o"), text.alias("t"))
    rows = F.array_sort(F.collect_list(row if where is None else F.when(where, row)))
    return F.transform(rows, lambda r: r["t"])


def running_sha256(chunks: DataFrame, separator: str = "") -> DataFrame:
    """(KEY, revision): SHA-256 of each key's chunks (KEY, ord, text) in order.

    The first chunk is a head; ``separator`` stands between the others. The digest is sequential by definition, so one
    task reads one key; it streams the sorted rows and keeps the digest state only.
    """
    between = separator.encode("utf-8")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, n = None, None, 0
        for batch in batches:
            done = []
            for platform, source_id, text in zip(batch["platform"], batch["source_id"], batch["text"]):
                if (platform, source_id) != current:
                    if current is not None:
                        done.append((*current, state.hexdigest()))
                    current, state, n = (platform, source_id), hashlib.sha256(), 0
                if n > 1:
                    state.update(between)
                state.update((text or "").encode("utf-8"))
                n += 1
            if done:
                yield pd.DataFrame(done, columns=[*KEY, "revision"])
        if current is not None:
            yield pd.DataFrame([(*current, state.hexdigest())], columns=[*KEY, "revision"])

    spread = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "ord").select(*KEY, "text")
    return spread.mapInPandas(digest, "platform string, source_id string, revision string")


def index_in_order(rows: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """Number rows 1, 2, … within ``keys`` by ``order`` without one window per key.

    ``bucket`` must not decrease along ``order``. Rows are numbered within (keys, bucket); the
    counts of earlier buckets, one small row each, give the offset.
    """
    rows = rows.withColumn("_bucket", bucket)
    near = W.partitionBy(*keys, "_bucket").orderBy(*order)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (rows.withColumn("_at", F.row_number().over(near))
            .join(offsets, [*keys, "_bucket"])
            .withColumn(name, F.col("_before") + F.col("_at"))
            .drop("_bucket", "_before", "_at"))
