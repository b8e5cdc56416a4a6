"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k draw.

Both models are bags of hashed n-grams (bare words and pairs of neighbours in `BUCKETS` buckets). The target model is
counted on texts known to be good, the raw model on all texts. A text's importance weight is the mean over its n-grams
of the logarithm of the two models' ratio, times `SHARPNESS`: a mean, so that a long text is not drawn or left for its
length. Each text's key is its weight plus a Gumbel number made from its id, and the k greatest keys are the draw
without replacement by those weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import words
from parley.llm.frames import bounded_batches, ids_and_texts, map_batches
from parley.session import cut_lineage

BUCKETS = 1 << 16
#: Labelled rows read, about (by a hash of the id); four fifths of the good ones are the target, the rest set the cut.
SAMPLE_ROWS = 20_000
#: N-grams added to a text's number before the mean is taken, so that a short text is not judged by a few of them.
PRIOR = 20
#: Weights are multiplied by this before the draw: the greater, the fewer texts near the cut change sides.
SHARPNESS = 400.0
#: What a good text left out costs in bad texts let in, where the size of the draw is set.
GOOD_COST = 20
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def ngram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every word (with its marks) and of every pair of neighbouring words, in no order."""
    docs, buckets = [], []
    for owner, (hashes,) in words.term_hashes(texts, bare=False):
        pair = owner[:-1] == owner[1:]
        both = words.mixed(hashes[:-1] * np.uint64(3) + hashes[1:])[pair]
        docs += [owner, owner[:-1][pair]]
        buckets += [hashes >> _SHIFT, both >> _SHIFT]
    if not docs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


def fit(docs: DataFrame, labelled: DataFrame) -> np.ndarray:
    """The logarithm of target over raw probability of every bucket (one added to every count).

    ``labelled`` (doc_id, target boolean) is a bounded sample; the raw model counts every text. A task's counts leave it
    once, so what moves is at most `BUCKETS` rows a task, and the same number comes to the driver.
    """
    rows = ids_and_texts(docs).join(F.broadcast(labelled.where("target").select("doc_id", "target")), "doc_id", "left")
    bounded_batches(docs.sparkSession)

    def count(batches):
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            owner, bucket = ngram_buckets(batch.column("text"))
            good = np.asarray(batch.column("target").fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[owner]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])],
                                         ["bucket", "raw", "target"])

    counts = (rows.select("text", "target").mapInArrow(count, "bucket long, raw long, target long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow())
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    at = counts.column("bucket").to_numpy()
    raw[at] += counts.column("raw").to_numpy()
    target[at] += counts.column("target").to_numpy()
    if target.sum() == BUCKETS:  # nothing is known to be good: no text weighs more than another
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, weight) of every row: the mean log ratio of its n-grams; 0 for a text without words."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, bucket = ngram_buckets(batch.column("text"))
        n = batch.num_rows
        total = np.bincount(owner, weights=held.value[bucket], minlength=n)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total / (np.bincount(owner, minlength=n) + PRIOR))], ["doc_id", "weight"])

    return map_batches(ids_and_texts(docs), run, "doc_id long, weight double")


def labelled_sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, quality, target): about ``rows`` labelled ids; ``target`` marks the good ones the model is counted on."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) < F.lit(rows / total * (1 << 40)))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(5))
    return known.withColumn("target", (F.col("quality") == 1) & (fold != 0)).withColumn("fold", fold)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight from which texts are taken at the least cost; minus infinity with no bad text to tell apart."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad]))
    cost = GOOD_COST * np.searchsorted(good, cuts, "left") + len(bad) - np.searchsorted(bad, cuts, "left")
    k = len(cost) - 1 - int(cost[::-1].argmin()) if cost.min() < cost[0] else 0
    lower = bad[bad < cuts[k]]
    # Half way down to the next bad text, for texts a little unlike the labelled ones.
    return float((cuts[k] + lower[-1]) / 2) if len(lower) else float(cuts[k])


def gumbel(doc_id: Column, seed: int = 1) -> Column:
    """A standard Gumbel number from a hash of the id, the same in every run."""
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_greatest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th greatest value of a double column, exactly: its range is cut in 4096 until one value is left.

    Every round counts the cells of one range; 4096 rows come to the driver.
    """
    lo, hi, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return None
    k = min(max(k, 1), n)
    while lo < hi:
        cell = F.floor((F.col(key) - F.lit(lo)) / F.lit((hi - lo) / 4096))
        cells = sorted(rows.where(F.col(key).between(F.lit(lo), F.lit(hi))).groupBy(cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect(), key=lambda r: -r["lo"])
        for r in cells:
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def draw(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, weight, sort_key, kept) for every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality. The draw's size k is the number of texts at or above the weight that parts the
    labelled texts not counted in the model best; the k greatest keys are kept, with all that tie with the last. With
    no good or no bad label everything is kept. A null or empty text weighs 0. Repeated rows give repeated rows; other
    columns are ignored; an empty table gives an empty one.
    """
    sample = cut_lineage(labelled_sample(labels))
    ratio = fit(docs, sample)
    weights = cut_lineage(weigh(docs, ratio).withColumn("sort_key", F.col("weight") * SHARPNESS + gumbel(F.col("doc_id"))))
    held = weights.join(F.broadcast(sample.where("not target and (fold = 0 or quality = 0)")), "doc_id")
    known = held.select("doc_id", "quality", "weight").distinct().toArrow()
    quality, weight = known.column("quality").to_numpy(), known.column("weight").to_numpy()
    cut = best_cut(weight[quality == 1], weight[quality == 0])
    size = weights.where(F.col("weight") >= F.lit(cut)).count()
    least = kth_greatest(weights, "sort_key", size) if size else float("inf")
    return weights.withColumn("kept", F.col("sort_key") >= F.lit(least if least is not None else 0.0))
