"""From documents to packed sequences: five stages, each written as Parquet and read again before the next one.

Every stage takes null and empty texts, null ids, repeated rows and extra columns of any name, and passes all columns on but
for the last one; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import near_dup, packing, queries, resample, secret_scan, toxicity
from parley.session import cut_lineage


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but for the ids of ``rejected``; rows without an id stay."""
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; a null text scores as an empty one. With no term learnt all texts score alike,
    by the share of toxic labels, which says nothing of any of them: all stay."""
    machine = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    if not len(machine.terms):
        return docs
    return docs.where(toxicity.probability(F.col("text"), machine, spark) < 0.5)


def draw_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the draw by importance weight; rows without an id stay."""
    drawn = resample.draw(docs, queries.table(spark, sf_dir, "labels"))
    return without(docs, drawn.where(~F.col("kept")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class; of rows that repeat an id, the one whose text has the least hash. Rows without an
    id stay."""
    left = without(docs, near_dup.classes(docs).where(~F.col("kept")))
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return left
    rest = [c for c in left.columns if c != "doc_id"]
    first = F.min_by(F.struct(*rest), F.struct(F.xxhash64("text"), F.xxhash64(*rest)))
    once = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("_row")).select(
        "doc_id", "_row.*").select(*left.columns)
    return left.join(repeated, "doc_id", "left_anti").unionByName(once)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    clean = secret_scan.redacted(F.col("text"), queries.BYTE_BPE)
    count = F.when(clean.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(clean).cast("long"))
    return docs.withColumns({"text": clean, "n_chars": count})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece, as the packing query returns it; a null text is packed as an empty one."""
    return queries.packed_pieces(packing.pack(docs, queries.BYTE_BPE, end_id=1, capacity=2048))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_resample", draw_quality),
    ("near_dup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of what the stages leave of `documents`."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


#: SQL can't express the classifiers, the tokenizer and the packing.
ORACLE_SQL = None
