"""Chat formatting with cumulative-snapshot collapse.

A log that stores a conversation after every turn holds all its beginnings as well. Every turn gets a hash of its
position, role and text, and the running exclusive or of these names each prefix of a conversation. A conversation is
left out when its whole hash is a proper prefix of another one; of equal conversations the smallest id stays. Both are
joins on (length, hash), with prefixes made distinct first, so a beginning that very many conversations share is one row.
What remains is rendered turn by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.session import cut_lineage

#: Turns numbered or rendered together; a longer conversation comes in several parts.
TURNS = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, pos, role, text): distinct turns, numbered from 1 by turn (nulls first), role and text.

    Turns are numbered within stretches of `TURNS` turn numbers, and the counts of earlier stretches give the offset, so
    no task sorts a whole conversation.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    turns = turns.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    turns = turns.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(1 << 62))))
    near = W.partitionBy("conv", "stretch").orderBy(F.asc_nulls_first("turn"), "role", "text")
    counts = turns.groupBy("conv", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("conv").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("conv", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = turns.withColumn("at", F.row_number().over(near)).join(offsets, ["conv", "stretch"])
    return numbered.select("conv", "conv_id", (F.col("before") + F.col("at")).alias("pos"), "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, pos, h1, h2): the hash of the first ``pos`` turns, 128 bits, running over stretches as above."""
    rows = turns.withColumn("stretch", F.floor((F.col("pos") - 1) / TURNS))
    for lane in (1, 2):
        rows = rows.withColumn(f"t{lane}", F.xxhash64(F.lit(lane), "pos", "role", F.lit("\x1f"), "text"))
    rows = rows.select("conv", "conv_id", "pos", "stretch", "t1", "t2")
    whole = rows.groupBy("conv", "stretch").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    before = W.partitionBy("conv").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    start = whole.select("conv", "stretch", *(F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)).alias(f"b{k}")
                                             for k in (1, 2)))
    within = W.partitionBy("conv", "stretch").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = rows.select("conv", "conv_id", "pos", "stretch", *(F.bit_xor(f"t{k}").over(within).alias(f"r{k}") for k in (1, 2)))
    return run.join(start, ["conv", "stretch"]).select(
        "conv", "conv_id", "pos", *(F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"h{k}") for k in (1, 2)))


def maximal(prefix: DataFrame) -> DataFrame:
    """(conv, n): conversations that are no beginning of another, the smallest id of equal ones."""
    key = ["n", "h1", "h2"]
    lengths = prefix.groupBy("conv", "conv_id").agg(F.max("pos").alias("n"))
    rows = prefix.join(lengths.select("conv", "n"), "conv")
    whole = rows.where("pos = n").select("conv", "conv_id", *key)
    first = whole.groupBy(*key).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), F.col("conv_id"), F.col("conv"))).alias("of"))
    begun = rows.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return first.join(begun, key, "left_anti").select("of.conv", "n")


def rendered(role: Column, text: Column) -> Column:
    """One turn; the markers' own strings within a text are parted by a space."""
    safe = F.replace(F.replace(text, F.lit(OPEN), F.lit("< |im_start|>")), F.lit(CLOSE), F.lit("< |im_end|>"))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, text): the maximal conversations of ``rows`` (conv_id, turn, role, text), rendered.

    ``part`` numbers stretches of `TURNS` turns from 0, whose texts in order are the document. Repeated rows are one
    turn; turns of one number are all kept, in the order of role and text; a null role or text is empty; rows without a
    conv_id are one conversation; other columns are ignored; an empty table gives an empty one.
    """
    turns = cut_lineage(turns_of(rows))
    kept = maximal(cut_lineage(prefixes(turns)))
    part = F.floor((F.col("pos") - 1) / TURNS)
    lines = turns.join(kept, "conv").select("conv", "conv_id", part.alias("part"), "n", "pos",
                                            rendered(F.col("role"), F.col("text")).alias("line"))
    texts = lines.groupBy("conv", "conv_id", "part").agg(
        F.max("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return texts.select("conv_id", "part", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"))
