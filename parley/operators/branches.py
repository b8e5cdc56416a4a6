"""The active branch of reply trees of any depth.

Pointer doubling: after round k every node knows its ancestor 2^k steps up and the branch holds
its first 2^k nodes, so a chain of a million replies takes twenty rounds. Every join hashes on
(conversation, node), or on the conversation and a salt: one huge conversation spreads over the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.session import cut_lineage, release

SALTS = 64


def active_branch(nodes: DataFrame, heads: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(conv, node, depth): the walk from each head to the root; depth 0 is the head, cycles end the walk.

    ``nodes``: conv, node, parent. ``heads``: conv, node. `pos` counts from the root, as the reply order does. The rounds
    run when this is called; what they write goes to the shared checkpoint folder.
    """
    jump = nodes.where(F.col("parent").isNotNull()).select("conv", "node", F.col("parent").alias("up"))
    branch, size = heads.select("conv", "node", F.lit(0).cast("bigint").alias("depth")), None
    for k in range(max_rounds):
        step = branch.join(jump, ["conv", "node"]).select(
            "conv", F.col("up").alias("node"), (F.col("depth") + (1 << k)).alias("depth"))
        # A node reached twice closes a cycle: the first visit counts.
        before, branch = branch, cut_lineage(
            branch.unionByName(step).groupBy("conv", "node").agg(F.min("depth").alias("depth")))
        release(before)
        # Of a written table, so this reads file footers only. No new node: roots and cycles are all reached.
        known, size = size, branch.count()
        if size == known:
            break
        # Nodes less than 2^(k + 1) steps below their root have no longer jump, so this table shrinks by itself.
        above = jump.select("conv", F.col("node").alias("up"), F.col("up").alias("up2"))
        before, jump = jump, cut_lineage(jump.join(above, ["conv", "up"]).select("conv", "node", F.col("up2").alias("up")))
        release(before)
        if jump.isEmpty():
            break
    else:
        raise RuntimeError("reply trees deeper than 2^%d" % max_rounds)
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    length = branch.groupBy("conv").agg(F.max("depth").alias("_last")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return branch.withColumn("_salt", salt).join(length, ["conv", "_salt"]).select(
        "conv", "node", "depth", (F.col("_last") - F.col("depth")).alias("pos"))
