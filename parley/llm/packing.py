"""Packing of token rows into sequences by cutting-stock column generation.

Every document is cut into pieces of the whole capacity and one rest. What is left is a cutting-stock problem whose
data are the counts of each rest length, at most `capacity` numbers whatever the corpus: a linear program over patterns
(how many rests of each size share a sequence), whose columns come from a knapsack dynamic program priced with the
program's duals. Sizes are taken in steps of `GRID` tokens there. The rounded-down solution is used as often as it says,
what remains is filled largest first, and pattern runs are split where a slot's exact length changes, so that every
slot has a fixed offset. Documents are ranked within their length (counts by part and length, then running sums), and a
rank finds its slot in the table of runs, which is bounded by the capacity as well.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.byte_bpe import tokenizer
from parley.llm.frames import bounded_batches, ids_and_texts
from parley.session import cut_lineage

CAPACITY = 2048
GRID = 2
SALTS = 16
PIECES = "part long, doc_id long, start long, length int, doc_tokens long, turn long, width int, ids binary"


# ---- the cutting-stock problem: bounded by the capacity, so it is solved on the driver ----------------------------

def knapsack(worth: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(best worth, last item taken) for every room up to ``size``; ``worth[s]`` is the worth of one item of size s."""
    best = np.zeros(size + 1)
    last = np.zeros(size + 1, dtype=np.int64)
    for room in range(1, size + 1):
        value = worth[1:room + 1] + best[room - 1::-1] if room > 1 else worth[1:2] + best[:1]
        k = int(value.argmax())
        if value[k] > best[room - 1]:
            best[room], last[room] = value[k], k + 1
        else:
            best[room], last[room] = best[room - 1], last[room - 1]
    return best, last


class _Master:
    """The restricted program: a revised simplex over a pool of patterns, started from the patterns of one size each."""

    def __init__(self, demand: dict[int, int], size: int):
        self.sizes = sorted(demand)
        self.index = {s: i for i, s in enumerate(self.sizes)}
        self.need = np.array([demand[s] for s in self.sizes], dtype=float)
        fit = np.array([size // s for s in self.sizes], dtype=float)
        self.basis: list[dict[int, int]] = [{s: size // s} for s in self.sizes]
        self.inverse = np.diag(1 / fit)
        self.amount, self.duals = self.need / fit, 1 / fit
        self.pool: list[dict[int, int]] = []
        self.known: set[tuple] = set()
        self.rows = np.zeros((0, len(self.sizes)))

    def add(self, patterns: list[dict[int, int]]) -> int:
        new = []
        for pattern in patterns:
            key = tuple(sorted(pattern.items()))
            if key not in self.known:
                self.known.add(key)
                new.append(pattern)
        rows = np.zeros((len(new), len(self.sizes)))
        for i, pattern in enumerate(new):
            for s, times in pattern.items():
                rows[i, self.index[s]] = times
        self.pool += new
        self.rows = np.vstack([self.rows, rows])
        return len(new)

    def solve(self, pivots: int) -> None:
        """Best use of the pool's patterns, or as far as ``pivots`` steps lead."""
        for _ in range(pivots):
            gains = self.rows @ self.duals - 1
            k = int(gains.argmax()) if len(gains) else -1
            if k < 0 or gains[k] <= 1e-7:
                return
            column = self.inverse @ self.rows[k]
            ratio = np.full(len(self.sizes), np.inf)
            up = column > 1e-9
            if not up.any():
                return
            ratio[up] = self.amount[up] / column[up]
            r = int(ratio.argmin())
            step = max(float(ratio[r]), 0.0)
            self.amount -= step * column
            self.amount[r] = step
            np.maximum(self.amount, 0, out=self.amount)
            pivot = self.inverse[r] / column[r]
            rows = np.flatnonzero(np.abs(column) > 1e-12)
            self.inverse[rows] -= np.outer(column[rows], pivot)
            self.inverse[r] = pivot
            self.duals = self.duals - gains[k] * pivot
            self.basis[r] = self.pool[k]


def fractional_patterns(demand: dict[int, int], size: int, gap: float = 2e-4,
                        rounds: int = 6) -> list[tuple[dict[int, int], float]]:
    """A (nearly) optimal solution of the pattern program: [(pattern {item size: times}, how often)].

    The pool starts with the patterns of a largest-first filling. Each round solves the program over the pool; one
    dynamic program then prices for every size the best pattern that holds it, and those worth more than a sequence
    join the pool. Duals swing widely at first, so patterns are priced between them and the duals of the best bound so
    far, of which the first are the sizes' own shares of a sequence. Ends at the optimum, when the bound is within
    ``gap``, or after ``rounds``; every stage is a feasible solution.
    """
    if not demand:
        return []
    master = _Master(demand, size)
    sizes = master.sizes
    master.add([dict(Counter(lengths)) for lengths in fill_largest_first(dict(demand), size)])
    center = np.array(sizes, dtype=float) / size
    bound, weight = float(center @ master.need), 0.8
    for _ in range(rounds):
        master.solve(len(sizes))
        if bound >= master.amount.sum() * (1 - gap):
            break
        priced = weight * center + (1 - weight) * master.duals
        worth = np.full(size + 1, -1.0)
        worth[sizes] = priced
        best, last = knapsack(worth, size)
        made = []
        for s in sizes:
            pattern, room = Counter({s: 1}), size - s
            while room > 0 and last[room]:
                pattern[int(last[room])] += 1
                room -= int(last[room])
            if sum(master.duals[master.index[k]] * n for k, n in pattern.items()) > 1 + 1e-6:
                made.append(dict(pattern))
        here = float(priced @ master.need) / max(float(best[size]), 1e-12)
        if here > bound:
            bound, center = here, priced / best[size]
        if not master.add(made):
            if weight < 0.01:
                break
            weight *= 0.5
    return [(p, float(x)) for p, x in zip(master.basis, master.amount) if x > 1e-9]


def fill_largest_first(left: dict[int, int], size: int) -> Counter:
    """What remains, each sequence taking the largest length that still fits: {lengths: how often}. A filled pattern is
    used as often as its lengths last, so the steps grow with the distinct lengths, not with the sequences."""
    made: Counter = Counter()
    left = {k: n for k, n in left.items() if n}
    keys = sorted(left)
    while keys:
        room, takes = size, {}
        at = bisect_right(keys, room) - 1
        while at >= 0:
            k = keys[at]
            takes[k] = min(left[k], room // k)
            room -= takes[k] * k
            at = min(at, bisect_right(keys, room)) - 1
        times = min(left[k] // take for k, take in takes.items())
        for k, take in takes.items():
            left[k] -= take * times
            if not left[k]:
                keys.pop(bisect_right(keys, k) - 1)
        made[tuple(k for k, take in takes.items() for _ in range(take))] += times
    return made


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, grid: int = GRID) -> pd.DataFrame:
    """Runs of slots (length, lo, n, sequence, offset): ranks lo … lo + n - 1 of a length go to sequences
    sequence … sequence + n - 1, all at one offset. Every rank of every length is in exactly one run."""
    runs: list[tuple[int, int, int, int, int]] = []
    used: Counter = Counter()
    sequence = counts.get(capacity, 0)
    if sequence:
        runs.append((capacity, 0, sequence, 0, 0))
    left = {k: n for k, n in counts.items() if n and k != capacity}
    room = capacity // grid
    steps: Counter = Counter()
    for k, n in left.items():
        steps[-(-k // grid)] += n
    queue = {s: sorted((k for k in left if -(-k // grid) == s), reverse=True) for s in steps}

    def emit(lengths: list[int], n: int) -> None:
        nonlocal sequence
        offset = 0
        for k in lengths:
            runs.append((k, used[k], n, sequence, offset))
            used[k] += n
            left[k] -= n
            offset += k
        sequence += n

    for pattern, often in fractional_patterns(steps, room):
        times = int(often + 1e-6)
        slots = [s for s in sorted(pattern, reverse=True) for _ in range(pattern[s])]
        wanted = Counter(slots)
        while times:
            lengths, run = [], times
            for s in wanted:
                # The slots of one size take their exact lengths in turn, the larger ones first.
                stock = [(k, left[k]) for k in queue[s] if left[k]]
                need = wanted[s]
                for k, n in stock:
                    take = min(need, n)
                    lengths += [k] * take
                    run = min(run, n // take)
                    need -= take
                    if not need:
                        break
                if need:
                    run = 0
                    break
            if not run:
                break
            emit(lengths, run)
            times -= run
    for lengths, n in fill_largest_first(left, capacity).items():
        emit(list(lengths), n)
    return pd.DataFrame(runs, columns=["length", "lo", "n", "sequence", "offset"])


# ---- the Spark job ----------------------------------------------------------------------------------------------

def cut_pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece; ``turn`` numbers the pieces of a length within the task (``part``) that made them."""
    rows = ids_and_texts(docs)
    bounded_batches(docs.sparkSession)

    def run(batches):
        bpe = tokenizer(tokenizer_file)
        width = 2 if max(bpe.size, end_id + 1) <= 1 << 16 else 4
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            names, starts, lengths, totals, turns, data = [], [], [], [], [], []
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(bpe.encode(text.as_py()), np.uint32(end_id)).astype(f"<u{width}")
                for at in range(0, len(ids), capacity):
                    piece = ids[at:at + capacity]
                    names.append(name)
                    starts.append(at)
                    lengths.append(len(piece))
                    totals.append(len(ids))
                    turns.append(seen[len(piece)])
                    seen[len(piece)] += 1
                    data.append(piece.tobytes())
            n = len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, dtype=np.int64)), pa.array(names, type=pa.int64()), pa.array(starts, type=pa.int64()),
                 pa.array(lengths, type=pa.int32()), pa.array(totals, type=pa.int64()), pa.array(turns, type=pa.int64()),
                 pa.array(np.full(n, width, dtype=np.int32)), pa.array(data, type=pa.binary())],
                ["part", "doc_id", "start", "length", "doc_tokens", "turn", "width", "ids"])

    return rows.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """All documents as pieces placed in sequences of at most ``capacity`` tokens.

    Columns doc_id, start (the document's ids before the piece), length, doc_tokens, sequence_id, offset (in the
    sequence, without gaps from 0), width and ids (little-endian, ``width`` bytes each). A null or empty text is the end
    id alone. Repeated rows are documents of their own; other columns are ignored; an empty table gives an empty one.
    The pieces are a written table, so that ranks stay the same however often a task runs.
    """
    pieces = cut_lineage(cut_pieces(docs, tokenizer_file, end_id, capacity))
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # At most `capacity` rows, one a length.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = packing_plan(counts, capacity).sort_values(["length", "lo"])
    shift = 1 << 44
    keys = (plan["length"] * shift + plan["lo"]).to_numpy(dtype=np.int64)
    slots = docs.sparkSession.sparkContext.broadcast(
        (keys, plan["lo"].to_numpy(dtype=np.int64), plan["sequence"].to_numpy(dtype=np.int64),
         plan["offset"].to_numpy(dtype=np.int64)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, lo, sequence, offset = slots.value
        rank = rank.to_numpy()
        at = np.searchsorted(keys, length.to_numpy().astype(np.int64) * (1 << 44) + rank, "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank - lo[at], "offset": offset[at]})

    # Most pieces of a part have the whole capacity: their key is dealt over `SALTS`, the narrow side once for each.
    full, salts = F.col("length") == capacity, F.sequence(F.lit(0), F.lit(SALTS - 1))
    offsets = offsets.withColumn("salt", F.explode(F.when(full, salts).otherwise(F.array(F.lit(0)))))
    pieces = pieces.withColumn("salt", F.when(full, F.pmod("turn", F.lit(SALTS))).otherwise(0).cast("int"))
    placed = pieces.join(offsets, ["part", "length", "salt"]).withColumn("at", place("length", F.col("before") + F.col("turn")))
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens",
                         "at.sequence_id", "at.offset", "width", "ids")


def ids_crc32(ids: Column, width: Column) -> Column:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("long")
    def crc(ids: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, dtype=f"<u{w}").astype("<u4").tobytes())
                          for x, w in zip(ids, width)], dtype="int64")

    return crc(ids, width)
