"""Near-duplicate classes of documents: banded MinHash, odd sketches, and a check on full shingle sets.

A document's set is its distinct word shingles. Documents of equal sets are one node from the start. Every node gets

* `BANDS` band keys of `ROWS` MinHash values each: two sets of similarity 0.75 share none with a chance of 2e-6;
* an odd sketch in `BITS` parity bits of its one-permutation MinHash sample (the least value in each of `BINS` bins). The
  ones of the exclusive or of two sketches estimate how many sampled values differ, which ranks a document's partners.
  They also bound it. A value is in one sample only if its shingle is in one set only or hidden in the other set by a lesser one
  of its bin; and a shingle of one set only changes its bin by two values at most. So the ones are at most the shingles
  that differ and those hidden, and at most twice those that differ; two sets of similarity 0.75 differ in at most a
  seventh of both sizes. Pairs beyond that bound, or of sizes too unlike, are out at every size, and no link is lost.

Pairs that pass are confirmed on the full sets, read again from the texts. No table lists all pairs of a bucket. First
come the pairs of every member with its bucket's first document, which are linear and join most copies. Then every bucket
in which components meet is compared in blocks of bounded size, twice: by sketches, which tells the members that may be
linked with another component, and, with the full sets of those, exactly. Pairs just below the similarity are refused
within the task; what leaves it are links, fewer than the components that meet in a block. A task checks the nearest
partners of each member first, then eight times as many, until none of another component is left: nothing is capped.
Components are found after both, by alternating stars on tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import words
from parley.llm.frames import bounded_batches, ids_and_texts, map_batches
from parley.session import cut_lineage, release

BANDS, ROWS = 24, 3
BINS, BITS = 4096, 2048
#: Members of a bucket compared in one task, and shingles of theirs held there; larger buckets are compared block by block.
BLOCK = 1024
SHINGLES = 1 << 20
#: Partners of a member whose sets a task compares at first.
PARTNERS = 64
SALTS = 8
#: Words of 64 bits in the marks of wanted ids: a bound for what `wanted_texts` broadcasts.
MARKS = 1 << 18
_CHUNK = 1 << 18
_rng = np.random.Generator(np.random.PCG64(75))
_FACTOR = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_SEED = np.uint64(0x5851F42D4C957F2D)
FEATURES = "doc_id long, n long, key1 long, key2 long, bands array<long>, sketch array<long>, filled int"


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(edges, hashes): the distinct shingle hashes of text i are hashes[edges[i]:edges[i + 1]], in ascending order."""
    docs, hashes = words.distinct_by_text(*words.shingle_hashes(*words.word_hashes(texts)))
    return words.bounds(docs, len(texts)), hashes


def first_keys(starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Set key 1 of non-empty sets."""
    return words.mixed(np.add.reduceat(words.mixed(hashes ^ _SEED), starts) + sizes.astype(np.uint64))


def features_of(edges: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(set keys 1 and 2, band keys, odd sketches, sampled values) of non-empty sets, row by row."""
    n, sizes = len(edges) - 1, np.diff(edges)
    at = edges[:-1]
    key1 = first_keys(at, sizes, hashes)
    key2 = words.mixed(np.add.reduceat(words.mixed(hashes + _SEED), at))
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.empty((BANDS * ROWS, n), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        least[k] = np.minimum.reduceat(short * _FACTOR[k] + _SHIFT[k], at)
    bands = np.empty((n, BANDS), dtype=np.uint64)
    for b in range(BANDS):
        value = np.full(n, b + 1, dtype=np.uint64)
        for r in range(ROWS):
            value = words.mixed(value ^ least[b * ROWS + r] + _SEED)
        bands[:, b] = value
    # Sorted within a document, the first value of each bin is its least one.
    spread = words.mixed(hashes * _SEED)
    for lo, hi in zip(edges[:-1], edges[1:]):
        spread[lo:hi].sort()
    bin_of = spread >> np.uint64(65 - BINS.bit_length())
    owner = np.repeat(np.arange(n), sizes)
    first = np.ones(len(spread), dtype=bool)
    first[1:] = (bin_of[1:] != bin_of[:-1]) | (owner[1:] != owner[:-1])
    owner, sample = owner[first], spread[first]
    filled = np.bincount(owner, minlength=n)
    flips = np.bincount(owner * BITS + (words.mixed(sample + _SEED) >> np.uint64(53)).astype(np.int64), minlength=n * BITS)
    sketch = np.packbits((flips & 1).astype(np.uint8).reshape(n, BITS), axis=1, bitorder="little").view(np.uint64)
    return key1, key2, bands, sketch, filled


def features(docs: DataFrame) -> DataFrame:
    """One row a document; a document without words has size 0 and nulls."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        edges, hashes = shingle_sets(batch.column("text"))
        sizes = np.diff(edges)
        full = np.flatnonzero(sizes)
        parts, lo = [], 0
        ends = np.cumsum(sizes[full])
        while lo < len(full):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _CHUNK, "right")))
            base = edges[full[lo]]
            cuts = np.append(edges[full[lo:hi]], edges[full[hi - 1] + 1]) - base
            parts.append(features_of(cuts, hashes[base:base + cuts[-1]]))
            lo = hi
        columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(5)]
        where = np.zeros(len(sizes), dtype=np.int64)
        where[full] = np.arange(len(full))

        def column(k: int, kind: pa.DataType) -> pa.Array:
            if not parts:
                return pa.nulls(len(sizes), kind)
            if pa.types.is_list(kind):
                flat = pa.array(columns[k].view(np.int64).ravel())
                step = columns[k].shape[1]
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * step), flat)
            else:
                made = pa.array(columns[k].view(np.int64) if columns[k].dtype == np.uint64 else columns[k]).cast(kind)
            return made.take(pa.array(where, mask=sizes == 0))

        longs = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes.astype(np.int64)), column(0, pa.int64()), column(1, pa.int64()),
             column(2, longs), column(3, longs), column(4, pa.int32())],
            ["doc_id", "n", "key1", "key2", "bands", "sketch", "filled"])

    return map_batches(ids_and_texts(docs), run, FEATURES)


# ---- what an odd sketch says of a pair --------------------------------------------------------------------------

def passes(a: str, b: str) -> Column:
    """Whether the sketches and sizes of two rows (struct columns ``a`` and ``b``) leave a link possible."""
    x, y = F.col(a), F.col(b)
    ones = F.aggregate(F.zip_with(x["sketch"], y["sketch"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0),
                       lambda s, v: s + v)
    least, greatest = F.least(x["n"], y["n"]), F.greatest(x["n"], y["n"])
    both = x["n"] + y["n"]
    return (least * 100 >= greatest * 75) & (7 * ones <= F.least(2 * both, 8 * both - 7 * (x["filled"] + y["filled"])))


def _ones(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ, one row of ``sketch`` by one of ``others``."""
    return np.bitwise_count(sketch[:, None, :] ^ others[None, :, :]).sum(axis=2, dtype=np.int64)


def _shared(ones: np.ndarray, filled: np.ndarray, other_filled: np.ndarray) -> np.ndarray:
    differ = -BITS / 2 * np.log(1 - 2 * np.minimum(ones, BITS // 2 - 1) / BITS)
    return (filled[:, None] + other_filled[None, :] - differ) / 2


def _common(sketch: np.ndarray, filled: np.ndarray, others: np.ndarray, other_filled: np.ndarray) -> np.ndarray:
    """Estimated common sketched values, one row of ``sketch`` by one of ``others``."""
    return _shared(_ones(sketch, others), filled, other_filled)


def _possible(both: np.ndarray, filled: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """`passes` of sizes that go together, for numpy arrays: ``both`` sizes and ``filled`` numbers added up."""
    return 7 * ones <= np.minimum(2 * both, 8 * both - 7 * filled)


# ---- candidate pairs --------------------------------------------------------------------------------------------

def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, first, m): the buckets of several members, with the first of them and their number."""
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    first = buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return buckets.join(first, "bucket").select("bucket", "node", "first", "m")


def star_pairs(nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """(a, b), a < b: members with the first node of a bucket of theirs, where the sketches leave a link possible."""
    pairs = buckets.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    seen = nodes.select("node", F.struct("n", "sketch", "filled").alias("f"))
    both = (pairs.join(seen.select(F.col("node").alias("b"), F.col("f").alias("fb")), "b")
            .join(seen.select(F.col("node").alias("a"), F.col("f").alias("fa")), "a"))
    return both.where(passes("fa", "fb")).select("a", "b").distinct()


def _forest(a: np.ndarray, b: np.ndarray, near: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of members make the nearest spanning forest of the components ``comp``, by rounds in which
    every tree takes the nearest pair that leaves it."""
    order = np.lexsort((b, a, -near))
    names, label = np.unique(comp, return_inverse=True)
    x, y = label[a[order]], label[b[order]]
    every, none = np.arange(len(names)), len(order)
    live, stay = np.flatnonzero(x != y), np.zeros(none, dtype=bool)
    while len(live):
        best = np.full(len(names), none)
        np.minimum.at(best, x[live], live)
        np.minimum.at(best, y[live], live)
        has = np.flatnonzero(best < none)
        stay[order[best[has]]] = True
        to = every.copy()
        to[has] = x[best[has]] + y[best[has]] - has
        # Two trees that take one pair point at each other: the lesser is the root.
        to = np.where((to[to] == every) & (every < to), every, to)
        while (to != to[to]).any():
            to = to[to]
        x, y = to[x], to[y]
        live = live[x[live] != y[live]]
    return stay


def _merged(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components ``comp`` of members, those of the pairs (a, b) made one: the least."""
    while (comp[a] != comp[b]).any():
        names, at = np.unique(comp, return_inverse=True)
        to = np.arange(len(names))
        np.minimum.at(to, np.maximum(at[a], at[b]), np.minimum(at[a], at[b]))
        while (to != to[to]).any():
            to = to[to]
        comp = names[to[at]]
    return comp


def _partners(group: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, near): the members of one block group that may be linked and are of different components, with an estimate of
    their similarity. A pair of several common buckets counts in the first only."""
    own = group["left"] != group["right"]
    left, right = np.flatnonzero(group["left"]), np.flatnonzero(group["right"])
    same = not own.any()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(left), 64):
        rows = left[lo:lo + 64]
        allowed = group["comp"][rows][:, None] != group["comp"][right][None, :]
        if same:
            allowed &= group["node"][rows][:, None] < group["node"][right][None, :]
        n_a, n_b = group["n"][rows][:, None], group["n"][right][None, :]
        allowed &= np.minimum(n_a, n_b) * 100 >= np.maximum(n_a, n_b) * 75
        if not allowed.any():
            continue
        ones = _ones(group["sketch"][rows], group["sketch"][right])
        common = _shared(ones, group["filled"][rows], group["filled"][right])
        filled = group["filled"][rows][:, None].astype(np.int64) + group["filled"][right][None, :]
        allowed &= _possible(n_a + n_b, filled, ones)
        i, j = np.nonzero(allowed)
        if len(i):
            a, b = rows[i], right[j]
            band_a, band_b = group["bands"][a], group["bands"][b]
            first = (band_a == band_b).argmax(axis=1)
            keep = band_a[np.arange(len(a)), first] == group["bucket"][0]
            found.append((a[keep], b[keep], common[i, j][keep] / np.maximum(group["n"][a], group["n"][b])[keep]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _similar(group: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the full sets of members have 100 * intersection >= 75 * union, pair by pair; ``a`` comes sorted."""
    edges, values = group["edges"], group["values"]
    sizes, out = np.diff(edges), np.zeros(len(a), dtype=bool)
    mark = np.zeros(int(values.max()) + 1, dtype=bool)
    cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own, others = values[edges[a[lo]]:edges[a[lo] + 1]], b[lo:hi]
        mark[own] = True
        ends = np.cumsum(sizes[others])
        at = np.arange(ends[-1]) + np.repeat(edges[others] - ends + sizes[others], sizes[others])
        common = np.add.reduceat(mark[values[at]], ends - sizes[others], dtype=np.int64)
        out[lo:hi] = 100 * common >= 75 * (len(own) + sizes[others] - common)
        mark[own] = False
    return out


def _links(group: dict[str, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b: links that join the components of one block group as all its links do. The ``most`` nearest partners
    of each member are checked first, then eight times as many of what is left, until nothing is."""
    a, b, near = _partners(group)
    if not len(a):
        return a, b
    order = np.lexsort((-near, a))
    a, b, near, comp = a[order], b[order], near[order], group["comp"]
    group = {**group, "values": np.unique(group["values"], return_inverse=True)[1]}
    found = []
    while len(a):
        take = np.zeros(len(a), dtype=bool)
        for side in (a, b):
            order = np.lexsort((-near, side))
            new = np.concatenate([[True], side[order][1:] != side[order][:-1]])
            at = np.arange(len(order))
            take[order[at - np.maximum.accumulate(np.where(new, at, 0)) < most]] = True
        some = np.flatnonzero(take)
        some = some[_similar(group, a[some], b[some])]
        some = some[_forest(a[some], b[some], near[some], comp)]
        comp = _merged(comp, a[some], b[some])
        found.append((group["node"][a[some]], group["node"][b[some]]))
        left = ~take & (comp[a] != comp[b])
        a, b, near, most = a[left], b[left], near[left], most * 8
    one, two = (np.concatenate([f[k] for f in found]) for k in range(2))
    return np.minimum(one, two), np.maximum(one, two)


def in_blocks(members: DataFrame, size: Column, seen: DataFrame, fn: Callable[[dict[str, np.ndarray]], tuple], schema: str) -> DataFrame:
    """``fn`` on the members of every bucket in which components meet, block by block: ``size`` blocks, an aggregate, of
    each bucket of ``members`` (bucket, node, comp). ``seen`` has what else ``fn`` takes, by node."""
    open_ = (members.groupBy("bucket").agg(F.ceil(size).alias("blocks"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .where("lo <> hi").select("bucket", "blocks"))
    rows = members.select("bucket", "node", "comp").join(open_, "bucket").join(seen, "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "comp", *seen.columns)
    rows = rows.withColumn("left", F.col("own") == F.col("i")).withColumn("right", F.col("own") == F.col("j")).drop("own")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    bounded_batches(members.sparkSession)
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            # The last group may go on in the next batch; groups have at most two blocks of members.
            cuts = _group_edges(table)
            yield from _compared(table, cuts[:-1])
            kept = table.slice(cuts[-2])
        if kept is not None and kept.num_rows:
            yield from _compared(kept, np.array([0, kept.num_rows]))

    def _group_edges(table: pa.Table) -> np.ndarray:
        if not table.num_rows:
            return np.zeros(1, dtype=np.int64)
        key = np.stack([table.column(c).to_numpy() for c in ("bucket", "i", "j")])
        new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        return np.concatenate([[0], new, [table.num_rows]])

    def _compared(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(cuts) < 2:
            return
        table = table.slice(0, cuts[-1]).combine_chunks()
        flat = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
                for c in ("bucket", "node", "comp", "n", "filled", "left", "right")}
        for c, width in (("bands", BANDS), ("sketch", BITS // 64)):
            lists = table.column(c).combine_chunks()
            flat[c] = lists.flatten().to_numpy().reshape(-1, width)
        flat["sketch"] = flat["sketch"].view(np.uint64)
        if "set" in table.column_names:
            lists = table.column("set").combine_chunks()
            values, edges = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        made = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi - lo > 1:
                group = {c: v[lo:hi] for c, v in flat.items()}
                if "set" in table.column_names:
                    group |= {"edges": edges[lo:hi + 1] - edges[lo], "values": values[edges[lo]:edges[hi]]}
                made.append(fn(group))
        out = [np.concatenate([m[k] for m in made]) if made else np.zeros(0) for k in range(len(names))]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    return dealt.mapInArrow(run, schema)


def near_members(nodes: DataFrame, buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """(bucket, node, comp, n): members that may be linked with a member of another component, see `_partners`, by the bucket
    that tells so."""
    placed = (buckets.where("m > 2").select("bucket", "node").join(comps.select("node", "comp"), "node", "left")
              .withColumn("comp", F.coalesce("comp", "node")))

    def run(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        a, b, _ = _partners(group)
        at = np.unique(np.concatenate([a, b]))
        return tuple(group[c][at] for c in ("bucket", "node", "comp", "n"))

    near = in_blocks(placed, F.count(F.lit(1)) / BLOCK, nodes.select("node", "n", "bands", "sketch", "filled"), run,
                     "bucket long, node long, comp long, n long")
    return near.groupBy("bucket", "node").agg(F.max("comp").alias("comp"), F.max("n").alias("n"))


def partner_pairs(nodes: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a < b: links of ``members`` (`near_members`) that join their components, see `_links`; ``sets`` has the sets
    of all of them (`shingle_table`)."""
    most = PARTNERS
    seen = nodes.join(sets, ["node", "key1"]).select("node", "n", "bands", "sketch", "filled", "set")
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES)
    return in_blocks(members, size, seen, lambda group: _links(group, most), "a long, b long")


def wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids in ``wanted`` (doc_id), and of few others whose hash falls on the same bit of `MARKS` words:
    what is broadcast is bounded, and no text is shuffled for its id."""

    def marked(rows: DataFrame) -> DataFrame:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS * 64))
        return rows.withColumn("word", F.floor(place / 64)).withColumn("bit", (place % 64).cast("int"))

    marks = marked(wanted).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("marks"))
    return marked(ids_and_texts(docs)).join(F.broadcast(marks), "word").where(
        "shiftrightunsigned(marks, bit) & 1L = 1L").select("doc_id", "text")


def shingle_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, key1, set) of the ids in ``wanted`` (doc_id), and of few others, as a written table: the sets are made again
    from the texts. A row that stands several times gives one set."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        edges, hashes = shingle_sets(batch.column("text"))
        full = np.flatnonzero(np.diff(edges))
        if not len(full):
            return None
        keys = first_keys(edges[full], np.diff(edges)[full], hashes)
        sets = pa.ListArray.from_arrays(pa.array(np.append(edges[full], len(hashes)).astype(np.int32)), pa.array(hashes.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(full)), pa.array(keys.view(np.int64)), sets],
                                          ["node", "key1", "set"])

    made = map_batches(wanted_texts(docs, wanted), run, "node long, key1 long, set array<long>")
    return cut_lineage(made.dropDuplicates(["node", "key1"]))


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= 75 * union, as a written table."""
    sets = shingle_table(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    found = cut_lineage(both.withColumn("common", common).where(
        100 * F.col("common") >= 75 * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b").distinct())
    release(sets)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each linked node's component, by alternating large and small stars."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before, edges = edges, cut_lineage(small)
        release(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        state = now


def joined(comps: DataFrame) -> DataFrame:
    """(a, b): components as links of their nodes with the smallest one."""
    return comps.select(F.col("comp").alias("a"), F.col("node").alias("b"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    A null or empty text, or one of white space, has no set and is linked with nothing. A row without a doc_id is
    linked with nothing either: its component_id is null and it is kept. Rows of one doc_id are one document, linked by
    the id. Repeated rows give repeated rows; other columns are ignored; an empty table gives an empty one.
    """
    rows = cut_lineage(features(docs))
    known = rows.select("doc_id", "key1", "key2", "n").where("doc_id is not null and n > 0")
    same = known.groupBy("key1", "key2", "n").agg(F.min("doc_id").alias("node"))
    # A set that very many documents have is one key: the documents are dealt over `SALTS`, the sets once for each.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    same = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = cut_lineage(known.withColumn("salt", salt).join(same, ["key1", "key2", "n", "salt"]).select("doc_id", "node", "key1"))
    # The first document of every set stands for its copies.
    first = of.where("doc_id = node").groupBy("doc_id", "key1").count()
    # A row that stands several times is one node; only such rows are shuffled for it.
    found = [rows.join(first.where(f"count {sign} 1"), ["doc_id", "key1"], "left_semi").select(
        F.col("doc_id").alias("node"), "key1", "n", "bands", "sketch", "filled") for sign in ("=", ">")]
    nodes = cut_lineage(found[0].unionByName(found[1].dropDuplicates(["node", "key1"])))
    sizes = cut_lineage(rows.select("doc_id", F.col("n").alias("n_shingles")))
    release(rows)
    buckets = cut_lineage(shared_buckets(nodes))
    tried = cut_lineage(star_pairs(nodes, buckets))
    links = confirmed(tried, docs)
    comps = components(links)
    members = cut_lineage(near_members(nodes, buckets, comps))
    sets = shingle_table(docs, members.select(F.col("node").alias("doc_id")).distinct())
    more = cut_lineage(partner_pairs(nodes, members, sets))
    made = [of, nodes, buckets, tried, links, members, sets, more]
    # Copies are linked with their first document; so are rows of one id but different texts.
    copies = of.where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    comps = components(joined(comps).union(more).union(copies))
    for table in made:
        release(table)
    out = sizes.join(comps.select(F.col("node").alias("doc_id"), F.col("comp")), "doc_id", "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
