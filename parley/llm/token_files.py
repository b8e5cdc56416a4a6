"""Token id files: ids of many documents end to end, with Elias-Fano coded document boundaries.

A file holds, in this order, integers little-endian:

* 8 bytes magic ``PIDS0001``;
* the ids, ``width`` bytes each (2 where the vocabulary allows, else 4), documents in ascending order of their id;
* the document boundaries (one more than documents), as `EliasFano.to_bytes`;
* the document ids that are not null, as `EliasFano.to_bytes`; null ones come first and are counted in the tail;
* a tail of seven 64-bit integers: width, ids, documents, null documents, and the places of the two coded rows and of the tail.

Files are written by Spark tasks to a folder all machines share, each under a name of its own attempt, and a manifest
row names those that count: a task that runs again leaves a file no manifest names. Every file is opened through its
URI's filesystem.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm.byte_bpe import tokenizer
from parley.llm.elias_fano import EliasFano
from parley.llm.frames import bounded_batches, ids_and_texts
from parley.session import cut_lineage

MAGIC = b"PIDS0001"
_TAIL = struct.Struct("<7q")
#: Ids of one file at most, but for one longer document.
FILE_IDS = 1 << 28
MANIFEST = "part long, number long, path string, docs long, ids long"


class TokenFile:
    """One open file: the tail and the boundaries are read at once, ids when asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - _TAIL.size)
        self.width, self.ids, self.docs, self.nulls, bounds, names, tail = _TAIL.unpack(source.read(_TAIL.size))
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC or tail != size - _TAIL.size:
            raise ValueError("not a token id file")
        source.seek(bounds)
        both = source.read(tail - bounds)
        self.bounds = EliasFano.from_bytes(both[:names - bounds])
        self.names = EliasFano.from_bytes(both[names - bounds:])

    def read_ids(self, lo: int, hi: int) -> np.ndarray:
        self.source.seek(len(MAGIC) + lo * self.width)
        return np.frombuffer(self.source.read((hi - lo) * self.width), dtype=f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.read_ids(self.bounds.select(i), self.bounds.select(i + 1))


class _Writer:
    def __init__(self, folder: str, part: int, number: int, width: int):
        from pyarrow import fs
        self.part, self.number, self.width = part, number, width
        self.path = f"{folder.rstrip('/')}/{part:06d}-{number:03d}-{uuid.uuid4().hex}.ids"
        store, place = fs.FileSystem.from_uri(self.path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.sink = store.open_output_stream(place)
        self.sink.write(MAGIC)
        self.sizes: list[int] = []
        self.names: list[int] = []
        self.nulls = self.ids = 0

    def add(self, name: int | None, ids: np.ndarray) -> None:
        self.sink.write(ids.astype(f"<u{self.width}").tobytes())
        self.sizes.append(len(ids))
        self.ids += len(ids)
        if name is None:
            self.nulls += 1
        else:
            self.names.append(name)

    def close(self) -> dict:
        edges = EliasFano.of(np.concatenate([[0], np.cumsum(np.array(self.sizes, dtype=np.int64))])).to_bytes()
        names = EliasFano.of(np.array(self.names, dtype=np.int64)).to_bytes()
        at = len(MAGIC) + self.ids * self.width
        self.sink.write(edges + names)
        self.sink.write(_TAIL.pack(self.width, self.ids, len(self.sizes), self.nulls, at, at + len(edges),
                                   at + len(edges) + len(names)))
        self.sink.close()
        return {"part": self.part, "number": self.number, "path": self.path, "docs": len(self.sizes), "ids": self.ids}


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int | None = None,
                      file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write them as token id files under ``folder``; gives the manifest.

    Documents are dealt into ranges of doc_id, so the files in order of (part, number) hold all documents in ascending
    order, null ids first; documents of one id stand in an order of their texts' hash. A null or empty text has no
    ids but ``end_id``. Repeated rows are documents of their own; other columns are ignored; an empty table writes
    nothing. The manifest is a written table, so files are made once.
    """
    rows = ids_and_texts(docs).withColumn("tie", F.xxhash64("text"))
    bounded_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_file)
        most = max(bpe.size, (end_id or 0) + 1)
        width, part, out, done = 2 if most <= 1 << 16 else 4, TaskContext.get().partitionId(), None, []
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = bpe.encode(text.as_py())
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                if out is not None and out.ids + len(ids) > file_ids:
                    done.append(out.close())
                    out = None
                if out is None:
                    out = _Writer(folder, part, len(done), width)
                out.add(name, ids)
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return cut_lineage(dealt.mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids): every document of the manifest's files, ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before this one, over all files: the file's own boundaries plus the
    sum of the files before it, which is one small row a file.
    """
    bounded_batches(manifest.sparkSession)
    before = W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).select("path", "base")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as source:
                    file = TokenFile(source, source.size())
                    yield from _documents(file, base)

    # One task a file, however small the manifest is.
    files = max(1, manifest.count())
    return placed.repartition(files).mapInArrow(read, "doc_id long, start long, ids binary")


def _documents(file: TokenFile, base: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    edges = file.bounds.values()
    names = file.names.values()
    lo = 0
    while lo < file.docs:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + most, "right")) - 1)
        hi = min(hi, file.docs)
        ids = file.read_ids(int(edges[lo]), int(edges[hi])).astype("<u4")
        places = ((edges[lo:hi + 1] - edges[lo]) * 4).astype(np.int64)
        values = pa.Array.from_buffers(pa.large_binary(), hi - lo,
                                       [None, pa.py_buffer(places.tobytes()), pa.py_buffer(ids.tobytes())])
        at = np.arange(lo, hi) - file.nulls
        null = at < 0
        known = names[np.maximum(at, 0)] if len(names) else np.zeros(hi - lo, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(known, mask=null), pa.array(edges[lo:hi] + base), values.cast(pa.binary())],
            ["doc_id", "start", "ids"])
        lo = hi


def ids_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
