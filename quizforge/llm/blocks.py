"""Removal of repeated word runs: fixed blocks index every document, rolling windows probe them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, flat, mix, partitions, rows_of, slices, table, windows

#: Words of a repeat.
WINDOW = 13
#: Words of a block: every window holds a whole one, wherever the blocks of its document stand.
BLOCK = (WINDOW + 1) // 2
#: Bits of a probe hash; equal probes with different words only make more candidates.
BITS = 40
#: The id of a document without one: it is after all others, so it makes none lose words.
LAST = np.iinfo(np.int64).max


def squeeze(x: np.ndarray) -> bytes:
    """Ascending or any integers as compressed byte planes of their differences."""
    d = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def expand(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


class Part:
    """Some documents: ids (LAST if null), whether null, their bytes and offsets."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray):
        self.ids, self.raw, self.offsets = ids, raw, offsets

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Part:
        return cls(np.asarray(batch.column("_id").fill_null(LAST)), *flat(batch.column("_text")))

    def pack(self) -> bytes:
        head = np.array([len(self.ids)], np.int64).tobytes() + self.ids.tobytes() + self.offsets.tobytes()
        return zstandard.ZstdCompressor(level=1).compress(head + self.raw.tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> Part:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        return cls(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint8, offset=16 + 16 * n), np.frombuffer(raw, np.int64, n + 1, 8 + 8 * n))

    def read(self) -> None:
        """word: hash of each word; doc: its document; at: its place there."""
        view = Words(self.raw, self.offsets)
        self.first = view.first
        count = np.diff(view.first)
        self.word, self.doc = view.hashes(), np.repeat(np.arange(len(self.ids)), count)
        self.at = np.arange(len(self.word)) - np.repeat(view.first[:-1], count)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of n words within a document."""
        h = windows(self.word, n)
        start = np.flatnonzero(self.doc[: len(h)] == self.doc[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        return start, h[start]

    def checks(self, start: np.ndarray) -> np.ndarray:
        """A second hash, of 32 bits, of the windows of WINDOW words from start on."""
        other = mix(self.word ^ np.uint64(0xA0761D6478BD642F))
        return (windows(other, WINDOW, 77)[start] >> np.uint64(32)).astype(np.uint32) if len(start) else np.zeros(0, np.uint32)


def grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, distinct): order sorts h and keeps places in order; first of each distinct value in it."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return order, first, s[first]


def probes(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, probe) of each rolling window of BLOCK words; the distinct probes and their flags.

    Flags: 1 where the probe is a block (at a multiple of BLOCK words) of a document, 2 where two documents hold it.
    """
    start, h = part.runs(BLOCK)
    h = h >> np.uint64(64 - BITS)
    order, first, distinct = grouped(h)
    if not len(h):
        return start, h, distinct, np.zeros(0, np.uint8)
    last = np.append(first[1:], len(h)) - 1
    many = part.doc[start[order[first]]] != part.doc[start[order[last]]]
    block = np.maximum.reduceat((part.at[start[order]] % BLOCK == 0).astype(np.uint8), first)
    return start, h, distinct, block | (many.astype(np.uint8) << 1)


def _dealt(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The bounds of each bucket in ascending values of so many bits."""
    top = values >> np.uint64(bits - 32)
    return np.searchsorted((top * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part]]:
    """Numbered parts of a task's documents. The numbers are the same each time the input is read."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for own in slices(batch, "_text"):
            yield number, Part.of(own)
            number += 1


def _probe_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for number, part in _parts(batches):
        part.read()
        _, _, distinct, flags = probes(part)
        cut = _dealt(distinct, BITS, buckets)
        rows = [(k, number, squeeze(distinct[a:b]), flags[a:b].tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "part", "probes", "flags"])


def _met(rows: pa.Table) -> pa.Table:
    """For each part's probes of a bucket, a bit: a block of one document that another holds too."""
    lists = [expand(x) for x in rows.column("probes").to_pylist()]
    flags = [np.frombuffer(x, np.uint8) for x in rows.column("flags").to_pylist()]
    h, f = np.concatenate(lists), np.concatenate(flags)
    order, first, _ = grouped(h)
    count = np.diff(first, append=len(h))
    any_ = np.bitwise_or.reduceat(f[order], first)
    good = (any_ & 1 > 0) & ((count > 1) | (any_ & 2 > 0))
    out = np.empty(len(h), bool)
    out[order] = np.repeat(good, count)
    ends = np.cumsum([len(x) for x in lists])
    return pa.table({"part": rows.column("part"), "bucket": rows.column("bucket"), "bits": pa.array([np.packbits(x).tobytes() for x in np.split(out, ends[:-1])], pa.binary())})


def _window_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Around each hit: the windows that hold it, as distinct hashes with the least id of the part, a second hash, and whether two ids of the part have it."""
    for batch in batches:
        for number, data, found in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), batch.column("found").to_pylist(), strict=True):
            part = Part.unpack(data)
            part.read()
            start, probe, distinct, _ = probes(part)
            cut, bits = _dealt(distinct, BITS, buckets), {x["bucket"]: x["bits"] for x in found}
            good = np.concatenate([np.unpackbits(np.frombuffer(bits[k], np.uint8), count=b - a) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b] or [np.zeros(0, np.uint8)])
            hit = np.zeros(len(part.word) + 1, np.int64)
            hit[start] = good[np.searchsorted(distinct, probe)]
            upto = np.concatenate([[0], np.cumsum(hit)])
            at, h = part.runs(WINDOW)
            near = upto[at + WINDOW - BLOCK + 1] > upto[at]
            at, h = at[near], h[near]
            order, first, distinct = grouped(h)
            own = part.ids[part.doc[at[order]]]
            least, most = (f.reduceat(own, first) if len(h) else np.zeros(0, np.int64) for f in (np.minimum, np.maximum))
            check = part.checks(at[order[first]])
            cut = _dealt(distinct, 64, buckets)
            rows = [(k, number, squeeze(distinct[a:b]), squeeze(least[a:b]), check[a:b].tobytes(), np.packbits(most[a:b] > least[a:b]).tobytes()) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], ["bucket", "part", "hashes", "least", "checks", "many"])


def _least(rows: pa.Table) -> pa.Table:
    """For each part the windows of a bucket that an id after the least of all has there, with that least id."""
    lists = [expand(x) for x in rows.column("hashes").to_pylist()]
    ids = [expand(x).view(np.int64) for x in rows.column("least").to_pylist()]
    own = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)).astype(bool) for x, y in zip(rows.column("many").to_pylist(), lists, strict=True)]
    h, i, check, many = (np.concatenate(x) for x in (lists, ids, [np.frombuffer(x, np.uint32) for x in rows.column("checks").to_pylist()], own))
    order, first, _ = grouped(h)
    if (check[order][1:] != check[order][:-1])[h[order][1:] == h[order][:-1]].any():  # one hash, different words
        order = np.lexsort((check, h))
        first = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])]))
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(i[order], first), np.diff(first, append=len(h)))
    many |= least < i
    ends = np.cumsum([len(x) for x in lists])[:-1]
    out = [(squeeze(x[m]), squeeze(y[m])) for x, y, m in zip(lists, np.split(least, ends), np.split(many, ends), strict=True)]
    return pa.table({"part": rows.column("part"), "hashes": pa.array([x for x, _ in out], pa.binary()), "least": pa.array([y for _, y in out], pa.binary())})


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of windows that start in a document of smaller id, as found around hits, go."""
    for batch in batches:
        for data, found in zip(batch.column("data").to_pylist(), batch.column("found").to_pylist(), strict=True):
            part = Part.unpack(data)
            part.read()
            at, h = part.runs(WINDOW)
            gone = np.zeros(len(part.word) + 1, np.int64)
            if found and len(h):
                far, ids = np.concatenate([expand(x["hashes"]) for x in found]), np.concatenate([expand(x["least"]).view(np.int64) for x in found])
                order = np.argsort(far)
                far, ids = far[order], ids[order]
                place = np.minimum(np.searchsorted(far, h), max(len(far) - 1, 0))
                lost = at[(far[place] == h) & (ids[place] < part.ids[part.doc[at]])] if len(far) else at[:0]
                np.add.at(gone, lost, 1)
                np.add.at(gone, lost + WINDOW, -1)
            keep = np.cumsum(gone[:-1]) == 0
            raw, out = part.raw.tobytes(), []
            for k, (a, b) in enumerate(zip(part.first.tolist(), part.first[1:].tolist(), strict=False)):
                words = raw[part.offsets[k] : part.offsets[k + 1]].split()
                mine = keep[a:b]
                turns = np.flatnonzero(np.diff(np.concatenate([[True], mine, [True]]).astype(np.int8)))
                out.append((b - a, int(b - a - mine.sum()), [{"start": i, "end": j} for i, j in turns.reshape(-1, 2).tolist()], b" ".join(words if mine.all() else compress(words, mine.tolist()))))
            n, removed, spans, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part.ids, mask=part.ids == LAST), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])


def cut_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document row: doc_id, n_words, n_removed, spans (removed words, from start to before end), kept (the other words, parted by spaces).

    A word goes if a run of WINDOW words that covers it also starts in a document of smaller id. 1. Each
    document's blocks of BLOCK words and its rolling windows of as many, as probes, meet by hash in buckets.
    2. A block that another document's probe hits is extended on both sides, in the documents of both: all windows
    that hold it. 3. These windows meet by two hashes, 96 bits in all; each learns the least id that has it, so a
    run of such windows is a maximal repeat. What no hit touches is never removed.
    What meets is packed: a row per part of the documents and bucket, each hash once a part, however often it
    occurs. Buckets are as many as shuffle partitions. Null text has no words. A null id is after all ids. Rows
    that share an id don't cut each other. Other columns are not read. No documents: no rows.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = rows_of(docs, id_col, text_col).select("_id", "_text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part.pack()], pa.binary())], ["part", "data"])

    parts = rows.mapInArrow(packed, "part long, data binary")
    hits = rows.mapInArrow(lambda b: _probe_rows(b, n), "bucket int, part long, probes binary, flags binary").groupBy("bucket").applyInArrow(_met, "part long, bucket int, bits binary")
    marked = parts.join(hits.groupBy("part").agg(F.collect_list(F.struct("bucket", "bits")).alias("found")), "part").select("part", "data", "found")
    least = marked.mapInArrow(lambda b: _window_rows(b, n), "bucket int, part long, hashes binary, least binary, checks binary, many binary").groupBy("bucket").applyInArrow(_least, "part long, hashes binary, least binary")
    answers = least.groupBy("part").agg(F.collect_list(F.struct("hashes", "least")).alias("found"))
    return parts.join(answers, "part", "left").select("part", "data", "found").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document row: doc_id, n_words, n_removed, kept_sha256."""
    return cut_words(docs, id_col, text_col).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_fixed_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents"))
