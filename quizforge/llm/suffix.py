"""Removal of repeated byte strings: collections of document parts, each given a BWT with common prefixes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, STEP, delete, flat, forget, held, let_go, materialize, mix, numbered, partitions, powers, rows_of, shared_dir, slices, spare, table

#: Bytes of a repeat.
LENGTH = 200
#: Bytes of an anchor.
ANCHOR = 24
#: Kinds of parts under one anchor from which they are split by the bytes around it.
COLLECTION = 8_192
#: Places of the anchor that windows of a split part may have.
SPLIT = 32
#: Bytes of parts from which a collection is closed after its anchor's last.
GATHER = 1 << 16
#: Bytes of a column of a collection from which it is a file, and bytes read from it at a time.
SPILL, READ = 1 << 15, 1 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Two moduli and bases of part digests: unequal parts of 400 bytes meet in both with odds of some 400 / 2 ** 61 * 400 / 2 ** 31.
_LARGE, _SMALL = (1 << 61) - 1, (1 << 31) - 1
_BASES = (1_405_310_203_571_408_291, 1_234_567_891)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2 ** 61 - 1, of numbers below it."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    ah, al, bh, bl = a >> half, a & low, b >> half, b & low
    mid = ah * bl + al * bh
    return _fold(((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << half) + al * bl)


def _fold(x: np.ndarray) -> np.ndarray:
    top = np.uint64(_LARGE)
    x = (x & top) + (x >> np.uint64(61))
    return np.where(x >= top, x - top, x)


@held
@lru_cache(maxsize=8)
def _powers(base: int, modulus: int, bits: int) -> np.ndarray:
    """base ** 0 .. base ** (2 ** bits - 1), by the modulus."""
    out = np.ones(1, np.uint64)
    for k in range(bits):
        by = np.uint64(pow(base, 1 << k, modulus))
        out = np.concatenate([out, _times(out, by) if modulus == _LARGE else out * by % np.uint64(modulus)])
    return out


def part_digests(raw: np.ndarray, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial digests, by both moduli, of the bytes lo .. lo + size."""
    bits = max(19, len(raw).bit_length())
    code = raw.astype(np.uint64) + np.uint64(1)

    def between(weight: np.ndarray) -> np.ndarray:  # sums wrap, but the bytes of a part add up to less than that
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * weight)])
        return total[lo + size] - total[lo]

    with np.errstate(over="ignore"):
        power = _powers(_BASES[0], _LARGE, bits)[: len(raw)]
        high, low = between(power >> np.uint64(30)), between(power & np.uint64((1 << 30) - 1))
        high = _times(_fold(high), np.uint64(1 << 30))
        large = _times(_fold(high + _fold(low)), _powers(pow(_BASES[0], -1, _LARGE), _LARGE, bits)[lo])
        small = between(_powers(_BASES[1], _SMALL, bits)[: len(raw)]) % np.uint64(_SMALL)
        small = small * _powers(pow(_BASES[1], -1, _SMALL), _SMALL, bits)[lo] % np.uint64(_SMALL)
    return large, small


def _rolling(raw: np.ndarray) -> np.ndarray:
    """The hash of each ANCHOR bytes."""
    with np.errstate(over="ignore"):
        h, n, by = BYTE_CODE[raw], 1, STEP
        have: dict[int, np.ndarray] = {}
        while True:
            have[n] = h
            if 2 * n > ANCHOR:
                break
            h = h[:-n] * by + h[n:]
            n, by = 2 * n, by * by
        out, size = have[n], n
        while size < ANCHOR:
            n = max(k for k in have if k <= ANCHOR - size)
            more = have[n][size:]
            out, size = out[: len(more)] * powers(STEP, n + 1)[n] + more, size + n
        return mix(out)


def _extreme(x: np.ndarray, n: int, of) -> np.ndarray:
    """of(x[i], ..., x[i + n - 1]) for each i."""
    size = 1
    while 2 * size <= n:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(value, first, windows, anchor hash, anchor place after first, two digests) of each part.

    Each window of `length` bytes belongs to its anchor, the last of the least hashed ANCHOR bytes in it, so
    equal windows have equal anchors at equal places. A part is a run of windows with one anchor: those that
    start in first .. first + windows - 1 (in all bytes); the first digest takes in the anchor's place too.
    """
    span = length - ANCHOR + 1
    starts, ends = offsets[:-1], offsets[1:]
    fits = np.flatnonzero(ends - starts >= length)
    none = np.zeros(0, np.int64)
    if not len(fits):
        return none, none, none, none.view(np.uint64), none, none.view(np.uint64), none.view(np.uint64)
    h = _rolling(raw)
    h[h == _NONE] -= np.uint64(1)
    least = _extreme(h, span, np.minimum)
    counts = ends[fits] - starts[fits] - length + 1
    p = np.repeat(starts[fits] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    valid = np.zeros(len(h) + span - 1, np.uint64)
    valid[span - 1 + p] = least[p]  # shifted, so that the maximum below is over the windows that hold a place
    chosen = np.flatnonzero(_extreme(valid, span, np.maximum) == h)
    upto = np.zeros(len(h) + 1, np.int64)
    upto[chosen + 1] = 1
    rank = np.cumsum(upto)[p + span] - 1
    want = least[p]
    wrong = np.flatnonzero(h[chosen[rank]] != want)
    while len(wrong):
        rank[wrong] -= 1
        wrong = wrong[h[chosen[rank[wrong]]] != want[wrong]]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(rank) != 0) | (np.diff(p) != 1)]))
    windows = np.diff(first, append=len(p))
    lo, q = p[first], chosen[rank[first]]
    large, small = part_digests(raw, lo, windows + length - 1)
    return np.searchsorted(offsets, lo, "right") - 1, lo, windows, h[q], q - lo, large ^ mix((windows * 4096 + (q - lo)).astype(np.uint64)), small


PARTS = "h long, d long, e int, _row long, lo int, n short, q short"


def _parts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        for own in slices(batch, "_text", 1 << 18):
            raw, offsets = flat(own.column("_text"))
            value, lo, windows, h, place, large, small = anchors(raw, offsets, length)
            rows = np.asarray(own.column("_row"))[value]
            columns = (h.view(np.int64), large.view(np.int64), small.astype(np.int32), rows, (lo - offsets[value]).astype(np.int32), windows.astype(np.int16), place.astype(np.int16))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "d", "e", "_row", "lo", "n", "q"])


@lru_cache(maxsize=4)
def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class Column:
    """An array that each round reads and writes anew from front to back: once it is over `spill` bytes, a new file of the shared folder."""

    def __init__(self, folder: str, name: str, spill: int):
        self.store, root = _store(folder)
        self.own, self.round, self.kept = f"{root}/{uuid.uuid4().hex}-{name}", 0, np.zeros(0)
        self.spill = spill

    def read(self) -> np.ndarray:
        if self.kept is not None:
            return self.kept
        out, at = np.empty(self.bytes, np.uint8), 0
        with self.store.open_input_stream(f"{self.own}-{self.round}") as stream:
            while at < self.bytes:
                data = stream.read(min(READ, self.bytes - at))
                out[at : at + len(data)] = np.frombuffer(data, np.uint8)
                at += len(data)
        return out.view(self.dtype)

    def write(self, x: np.ndarray) -> None:
        self.close()
        self.kept, self.dtype, self.bytes = x, x.dtype, x.nbytes
        if x.nbytes > self.spill:
            self.round += 1
            with self.store.open_output_stream(f"{self.own}-{self.round}") as stream:
                stream.write(np.ascontiguousarray(x))
            self.kept = None

    def close(self) -> None:
        if self.kept is None:
            self.store.delete_file(f"{self.own}-{self.round}")


def repeated(texts: list[np.ndarray], length: int, folder: str, spill: int = SPILL) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of each suffix that shares its first `length` symbols with another of the collection.

    The texts' BWT grows by a symbol per text each round, from their ends: round j inserts the suffixes of
    j + 1 symbols (and the end mark). A suffix c + s comes at the number of end marks, of smaller symbols and
    of c before s in the BWT. Its common prefix with its neighbours is one more than the least one between s
    and the next c above and below. BWT and common prefixes (up to `length`) are Columns in the folder; the
    places of the repeats are walked out of the finished BWT.
    """
    m = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, m)
    if not m or length < 1 or not sizes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols, code = np.unique(np.concatenate(texts), return_inverse=True)
    kind = np.uint16 if len(symbols) < 1 << 16 else np.uint32
    width = int(sizes.max()) + 1
    back = np.zeros((width + 1, m), kind)  # back[j]: the symbol j + 1 from the end, 0 before the first
    ends = np.cumsum(sizes)
    back[np.repeat(ends, sizes) - 1 - np.arange(len(code)), np.repeat(np.arange(m), sizes)] = code + 1
    bwt, common = Column(folder, "bwt", spill), Column(folder, "lcp", spill)

    def steps(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows by symbol, place of each row in them, first place of each symbol)."""
        order = np.argsort(b, kind="stable")
        idx = np.empty(len(b), np.int64)
        idx[order] = np.arange(len(b))
        return order, idx, np.cumsum(np.bincount(b.astype(np.int64) + 1, minlength=len(symbols) + 3))

    bwt.write(back[0])
    common.write(np.zeros(m, np.uint8 if length < 256 else np.uint16 if length < 1 << 16 else np.uint32))
    at = np.arange(m)  # where the suffix inserted last is, by text
    who = np.arange(m)
    for j in range(width - 1):
        live = back[j, who] > 0
        at, who = at[live], who[live]
        if not len(who):
            break
        b, lcp = bwt.read(), common.read()
        c = back[j, who].astype(np.int64)
        order, idx, first = steps(b)
        idx = idx[at]
        new = m + idx - first[1]
        ext = np.append(lcp, lcp.dtype.type(0))

        def least(lo: np.ndarray, hi: np.ndarray, ext: np.ndarray = ext) -> np.ndarray:
            """min(lcp[lo:hi]); starts fall, so that no run but these is read."""
            if not len(lo):
                return np.zeros(0, np.int64)
            down = np.argsort(-lo, kind="stable")
            out = np.empty(len(lo), np.int64)
            out[down] = np.minimum.reduceat(ext, np.stack([lo[down], hi[down]], 1).ravel())[::2]
            return out

        up = np.flatnonzero(idx > first[c])
        above = np.zeros(len(who), np.int64)
        above[up] = np.minimum(1 + least(order[idx[up] - 1] + 1, at[up] + 1), length)
        dn = np.flatnonzero(idx + 1 < first[c + 1])
        below = np.minimum(1 + least(at[dn] + 1, order[idx[dn] + 1] + 1), length)
        size = len(b) + len(who)
        old = np.ones(size, bool)
        old[new] = False
        merged = []
        for have, put in ((b, back[j + 1, who]), (lcp, above)):
            x = np.empty(size, have.dtype)
            x[old] = have
            x[new] = put
            merged.append(x)
        after = new[dn] + 1
        stay = old[after]  # a new suffix below has its own value already
        merged[1][after[stay]] = below[stay]
        bwt.write(merged[0])
        common.write(merged[1])
        at = new
    b, lcp = bwt.read(), common.read()
    bwt.close()
    common.close()
    dup = lcp >= length
    dup[:-1] |= dup[1:]
    _, idx, first = steps(b)
    idx += m - first[1]
    at, who, text, place = np.arange(m), np.arange(m), [], []
    for j in range(width - 1):
        live = b[at] > 0
        at, who = idx[at[live]], who[live]
        hit = dup[at]
        text.append(who[hit])
        place.append(sizes[who[hit]] - j - 1)
    return np.concatenate(text), np.concatenate(place)


def block(length: int) -> int:
    """Bytes of a symbol of the collections."""
    return next(b for b in (8, 4, 2, 1) if length % b == 0)


def repeated_windows(segs: list[bytes], folder: str, length: int = LENGTH, spill: int = SPILL) -> tuple[np.ndarray, np.ndarray]:
    """(part, start) of each window of the parts that another one equals.

    A part joins the collection once for each byte phase, as a text of blocks, so that each window starts a
    suffix of one of its texts: rounds are fewer by the bytes of a block, and as many suffixes are inserted.
    """
    size = block(length)
    texts, part, start = [], [], []
    for k, seg in enumerate(segs):
        for r in range(min(size, len(seg) - length + 1)):
            n = (len(seg) - r) // size
            texts.append(np.frombuffer(seg, f"<u{size}", n, r))
            part.append(k)
            start.append(r)
    text, at = repeated(texts, length // size, folder, spill)
    return np.array(part, np.int64)[text], np.array(start, np.int64)[text] + at * size


def _collections(batches: Iterator[pa.RecordBatch], length: int, folder: str, spill: int) -> Iterator[pa.RecordBatch]:
    """Parts in order of their anchors: the repeated windows of those not yet decided."""
    segs: list[bytes] = []
    keys: list[tuple] = []
    last, size, own = None, 0, 0  # own: parts of the last anchor

    def done() -> Iterator[pa.RecordBatch]:
        rows, los, alone = (np.array(x) for x in zip(*keys, strict=True))
        text, place = repeated_windows(segs, folder, length, spill)
        keep = alone[text]
        text, place = text[keep], place[keep]
        order = np.lexsort((place, text))
        text, place = text[order], place[order]
        start = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(place, prepend=-9) != 1))
        yield pa.RecordBatch.from_arrays([pa.array(rows[text[start]], pa.int64()), pa.array((los[text[start]] + place[start]).astype(np.int32)), pa.array(np.diff(start, append=len(text)).astype(np.int16))], ["_row", "lo", "n"])

    let_go()
    for batch in batches:
        for h, seg, row, lo, alone in zip(*(batch.column(x).to_pylist() for x in ("h", "seg", "_row", "lo", "alone")), strict=True):
            if h != last:
                if own == 1:  # nothing to meet
                    size -= len(segs.pop())
                    keys.pop()
                if size >= GATHER:
                    yield from done()
                    segs, keys, size = [], [], 0
                own = 0
            last, own = h, own + 1
            segs.append(seg)
            keys.append((row, lo, alone))
            size += len(seg)
    if segs:
        yield from done()


def _fetch(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the parts asked for, split by a longer anchor.

    Windows that have the anchor at one of so many neighbouring places share all bytes but twice as many at their
    ends, less two. So they go by a digest of these shared bytes. The places are dealt to two halves; for an
    anchor with over `most` kinds, to runs of SPLIT.
    """
    let_go()
    for batch in batches:
        for part in slices(batch, "_text"):
            out: list[tuple] = []
            for row, text, asked in zip(part.column("_row").to_pylist(), part.column("_text").to_pylist(), part.column("asked").to_pylist(), strict=True):
                raw = text.encode()
                for x in asked:
                    lo, n, alone = x["lo"], x["n"], x["c"] == 1
                    step = (length - ANCHOR + 2) // 2 if x["g"] <= most else SPLIT
                    at = lo + x["q"]  # windows from lo to lo + n - 1 have the anchor q - (n - 1) .. q bytes after their start
                    for near in range(0, x["q"] + 1, step):
                        a, z = max(lo, at - near - step + 1), min(lo + n - 1, at - near)
                        if a <= z:
                            same = raw[at - near : at - near - step + 1 + length]
                            key = hashlib.blake2b(same, digest_size=8, salt=near.to_bytes(8, "little")).digest()
                            out.append((int.from_bytes(key, "little", signed=True), raw[a : z + length], row, a, alone))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], ["h", "seg", "_row", "lo", "alone"])


def spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_row, cover): runs (lo, n) of starts, in bytes of the text, of windows that start elsewhere too.

    1. Each text is cut into parts by anchors. 2. Parts whose anchor occurs once hold no repeat. Of parts that are
    equal as a whole (by two digests, and the anchor's place), however many, one stands for all, and all are
    repeats. 3. Where one anchor has several kinds of parts, some of them single (where repeats begin and
    end), the kinds go by anchor into collections for repeated().
    """
    spark, most, spill = rows.sparkSession, COLLECTION, SPILL
    parts = materialize(rows.mapInArrow(lambda b: _parts(b, length), PARTS), "op1-parts")
    kind = F.struct("d", "e")
    twice = parts.groupBy("h").agg(F.count("*").alias("c"), F.min(kind).alias("a"), F.max(kind).alias("z")).where("c > 1").select("h", (F.col("a") != F.col("z")).alias("mixed"))
    twice = materialize(twice, "op1-twice")  # a plain side, so that the join's hot anchors can be split
    met = materialize(parts.join(twice, "h"), "op1-met")
    forget(parts, twice)
    mixed = met.where("mixed")
    kinds = materialize(mixed.groupBy("h", "d", "e").agg(F.count("*").alias("c"), F.min(F.struct("_row", "lo", "n", "q")).alias("x")).select("h", "d", "e", "c", "x.*"), "op1-kinds")
    groups = kinds.groupBy("h").agg(F.count("*").alias("g"), F.min("c").alias("least")).where("least = 1").select("h", "g")
    asked = materialize(kinds.join(groups, "h").groupBy("_row").agg(F.collect_list(F.struct("h", "g", "lo", "n", "q", "c")).alias("asked")), "op1-asked")
    segments = rows.join(asked, "_row").mapInArrow(lambda b: _fetch(b, length, most), "h long, seg binary, _row long, lo int, alone boolean")
    folder = f"{shared_dir(spark)}/op1-columns-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    edges = segments.repartition(partitions(spark), "h").sortWithinPartitions("h", "_row", "lo").mapInArrow(lambda b: _collections(b, length, folder, spill), "_row long, lo int, n short")
    equal = met.where("not mixed").select("_row", "lo", "n").union(mixed.join(kinds.where("c > 1").select("h", "d", "e"), ["h", "d", "e"]).select("_row", "lo", "n"))
    found = materialize(equal.union(edges).groupBy("_row").agg(F.collect_list(F.struct("lo", "n")).alias("cover")), "op1-spans")
    forget(met, kinds, asked)
    delete(spark, folder)
    return found


def _kept(text: str, cover: list | None, length: int) -> tuple[bytes, int, int, int]:
    """(kept bytes, bytes, removed, maximal removed runs)."""
    raw = text.encode()
    if not cover:
        return raw, len(raw), 0, 0
    change = np.zeros(len(raw) + 1, np.int64)
    lo = np.array([x["lo"] for x in cover])
    np.add.at(change, lo, 1)
    np.add.at(change, lo + np.array([x["n"] for x in cover]) + length - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), len(raw), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def _cover(rows: DataFrame, length: int) -> DataFrame:
    return rows.join(spans(rows, length), "_row", "left")


def substring_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """A row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a `length`-byte string that also starts elsewhere (same row included) goes, each
    copy of it. Null text is empty; texts under `length` bytes lose nothing. Rows that share an id or a text
    are documents each. A null id stays null. Other columns are not read. No documents: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                out = [_kept(t, c, length) for t, c in zip(part.column("_text").to_pylist(), part.column("cover").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *(pa.array([x[i] for x in out], pa.int64()) for i in (1, 2, 3)), pa.array([hashlib.sha256(x[0]).hexdigest() for x in out])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _cover(rows_of(docs, id_col, text_col), length).select("_id", "_text", "cover").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents, with all their columns, whose texts lose the repeats; broken characters at the cuts go too.

    A null text stays null. n_chars and other columns stay as they are.
    """
    schema, (own, row) = docs.schema, numbered(docs)
    found = spare(own, "cover")
    cover = spans(rows_of(own, id_col, text_col, row), length).select(F.col("_row").alias(row), F.col("cover").alias(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None or not c else _kept(t, c, length)[0].decode(errors="ignore") for t, c in zip(batch.column(text_col).to_pylist(), batch.column(found).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if f.name == text_col else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return own.join(cover, row, "left").drop(row).mapInArrow(run, schema)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_repeats(table(spark, sf_dir, "documents"))
