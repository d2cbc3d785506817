"""Token-id files coded by a static range asymmetric numeral system (rANS).

A folder holds three Parquet tables. `table`: one row, the frequency table

    magic 'RNSF' | u32 bits | u32 ids | ids x u32 frequency

`totals`: the number of ids of each part (a range of document ids). `chunks`: a row (part, chunk, data) for some whole
documents. Its data, all numbers little-endian:

    magic 'RNS2' | u32 documents | u32 blocks | u32 lanes | u64 ids in all | u32 part | u64 ids of the part before it | u32 crc32 of the table
    documents x i64 id | documents x u32 length | a bit per document whether its id is null, in whole bytes
    blocks x (u64 first id, u64 byte offset, u32 bytes, u32 crc32)     the checkpoints
    blocks' bytes

A block starts from its own lane states, so any block can be decoded alone. Id i of a block belongs to lane
i mod lanes: states are 64-bit in [2**31, 2**63) and give up 32 bits at a time. All chunks share the frequency table.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_on_exit, forget, materialize, partitions, shared_dir, slices, table, texts_of
from .tokens import END_ID, encoder, tokenizer_path, with_end

MAGIC, TABLE = b"RNS2", b"RNSF"
#: Frequencies sum to 1 << BITS, or more where there are more ids than a quarter of that.
BITS = 20
LANES = 2048
#: Ids in a block, and ids from which a chunk is closed.
BLOCK = 1 << 17
CHUNK = 1 << 18
_HEAD = struct.Struct("<4sIIIQIQI")
_POINT = struct.Struct("<QQII")


def shares(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Integer frequencies that sum to 1 << bits, at least 1 for each id that occurs."""
    total, whole = int(counts.sum()), 1 << bits
    out = np.zeros(len(counts), np.int64)
    if not total:
        return out
    seen = counts > 0
    if seen.sum() > whole:
        raise ValueError("more distinct ids than slots")
    out[seen] = np.maximum(1, counts[seen] * (whole - int(seen.sum())) // total)
    order = np.argsort(-out, kind="stable")
    spare = whole - int(out.sum())  # never negative but for the ones raised to 1
    if spare >= 0:
        out[order[0]] += spare
    for i in order:
        if spare >= 0:
            break
        less = min(int(out[i]) - 1, -spare)
        out[i] -= less
        spare += less
    return out


def table_bits(kinds: int) -> int:
    return max(BITS, kinds.bit_length() + 2)


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.freq, self.bits = freq.astype(np.uint64), np.uint64(bits)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.mask = np.uint64((1 << bits) - 1)
        self.top = np.uint64(31 - bits + 32)
        self.crc = zlib.crc32(self.table())

    def table(self) -> bytes:
        return TABLE + struct.pack("<II", int(self.bits), len(self.freq)) + self.freq.astype("<u4").tobytes()

    @classmethod
    def of(cls, data: bytes) -> Coder:
        """The coder of a written table."""
        bits, n = struct.unpack_from("<II", data, 4)
        if data[:4] != TABLE or len(data) != 12 + 4 * n:
            raise ValueError("not a frequency table")
        return cls(np.frombuffer(data, "<u4", n, 12).astype(np.int64), bits)

    def encode(self, ids: np.ndarray, lanes: int) -> bytes:
        state = np.full(lanes, 1 << 31, np.uint64)
        words: list[np.ndarray] = []
        for at in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            s = ids[at : at + lanes]
            f, x = self.freq[s], state[: len(s)]
            over = x >= (f << self.top)
            words.append(x[over].astype(np.uint32))
            x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            state[: len(s)] = (q << self.bits) + (x - q * f) + self.cum[s]
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        return state.astype("<u8").tobytes() + stream.astype("<u4").tobytes()

    def decode(self, data: bytes, n: int, lanes: int) -> np.ndarray:
        state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
        stream = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
        out, used = np.empty(n, np.uint32), 0
        for at in range(0, n, lanes):
            x = state[: min(lanes, n - at)]
            low = x & self.mask
            s = self.slot[low]
            out[at : at + len(x)] = s
            x = self.freq[s] * (x >> self.bits) + low - self.cum[s]
            under = np.flatnonzero(x < np.uint64(1 << 31))
            x[under] = (x[under] << np.uint64(32)) | stream[used : used + len(under)]
            used += len(under)
            state[: len(x)] = x
        if used != len(stream) or (state != 1 << 31).any():
            raise ValueError("block does not end in its first state")
        return out


def write_chunk(docs: np.ndarray, lengths: np.ndarray, ids: np.ndarray, coder: Coder, nulls: np.ndarray | None = None, part: int = 0, base: int = 0, block: int = BLOCK, lanes: int = LANES) -> bytes:
    lanes = max(1, min(lanes, len(ids) // 32))
    blocks = [coder.encode(ids[i : i + block], lanes) for i in range(0, len(ids), block)]
    points, at = b"", 0
    for k, data in enumerate(blocks):
        points += _POINT.pack(k * block, at, len(data), zlib.crc32(data))
        at += len(data)
    bits = np.packbits(np.zeros(len(docs), bool) if nulls is None else nulls).tobytes()
    return _HEAD.pack(MAGIC, len(docs), len(blocks), lanes, len(ids), part, base, coder.crc) + docs.astype("<i8").tobytes() + lengths.astype("<u4").tobytes() + bits + points + b"".join(blocks)


class Chunk:
    """A chunk's data: docs, nulls, lengths, part, base and total are read at once, ids by blocks.

    Raises ValueError where magic, frequency table, checksum or state is wrong.
    """

    def __init__(self, data: bytes, coder: Coder):
        magic, n, blocks, self.lanes, self.total, self.part, self.base, crc = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a chunk")
        if crc != coder.crc:
            raise ValueError("coded by another frequency table")
        self.data, self.coder, at = data, coder, _HEAD.size
        self.docs, self.lengths = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, "<u4", n, at + 8 * n)
        at += 12 * n
        self.nulls = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool)
        at += -(-n // 8)
        self.points = [_POINT.unpack_from(data, at + i * _POINT.size) for i in range(blocks)]
        self.first = at + blocks * _POINT.size

    def block(self, k: int) -> np.ndarray:
        """The ids from checkpoint k to the next; nothing else is decoded."""
        first, offset, size, crc = self.points[k]
        end = self.points[k + 1][0] if k + 1 < len(self.points) else self.total
        own = self.data[self.first + offset : self.first + offset + size]
        if zlib.crc32(own) != crc:
            raise ValueError(f"checksum of the block at id {first}")
        return self.coder.decode(own, end - first, self.lanes)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids start .. stop, from the last checkpoint before them on."""
        stop = self.total if stop is None else min(stop, self.total)
        firsts = [p[0] for p in self.points]
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, z = int(np.searchsorted(firsts, start, "right")) - 1, int(np.searchsorted(firsts, stop, "left"))
        return np.concatenate([self.block(k) for k in range(a, z)])[start - firsts[a] : stop - firsts[a]]


def _chunks(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Documents in order to rows of raw chunks, and at the end the counts of the partition's ids."""
    from pyspark import TaskContext

    own, part = encoder(path), TaskContext.get().partitionId()
    counts = np.zeros(1 << 16, np.int64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    size = base = number = 0

    def row() -> pa.RecordBatch:
        docs, nulls, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        values = [part, number, base, docs.astype("<i8").tobytes(), np.packbits(nulls).tobytes(), lengths.astype("<u4").tobytes(), ids.astype("<u4" if ids.max() >> 16 else "<u2").tobytes(), int(lengths.sum()), None, None]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    names = ["part", "chunk", "base", "docs", "nulls", "lengths", "ids", "n", "token", "count"]
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    for batch in batches:
        for piece in slices(batch, "_text"):
            ids, offsets = with_end(*own.encode(piece.column("_text")), end_id)
            most = int(ids.max(initial=0))
            if most >= len(counts):
                counts = np.concatenate([counts, np.zeros(most + 1 - len(counts), np.int64)])
            counts += np.bincount(ids, minlength=len(counts))
            key = piece.column("_id")
            docs, nulls, lengths = np.asarray(key.fill_null(0)), np.asarray(key.is_null()), np.diff(offsets)
            cuts = np.flatnonzero(np.diff(offsets[1:] // CHUNK, prepend=0))  # close after these documents
            for a, b in zip([0, *(cuts + 1)], [*(cuts + 1), len(docs)], strict=True):
                if a == b:
                    continue
                held.append((docs[a:b], nulls[a:b], lengths[a:b], ids[offsets[a] : offsets[b]].astype(np.uint32)))
                size += int(lengths[a:b].sum())
                if size >= CHUNK:
                    yield row()
                    base, number, held, size = base + size, number + 1, [], 0
    if held:
        yield row()
        base += size
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([part, -1, base, None, None, None, None, 0, seen.astype(np.int32), counts[seen]], types, strict=True)], names)


RAW = "part int, chunk long, base long, docs binary, nulls binary, lengths binary, ids binary, n long, token array<int>, count array<long>"


def write_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, out: str | None = None) -> str:
    """Encode all documents, in ascending id order, into files of the folder `out`, which is returned.

    Without `out` it is a folder of the shared one, and goes when the application ends. The order is id, then
    text; null ids come first. Only the frequency table (as long as the vocabulary) comes to the driver.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    if out is None:
        out = f"{shared_dir(spark)}/op9-{uuid.uuid4().hex}"
        delete_on_exit(spark, out)
    ordered = texts_of(docs, id_col, text_col).repartitionByRange(partitions(spark), "_id").sortWithinPartitions("_id", "_text")
    raw = materialize(ordered.mapInArrow(lambda b: _chunks(b, path, end_id), RAW), "op9-raw")
    found = raw.where("chunk = -1").select(F.explode(F.arrays_zip("token", "count")).alias("x")).groupBy(F.col("x.token").alias("token")).agg(F.sum("x.count").alias("n")).toPandas()
    counts = np.zeros(int(found["token"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["token"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    bits = table_bits(len(found))
    coder = Coder(shares(counts, bits), bits)
    spark.createDataFrame([(coder.table(),)], "data binary").coalesce(1).write.parquet(f"{out}/table")
    freq = coder.freq.astype(np.int64)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(freq, bits)
        for batch in batches:
            for x in batch.to_pylist():
                lengths = np.frombuffer(x["lengths"], "<u4")
                ids = np.frombuffer(x["ids"], "<u2" if len(x["ids"]) == 2 * x["n"] else "<u4").astype(np.uint32)
                nulls = np.unpackbits(np.frombuffer(x["nulls"], np.uint8), count=len(lengths))
                data = write_chunk(np.frombuffer(x["docs"], "<i8"), lengths, ids, own, nulls, x["part"], x["base"])
                yield pa.RecordBatch.from_arrays([pa.array([x["part"]], pa.int32()), pa.array([x["chunk"]], pa.int64()), pa.array([data], pa.binary())], ["part", "chunk", "data"])

    raw.where("chunk >= 0").drop("token", "count").mapInArrow(code, "part int, chunk long, data binary").write.option("compression", "none").parquet(f"{out}/chunks")
    raw.where("chunk = -1").select("part", F.col("base").alias("total")).coalesce(1).write.parquet(f"{out}/totals")
    forget(raw)
    return out


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """Decode a folder of write_ids(), of this session or any: a row per document with its start among all ids, length and crc32 of its ids."""
    first, base = {}, 0
    for x in sorted(spark.read.parquet(f"{out}/totals").collect()):  # a row for each range partition
        first[x["part"]] = base
        base += x["total"]
    written = bytes(spark.read.parquet(f"{out}/table").first()["data"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(written)
        for batch in batches:
            for data in batch.column("data").to_pylist():
                chunk = Chunk(data, coder)
                raw, ends = chunk.ids().astype("<u4").tobytes(), np.cumsum(chunk.lengths.astype(np.int64))
                starts = ends - chunk.lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(chunk.docs, pa.int64(), mask=chunk.nulls), pa.array(starts + chunk.base + first[chunk.part], pa.int64()), pa.array(chunk.lengths, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.parquet(f"{out}/chunks").select("data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, out: str | None = None) -> DataFrame:
    """Write all ids to the coded files and read them back: doc_id, start, n_tokens, ids_crc32.

    Null or empty text is the end id alone. Rows that share an id are coded each, in text order. A null id
    stays null and comes first. Other columns, of any name, are not read. No documents: no rows.
    """
    return read_ids(docs.sparkSession, write_ids(docs, id_col, text_col, path, out=out))


def op9_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))
