"""What the training-data operators share: tables, shared storage, byte and word views of a batch."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step handles at a time.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one for this session where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), f"shared-{spark.sparkContext.applicationId}")
    return found.rstrip("/")


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    files.deleteOnExit(target)


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that no plan needs any more, and let Spark drop the shuffles behind them."""
    for df in frames:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            delete(df.sparkSession, path)
    frames[0].sparkSession.sparkContext._jvm.System.gc()


_HELD: list = []


def held(cached):
    """Registers a cached function, whose values let_go() drops."""
    _HELD.append(cached.cache_clear)
    return cached


def let_go() -> None:
    """Drop what earlier tasks of this Python worker left behind: workers outlive stages."""
    for clear in _HELD:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # glibc keeps freed memory otherwise
    except (OSError, AttributeError):
        pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The frame with a row number of its own, and that column's name: the same in every plan that reads it.

    Spark numbers rows by partition and place, and may lay out the same frame differently in two plans (other
    columns, another shuffle). So the numbers are written, unless the frame is a bare scan of files, whose
    layout follows from the files alone.
    """
    row = spare(docs, "_row")
    own = docs.withColumn(row, F.monotonically_increasing_id())
    plan = docs._jdf.queryExecution().analyzed().getClass().getSimpleName()
    return (own if plan == "LogicalRelation" else materialize(own, "rows")), row


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None, once: bool = False) -> DataFrame:
    """(_row, _id, _text): one row per input row, so rows that share an id stay apart. Null text is empty.

    row names a column of numbered(); without it the rows are numbered here, and not written if they are read once.
    """
    if row is None and once:
        row = spare(docs, "_row")
        docs = docs.withColumn(row, F.monotonically_increasing_id())
    elif row is None:
        plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
        docs, row = numbered(docs if plain else docs.select(id_col, text_col))
    return docs.select(docs[row].alias("_row"), docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text) for what reads the documents once and needs no number."""
    return docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))


def spare(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts take about `most` bytes; a longer text stands alone."""
    lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and the offsets of each value in them."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A code for each byte value.
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0], have = 1, 1
    with np.errstate(over="ignore"):
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * (out[have - 1] * base)
            have += more
    return out


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of each value: byte starts and ends, and the first word of each value."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw = LOWER[raw] if lower else raw
        inside = ~SPACE[self.raw]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(raw)]
        before[edges] = False  # a word never goes on from one value to the next
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        lasts = offsets[1:] - 1
        after[lasts[lasts >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of value i: words first[i] .. first[i + 1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.raw, self.starts, self.ends)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, none of them empty: its 8-byte blocks, each mixed with its number, summed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    at_byte = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    lengths = ends - starts
    blocks = (lengths + 7) >> 3
    first = np.cumsum(blocks) - blocks
    j = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * j
    left = np.minimum(np.repeat(ends, blocks) - at, 8).astype(np.uint64)
    with np.errstate(over="ignore"):
        value = at_byte[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) * np.uint64(8)))
        key = mix(np.arange(1, int(blocks.max()) + 1, dtype=np.uint64) * STEP)
        sums = np.add.reduceat(mix(value + key[j]), first)
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The hash of each run of n hashes (over value borders too; the caller leaves those out)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64((0xC2B2AE3D27D4EB4F + 2 * salt) & 0xFFFFFFFFFFFFFFFF | 1)
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            out = out * base + hashes[i : len(hashes) - n + 1 + i]
        return mix(out)
