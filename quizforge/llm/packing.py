"""Sum-of-squares packing of token documents into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, texts_of
from .tokens import END_ID, encoder, tokenizer_path, with_end

WINDOW = 4096
#: Bytes of text and documents of a packer, about: what it holds is bounded by them.
PACKER_BYTES, PACKER_ROWS = 32 << 20, 100_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
_REST = "doc_id long, start long, doc_tokens long, length long, ids_crc32 long, ids binary"


class Packer:
    """Online packing. A piece goes into the open window whose choice makes the sum over fill levels of squared
    window counts least (ties: the fullest); a full window leaves.

    Levels are counted in an array over 1 .. window - 1. drain() empties the windows that are open at the end: their
    pieces, cut where needed, fill whole windows, and the last part is cut to powers of two, which need no padding.
    A piece is (document, start, tokens of the document, length, crc32, bytes of ids). drained counts the tokens so placed.
    """

    def __init__(self, window: int, first: int):
        self.window, self.next, self.drained = window, first, 0
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(window + 1)]
        self.out: list[tuple] = []

    def _emit(self, number: int, pieces: list) -> None:
        at, total = 0, sum(p[3] for p in pieces)
        for doc, start, tokens, length, crc, _ in pieces:
            self.out.append((doc, start, length, crc, tokens, number, at, total))
            at += length

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def whole(self, piece: tuple) -> None:
        self._emit(self.new(), [piece])

    def place(self, piece: tuple) -> None:
        size, w = piece[3], self.window
        count, levels = self.count, w - size
        # placing on level h makes the sum change by 2 * (count[h + size] - count[h]) + 2; a full window is not counted
        change = 2 * (count[size + 1 : w + 1] - count[1 : levels + 1]) + 2
        change[-1:] = 1 - 2 * count[levels : levels + 1]
        change[count[1 : levels + 1] == 0] = np.iinfo(np.int64).max
        level = 0
        if len(change):
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * count[size] + 1:
                level = best + 1
        if level:
            number, pieces = self.open[level].pop()
            count[level] -= 1
        else:
            number, pieces = self.new(), []
        pieces.append(piece)
        if level + size == w:
            self._emit(number, pieces)
            return
        self.open[level + size].append((number, pieces))
        count[level + size] += 1

    def drain(self, width: int) -> None:
        """width: bytes of an id."""
        rest = [p for level in self.open for _, pieces in level for p in pieces]
        self.open = [[] for _ in range(self.window + 1)]
        self.count[:] = 0
        left = sum(p[3] for p in rest)
        self.drained += left
        target, pieces, have = 0, [], 0
        for doc, start, tokens, length, crc, ids in rest:
            while length:
                target = target or (self.window if left >= self.window else 1 << (left.bit_length() - 1))
                n = min(length, target - have)
                part = ids[: n * width]
                pieces.append((doc, start, tokens, n, crc if n == length else id_crc(np.frombuffer(part, f"<u{width}")), part))
                ids, start, length, have = ids[n * width :], start + n, length - n, have + n
                crc = id_crc(np.frombuffer(ids, f"<u{width}")) if length else 0
                if have == target:
                    self._emit(self.new(), pieces)
                    left, target, pieces, have = left - target, 0, [], 0


def id_crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Each document's whole windows, without ids, and its remainder, with them."""
    own = encoder(path)
    width = 2 if len(own.ends_word) <= 1 << 16 and end_id < 1 << 16 else 4
    for batch in batches:
        for part in slices(batch, "_text"):
            ids, offsets = with_end(*own.encode(part.column("_text")), end_id)
            out = []
            for doc, a, b in zip(part.column("_id").to_pylist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
                n, whole = b - a, (b - a) // window * window
                out += [(doc, start, n, window, id_crc(ids[a + start : a + start + window]), None) for start in range(0, whole, window)]
                if whole < n:
                    rest = ids[a + whole : b]
                    out.append((doc, whole, n, n - whole, id_crc(rest), rest.astype(f"<u{width}").tobytes()))
            kinds = [*[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _REST.split(", ")])


def _packed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """A packer's pieces, the longest first: that leaves the fewest windows open at its end."""
    from pyspark import TaskContext

    packer, rest, names = Packer(window, TaskContext.get().partitionId() << 40), [], [x.split()[0] for x in SCHEMA.split(", ")]

    def gone() -> Iterator[pa.RecordBatch]:
        if packer.out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*packer.out, strict=True)], names)
            packer.out = []

    for batch in batches:
        for piece in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if piece[5] is None:
                packer.whole(piece)
            else:
                rest.append(piece)
        yield from gone()
    rest.sort(key=lambda p: (-p[3], p[0] is None, p[0] or 0, p[4], p[1]))
    for piece in rest:
        packer.place(piece)
    if rest:
        packer.drain(len(rest[0][5]) // rest[0][3])
    yield from gone()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents in windows of `window` tokens (a power of two): SCHEMA, a row per piece.

    A document's whole windows stand alone; remainders are dealt by hash, each with its ids, to packers of about
    PACKER_BYTES of text, so a packer's memory is bounded and its few windows left open are a small share at any size.
    Windows are numbered from packer << 40. Null or empty text is one piece of the end id. Rows that share an id, or a
    text, are packed each. A null id stays null. Other columns, of any name, are not read. No documents: no rows.
    """
    path, rows = path or tokenizer_path(), texts_of(docs, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0)).alias("n"), F.count("*").alias("m")).first()
    packers = max(1, -(-size["n"] // PACKER_BYTES), -(-size["m"] // PACKER_ROWS))
    pieces = rows.mapInArrow(lambda b: _pieces(b, path, window, end_id), _REST)
    return pieces.repartition(packers, F.xxhash64("doc_id", "ids_crc32", "start")).mapInArrow(lambda b: _packed(b, window), SCHEMA)


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
