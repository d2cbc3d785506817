"""8-bit samples in Ogg bitstreams: pages, lacing, checksums, multiplexed logical streams, granule positions."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import flat, slices, table, texts_of

#: Samples of a packet; payloads are filled with bytes 255 up to a positive multiple of it.
FRAME = 576
#: Samples in a second.
RATE = 8000
#: Logical streams of a file: frames are dealt to them in turn.
STREAMS = 2
# Fixed values of the Ogg page format (RFC 3533).
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
_PAGE = struct.Struct("<4sBBqIIIB")
_HEADER = struct.Struct("<8sBBIIQ")
_MAGIC = b"PCM8U\0\0\0"
_REVERSE = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 0x04C11DB7, highest bit first, from 0) by zlib's, which takes the lowest first."""
    back = zlib.crc32(page.translate(_REVERSE), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(back.to_bytes(4, "little").translate(_REVERSE), "big")


class Writer:
    """One logical stream to pages; a packet's lacing values are its length in 255s and the rest below 255."""

    def __init__(self, serial: int):
        self.serial, self.number = serial, 0
        self.lacing, self.parts, self.granule, self.open = bytearray(), [], -1, False

    def _page(self, last: bool) -> bytes:
        flags = (CONTINUED if self.open else 0) | (0 if self.number else FIRST) | (LAST if last else 0)
        body = b"".join(self.parts)
        head = _PAGE.pack(CAPTURE, 0, flags, self.granule, self.serial, self.number, 0, len(self.lacing))
        page = head + bytes(self.lacing) + body
        out = page[:22] + struct.pack("<I", page_crc(page)) + page[26:]
        self.open = bool(self.lacing) and self.lacing[-1] == 255
        self.number, self.lacing, self.parts, self.granule = self.number + 1, bytearray(), [], -1
        return out

    def packet(self, data: bytes, granule: int) -> Iterator[bytes]:
        """Add a packet that ends at the granule position; yields the pages that are full."""
        laces = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        while laces:
            if len(self.lacing) == 255:
                yield self._page(False)
            now, laces = laces[: 255 - len(self.lacing)], laces[255 - len(self.lacing) :]
            size = sum(now)
            self.lacing += now
            self.parts.append(data[at : at + size])
            at += size
        self.granule = granule

    def flush(self, last: bool = False) -> bytes:
        return self._page(last)


def write(payload: bytes, frame: int = FRAME, rate: int = RATE, streams: int = STREAMS) -> bytes:
    """Samples to a multiplexed file: first pages with a header packet each, then the frames' pages in turn."""
    key = zlib.crc32(payload)
    writers = [Writer((key + k) & 0xFFFFFFFF) for k in range(streams)]
    out = []
    for k, w in enumerate(writers):
        for page in w.packet(_HEADER.pack(_MAGIC, k, streams, frame, rate, len(payload)), 0):
            out.append(page)
        out.append(w.flush())
    for i, at in enumerate(range(0, len(payload), frame)):
        data = payload[at : at + frame]
        out += writers[i % streams].packet(data, at + len(data))
    out += [w.flush(True) for w in writers]
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    #: (packets finished so far, granule position) of each page on which one ends.
    marks: list[tuple[int, int]] = field(default_factory=list)
    part: list[bytes] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number. Raises ValueError where a page is broken, missing or out of turn."""
    found: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _PAGE.size:
            raise ValueError(f"short page at {at}")
        capture, version, flags, granule, serial, number, crc, n = _PAGE.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if capture != CAPTURE or version or len(lacing) < n or end > len(data):
            raise ValueError(f"no whole page at {at}")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at {at}")
        if bool(flags & FIRST) != (serial not in found):
            raise ValueError(f"first page of stream {serial}")
        s = found.setdefault(serial, Stream())
        if number != s.pages or s.ended or bool(flags & CONTINUED) != bool(s.part):
            raise ValueError(f"page {number} of stream {serial} out of turn")
        s.pages, s.ended = s.pages + 1, bool(flags & LAST)
        at += 27 + n
        size = done = 0
        for lace in lacing:
            size += lace
            if lace < 255:
                s.part.append(data[at : at + size])
                s.packets.append(b"".join(s.part))
                s.part, at, size, done = [], at + size, 0, 1
        if size:
            s.part.append(data[at : at + size])
            at += size
        if done:
            s.marks.append((len(s.packets), granule))
    if any(s.part or not s.ended for s in found.values()):
        raise ValueError("a stream has no end")
    return found


def read(data: bytes) -> tuple[bytes, dict[int, Stream], np.ndarray, int]:
    """(payload, streams, end time of each frame in samples, rate): frames of all streams in order of time."""
    found = demultiplex(data)
    heads = {serial: _HEADER.unpack(s.packets[0]) for serial, s in found.items()}
    order = sorted(found, key=lambda serial: heads[serial][1])
    _, _, streams, frame, rate, total = heads[order[0]]
    if any(h[0] != _MAGIC for h in heads.values()) or len(order) != streams:
        raise ValueError("headers")
    frames: list[tuple[int, bytes]] = []
    for k, serial in enumerate(order):
        s = found[serial]
        # a page's position is its last packet's; those before end whole turns earlier
        upto = 0
        for done, granule in s.marks:
            last = s.packets[done - 1]
            begin = granule - len(last)
            frames += [(granule if i == done - 1 else begin - (done - 1 - i) * frame * streams + frame, s.packets[i]) for i in range(max(upto, 1), done)]
            upto = done
    frames.sort(key=lambda x: x[0])
    payload = b"".join(x for _, x in frames)
    ends = np.fromiter((t for t, _ in frames), np.int64, len(frames))
    if len(payload) != total or (np.cumsum([len(x) for _, x in frames]) != ends).any():
        raise ValueError("granule positions do not fit the samples")
    return payload, found, ends, rate


def feature(payload: bytes, streams: dict[int, Stream], ends: np.ndarray, rate: int) -> str:
    """Length in seconds, pages, mean and RMS of the signed samples, crossings of zero, and the loudest frame's time."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    square = np.add.reduceat(x * x, np.concatenate([[0], ends[:-1]]))
    cross = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    loud = int(ends[int(np.argmax(square))])
    return f"s={ends[-1] / rate:.4f};pages={sum(s.pages for s in streams.values())};mean={x.mean():.6f};rms={(square.sum() / len(x)) ** 0.5:.6f};zc={cross};loud={loud / rate:.4f}"


def pad(raw: bytes, frame: int = FRAME) -> bytes:
    return raw + b"\xff" * (max(1, -(-len(raw) // frame)) * frame - len(raw))


def media_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document row: doc_id, n_bytes, media (the Ogg file).

    Null or empty text is one frame of bytes 255. Equal texts give equal files, as the serial numbers come from the
    payload. A null id stays null; rows that share an id are stored each. Other columns are not read. No documents: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                raw, offsets = flat(part.column("_text"))
                media = [write(pad(raw[a:b].tobytes())) for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(files: DataFrame) -> DataFrame:
    """A row per row of files (doc_id, n_bytes, media): doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    All but n_bytes come from the file, which is read and checked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                out = []
                for media in part.column("media").to_pylist():
                    payload, streams, ends, rate = read(media)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, streams, ends, rate)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array([x[i] for x in out], t) for i, t in enumerate(kinds))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The features of each document row's file."""
    return media_features(media_files(docs, id_col, text_col))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
