"""Quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from .common import Words, flat,  slices, table, texts_of
from .labelled import held_out, sample

#: Labelled documents that are learned from, at most: quality 0, quality 1.
SAMPLE = (6000, 9000)
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 80, 4, 64, 0.15, 10, 1.0

_MARKS = "!*$%&#|.,?;:-_<>{}=/\\\"'()@"
_CLASSES = np.zeros((256, 8 + len(_MARKS)))
_CLASSES[65:91, 0] = 1  # A-Z
_CLASSES[97:123, 1] = 1  # a-z
_CLASSES[48:58, 2] = 1  # digits
_CLASSES[32, 3] = 1
_CLASSES[10, 4] = 1
_CLASSES[128:192, 5] = 1  # bytes within a character
_CLASSES[192:, 6] = 1  # first bytes of a character
_CLASSES[[b for b in range(33, 127) if not chr(b).isalnum()], 7] = 1
for _i, _c in enumerate(_MARKS):
    _CLASSES[ord(_c), 8 + _i] = 1


def features(texts: pa.Array) -> np.ndarray:
    """A row of statistics for each text; an empty text has zeros."""
    raw, offsets = flat(texts)
    words = Words(raw, offsets)
    hashes, first = words.hashes(), words.first
    lengths, last = words.ends - words.starts, raw[words.ends - 1] if len(words.ends) else raw
    out = np.zeros((len(offsets) - 1, _CLASSES.shape[1] + 19))
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
        if a == b:
            continue
        text, (w0, w1) = raw[a:b], first[i : i + 2].tolist()
        count, n = np.bincount(text, minlength=256), w1 - w0
        p = count[count > 0] / (b - a)
        own = [np.log1p(b - a), -(p * np.log(p)).sum(), len(zlib.compress(text[: 1 << 20].tobytes(), 1)) / min(b - a, 1 << 20) if b - a <= 1 << 20 else np.mean([len(zlib.compress(text[k : k + (1 << 20)].tobytes(), 1)) / len(text[k : k + (1 << 20)]) for k in range(0, b - a, 1 << 20)])]
        if n:
            h, size, end = hashes[w0:w1], lengths[w0:w1], last[w0:w1]
            kinds, times = np.unique(h, return_counts=True)
            pairs = len(np.unique(h[:-1] * np.uint64(3) + h[1:])) / (n - 1) if n > 1 else 1.0
            own += [np.log1p(n), size.mean(), size.std(), (size <= 3).mean(), (size >= 12).mean(), len(kinds) / n, times.max() / n, (times[times > 1].sum()) / n, pairs, (h[1:] == h[:-1]).mean() if n > 1 else 0.0]
            own += [np.isin(end, [33, 35, 36, 37, 38, 42]).mean(), (end == 46).mean(), (end == 44).mean()]
        else:
            own += [0.0] * 13
        lines = text.tobytes().split(b"\n")
        own += [np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), sum(x.endswith((b".", b"?", b"!")) for x in lines) / len(lines)]
        out[i] = np.concatenate([count @ _CLASSES / (b - a), own])
    return out


class Trees:
    """Perfect binary trees as arrays: node i has children 2i + 1 and 2i + 2; a node that isn't split sends all left."""

    def __init__(self, feature: np.ndarray, edge: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.edge, self.leaf, self.base = feature, edge, leaf, base

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, e, v in zip(self.feature, self.edge, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > e[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost logistic loss: each level's splits come from histograms of gradients over quantile bins."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T, strict=True)], 1)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    inner, total = (1 << DEPTH) - 1, np.full(n, base)
    feature, edge, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    column = np.arange(width) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * (width * BINS) + column + code).ravel()
            shape = (many, width, BINS)
            gs, hs, cs = (np.bincount(key, np.repeat(v, width), many * width * BINS).reshape(shape).cumsum(2) for v in (g, h, np.ones(n)))
            gt, ht, ct = gs[:, :, -1:], hs[:, :, -1:], cs[:, :, -1:]
            gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(cs < LEAST) | (ct - cs < LEAST)] = 0
            best = gain.reshape(many, -1).argmax(1)
            for k in np.flatnonzero(gain.reshape(many, -1).max(1) > 1e-6):
                f, bin_ = divmod(int(best[k]), BINS)
                feature[t, first + k], edge[t, first + k] = f, cuts[f][bin_]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > edge[t, node])
        gl, hl = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        leaf[t] = -RATE * gl / (hl + RIDGE)
        total += leaf[t, node - inner]
    return Trees(feature, edge, leaf, base)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: Column | None = None) -> Trees | None:
    """Learn from the statistics of at most SAMPLE labelled documents that are not held out. None without both labels."""
    picked, shift = sample(texts_of(docs, id_col, text_col), labels, "quality", held_out("_id", 3, 1) if out is None else out, SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("y"), pa.array(list(features(part.column("_text"))), pa.list_(pa.float64()))], ["_id", "y", "x"])

    found = picked.mapInArrow(run, "_id long, y int, x array<double>").toPandas().sort_values("_id")
    y = found["y"].to_numpy(np.float64)
    if len(set(y)) < 2:
        return None
    trees = train(np.stack(found["x"].tolist()), y)
    trees.base += shift  # the odds of all labelled documents, whatever the sample's
    return trees


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document row: doc_id, held_out, score, predicted.

    Only statistics of the text are inputs. Null text is empty; an empty text has zero statistics and is scored
    by them. Without labels of both kinds every score is 0. A null id is not held out. Rows that share an id
    are scored each. Other columns are not read. No documents: no rows.
    """
    trees = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                s = trees.score(features(part.column("_text"))) if trees else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts_of(docs, id_col, text_col).withColumn("out", held_out("_id", 3, 1)).select("_id", "out", "_text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
