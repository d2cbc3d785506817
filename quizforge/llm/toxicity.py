"""Toxicity by subword bags: character n-gram embeddings, averaged, into a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, LOWER, SPACE, flat, let_go, mix, slices, span_hashes, table, texts_of
from .common import STEP as FACTOR
from .labelled import held_out, sample

#: Labelled documents that are learned from, at most: not toxic, toxic.
SAMPLE = (4500, 1500)
#: Byte lengths of the n-grams, their buckets, embedding width.
GRAMS, BITS, WIDTH = (3, 4, 5, 6), 20, 4
STEPS, RATE, DECAY, SEED, FLOOR = 150, 1.0, 1e-6, 7, 0.1
#: Zero vectors that each average has beside the n-grams', so that a few unknown n-grams decide nothing.
PRIOR = 300
#: Memberships of n-grams in words summed at a time in training.
RUN = 1 << 21
#: Bytes of text scored at a time: its n-grams take some fifty times as much.
STEP = 1 << 18

_CLEAN = LOWER.copy()
_CLEAN[[b for b in range(128) if not (48 <= b <= 57 or 97 <= LOWER[b] <= 122)]] = 32


class Bags:
    """The distinct words of each text (letters, digits, bytes over 127) and their n-grams, with the space before and after."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        text = np.full(len(raw) + 2 * n + 8, 32, np.uint8)  # two spaces part the texts
        text[np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))] = _CLEAN[raw]
        self.text = text
        inside = ~SPACE[text]
        self.starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        self.ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.doc = np.repeat(np.arange(n), np.diff(np.searchsorted(self.starts, offsets + 2 * np.arange(n + 1))))
        self.docs = n
        with np.errstate(over="ignore"):
            key = mix(span_hashes(text, self.starts, self.ends) + self.doc.astype(np.uint64))
        own = np.sort(np.unique(key, return_index=True)[1])
        self.starts, self.ends, self.doc = self.starts[own], self.ends[own], self.doc[own]
        self.grams = sum(np.maximum(self.ends - self.starts + 3 - k, 0) for k in GRAMS)

    def buckets(self) -> Iterator[tuple[int, np.ndarray]]:
        with np.errstate(over="ignore"):
            code = BYTE_CODE[self.text]
            h = code
            for k in range(2, max(GRAMS) + 1):
                h = h[:-1] * FACTOR + code[k - 1 :]
                if k in GRAMS:
                    yield k, ((h * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) >> np.uint64(64 - BITS)).astype(np.int64)

    def totals(self, weight: np.ndarray) -> np.ndarray:
        """The sum of the weights of each word's n-grams."""
        total = np.zeros(len(self.starts))
        for k, bucket in self.buckets():
            upto = np.concatenate([[0.0], np.cumsum(weight[bucket], dtype=np.float64)])
            last = np.maximum(self.ends + 2 - k, self.starts - 1)
            total += upto[last] - upto[self.starts - 1]
        return total

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket) of each n-gram."""
        word, bucket = [], []
        for k, b in self.buckets():
            count = np.maximum(self.ends - self.starts + 3 - k, 0)
            at = np.repeat(self.starts - 1 - (np.cumsum(count) - count), count) + np.arange(count.sum())
            word.append(np.repeat(np.arange(len(count), dtype=np.int32), count))
            bucket.append(b[at].astype(np.int32))
            del at
        return np.concatenate(word), np.concatenate(bucket)


def train(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias): embeddings and the softmax layer learned together, by Adam on all texts.

    The score of a text is linear in the plain average of its n-grams' embeddings, so a text is a few shares of
    words and a word a few n-grams: both sums go over distinct words.
    """
    known: dict[bytes, int] = {}
    doc, word = [], []
    for i, t in enumerate(texts):
        found = set(t.encode().translate(_CLEAN.tobytes()).split())
        doc.append(np.full(len(found), i, np.int32))
        word.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found)))
    doc, word = np.concatenate(doc), np.concatenate(word)
    bags = Bags(*flat(pa.array(list(known), pa.binary())))
    share = 1 / (PRIOR + np.bincount(doc, bags.grams[word], len(texts)))[doc]
    member, gram = bags.members()
    words, docs, seen = len(known), len(texts), np.zeros(1 << BITS, bool)
    seen[gram] = True
    used = np.flatnonzero(seen)
    number = np.cumsum(seen, dtype=np.int32) - 1
    runs = [slice(i, i + RUN) for i in range(0, len(gram), RUN)]
    for run in runs:
        gram[run] = number[gram[run]]
    del bags, known, seen, number
    rng = np.random.default_rng(SEED)
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    state = [rng.normal(0, 0.1, (len(used), WIDTH)), rng.normal(0, 0.1, (WIDTH, 2)), np.array([bias])]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    for step in range(1, STEPS + 1):
        embed, layer, b = state
        side = layer[:, 1] - layer[:, 0]
        weight = embed @ side
        total = sum(np.bincount(member[run], weight[gram[run]], words) for run in runs)
        z = np.bincount(doc, share * total[word], docs)
        p = 1 / (1 + np.exp(-np.clip(z + b, -30, 30)))
        err = (p - y) / len(y)
        per_word = np.bincount(word, err[doc] * share, words)
        g = sum(np.bincount(gram[run], per_word[member[run]], len(used)) for run in runs)
        pull = g @ embed + DECAY * side
        grads = [g[:, None] * side + DECAY * embed / len(used), np.stack([-pull, pull], 1), np.array([err.sum()])]
        for x, d, m, v in zip(state, grads, first, second, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            root = np.sqrt(v / (1 - 0.99**step))
            x -= RATE * (m / (1 - 0.9**step)) / (root + FLOOR * root.max() + 1e-12)
    weight = np.zeros(1 << BITS, np.float32)
    weight[used] = state[0] @ (state[1][:, 1] - state[1][:, 0])
    return weight, float(state[2][0])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all batches; nothing without texts of both labels."""
    let_go()
    found = [b for b in batches if b.num_rows]
    sample_ = pa.Table.from_batches(found).sort_by("_id") if found else None
    y = sample_.column("y").to_numpy().astype(np.float64) if found else np.zeros(0)
    if len(set(y)) < 2:
        return
    texts = sample_.column("_text").to_pylist()
    del found, sample_
    weight, bias = train(texts, y)
    yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], ["weight", "bias"])
    del texts, weight
    let_go()


def scores(texts: pa.Array, model: tuple[np.ndarray, float] | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    bags = Bags(*flat(texts))
    z = np.bincount(bags.doc, bags.totals(model[0]), bags.docs) / (PRIOR + np.bincount(bags.doc, bags.grams, bags.docs))
    return 1 / (1 + np.exp(-np.clip(z + model[1], -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: Column | None = None) -> tuple[np.ndarray, float] | None:
    """Learn from at most SAMPLE labelled documents that are not held out, in one task; the driver gets the weights only.

    The bias is that of all labelled documents' odds, whatever the sample's.

    None, and scores of 0, without documents of both labels.
    """
    picked, shift = sample(texts_of(docs, id_col, text_col), labels, "toxic", held_out("_id", 5, 0) if out is None else out, SAMPLE)
    found = picked.coalesce(1).mapInArrow(_train, "weight binary, bias double").collect()
    return (np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"] + shift) if found else None


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document row: doc_id, held_out, score, predicted.

    A text is the plain average of the embeddings of its distinct words' n-grams, and of PRIOR zero vectors. Null or
    empty text, or text without words, is scored by the bias alone. No documents: no rows; no labels of both kinds: scores of 0.
    A null id is not held out. Rows that share an id are scored each. Other columns are not read.
    """
    model = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch, "_text", STEP):
                s = scores(part.column("_text"), model)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts_of(docs, id_col, text_col).withColumn("out", held_out("_id", 5, 0)).select("_id", "out", "_text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic.

    A null or empty text is judged by the bias. Rows that share an id, or a text, are judged each; columns of any name
    stay as they are. No documents: no rows; without labels of both kinds all stay.
    """
    model, schema = fit(docs, labels, id_col, text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch, text_col, STEP):
                yield part.filter(pa.array(scores(part.column(text_col), model) < 0.5))

    return docs.mapInArrow(run, schema)


def op7_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
