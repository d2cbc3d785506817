"""Language-model scores by prediction by partial matching over bytes, beside a smoothed word unigram base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, Words, flat, let_go, materialize, mix, partitions, rows_of, slices, table
from .labelled import held_out

#: Bytes of the longest context.
ORDER = 5
#: Bytes of text that meet the probabilities of their n-grams at a time.
CHUNK_BYTES = 8 * STEP_BYTES
#: Distinct n-grams of the longest order in a chunk, about.
CHUNK_KEYS = 4_000_000
#: Parts of the trie for each shuffle partition.
PARTS = 4
#: Numbers in a row, at most, where n-grams are dealt by part.
PACK = 500
GRAMS, WORDS, PAIRS, TEXTS = range(4)
COLUMNS = ["kind", "chunk", "part", "keys", "n", "_row", "_id", "_text", "out"]
#: Distinct training words up to which their counts are broadcast (48 MB); beyond, they are joined.
BROADCAST_WORDS = 4_000_000
#: The symbol before and after each text.
END = 256
_END_WORD = np.uint64(0x5851F42D4C957F2D)


def _symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of ORDER + 1 symbols, 9 bits each, ending at each byte and each text's end, and texts' offsets in them."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    s = np.full(len(raw) + n * (ORDER + 1), END, np.int64)
    s[np.arange(len(raw)) + np.repeat(ORDER + np.arange(n) * (ORDER + 1), sizes)] = raw
    keys = np.zeros(len(s) - ORDER if len(s) else 0, np.int64)
    for i in range(ORDER + 1):
        keys = (keys << 9) | s[i : len(s) - ORDER + i]
    wanted = np.ones(len(keys), bool)
    ends = offsets[1:-1] + np.arange(n - 1) * (ORDER + 1) + 1  # the first key after each text but the last
    for i in range(ORDER):  # keys that end in the next text's leading symbols
        wanted[ends + i] = False
    return keys[wanted], offsets + np.arange(n + 1)


def _merged(have: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip(*have, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values of 8 bytes a number, cut at edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(packs: pa.Array, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all packs, and where each begins."""
    raw, offsets = flat(packs)
    return np.frombuffer(raw.tobytes(), kind), offsets // 8


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The trie's part of each key: a hash of the two symbols before the last."""
    return (mix(((keys >> 9) & ((1 << 18) - 1)).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """All rows of a task by chunk: TEXTS as they are, GRAMS all n-grams of the longest order, by part of the trie, PAIRS and
    WORDS (with ends) of training texts.

    n counts training texts alone, so an n-gram of held-out texts only has 0. A chunk ends after CHUNK_BYTES or CHUNK_KEYS.
    """
    let_go()
    have: dict[int, list] = {GRAMS: [], WORDS: []}
    chunk, size = TaskContext.get().partitionId() << 33, 0

    def packs(kind: int, keys: np.ndarray, n: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        within = np.arange(len(keys)) - np.repeat(start, np.diff(start, append=len(keys)))
        first = np.flatnonzero(within % PACK == 0)
        for at in range(0, len(first), 200):
            edges = np.append(first[at : at + 200], first[at + 200] if at + 200 < len(first) else len(keys))
            m, here = len(edges) - 1, slice(edges[0], edges[-1])
            nulls = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.bool_())]
            values = [_packed(x[here].astype(np.int64), edges - edges[0]) for x in (keys, n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), pa.array(np.full(m, chunk)), pa.array(part[edges[:-1]]), *values, *nulls], COLUMNS)

    def done() -> Iterator[pa.RecordBatch]:
        for kind in (GRAMS, WORDS):
            if have[kind]:
                keys, n = _merged(have[kind])
                have[kind] = []
                if kind == WORDS:
                    yield from packs(WORDS, keys, n, np.zeros(len(keys), np.int64))
                    continue
                if (n > 0).any():
                    two = _merged([(keys[n > 0] & ((1 << 18) - 1), n[n > 0])])
                    yield from packs(PAIRS, *two, np.zeros(len(two[0]), np.int64))
                part = _part(keys, parts)
                order = np.argsort(part, kind="stable")
                yield from packs(GRAMS, keys[order], n[order], part[order])

    for batch in batches:
        for part in slices(batch, "_text", STEP_BYTES >> 2):
            m = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, TEXTS, np.int8)), pa.array(np.full(m, chunk)), *(pa.nulls(m, t) for t in (pa.int64(), pa.binary(), pa.binary())), *(part.column(c) for c in COLUMNS[5:])], COLUMNS)
            for held in (False, True):
                own = part.filter(pc.equal(part.column("out"), held))
                if not own.num_rows:
                    continue
                raw, offsets = flat(own.column("_text"))
                size += len(raw)
                keys, n = np.unique(_symbols(raw, offsets)[0], return_counts=True)
                have[GRAMS].append((keys, np.zeros_like(n) if held else n))
                if not held:
                    words, n = np.unique(Words(raw, offsets, lower=True).hashes(), return_counts=True)
                    have[WORDS].append((np.append(words, _END_WORD).view(np.int64), np.append(n, len(offsets) - 1)))
            for kind in (GRAMS, WORDS):
                if sum(len(x[0]) for x in have[kind][1:]) > 1_000_000:
                    have[kind] = [_merged(have[kind])]
            if size >= CHUNK_BYTES or len(have[GRAMS][0][0]) >= CHUNK_KEYS:
                yield from done()
                chunk, size = chunk + 1, 0
    yield from done()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_numbers(batch.column(c))[0]) for c in ("keys", "n")], ["key", "n"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(part, its rows) of a batch in order of parts."""
    of = batch.column("part").to_numpy()
    edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if end > start:
            yield int(of[start]), batch.slice(start, end - start)


class Trie:
    """Contexts of each order as sorted arrays, with escape estimation (method D) and symbol exclusion.

    A symbol seen after a longer context is seen after its suffix, so on escape from a context the symbols
    seen there are excluded from the next order: what remains there is a number of the longer context.
    """

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        """grams[k]: sorted keys of k + 1 symbols (context, then symbol) and their counts."""
        self.grams, self.contexts = grams, []
        for k, (keys, n) in enumerate(grams):
            context = keys >> 9
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(n.astype(np.float64), first) if len(first) else np.zeros(0)
            kinds = np.diff(first, append=len(keys)).astype(np.float32)
            rest_total, rest_kinds = np.zeros(len(first)), np.zeros(len(first), np.float32)
            if k and len(first):
                low, low_n = grams[k - 1]
                _, low_total, low_kinds, *_ = self.contexts[k - 1]
                suffix = np.searchsorted(self.contexts[k - 1][0], context[first] & ((1 << 9 * (k - 1)) - 1))
                below = low_n[np.searchsorted(low, keys & ((1 << 9 * k) - 1))]
                rest_total = low_total[suffix] - np.add.reduceat(below.astype(np.float64), first)
                rest_kinds = low_kinds[suffix] - kinds
            self.contexts.append((context[first], total, kinds, rest_total, rest_kinds))

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last symbol of each key after the ones before it."""
        out = np.zeros(len(keys))
        open_, above = np.arange(len(keys)), np.full(len(keys), -1)
        for k in range(len(self.grams) - 1, -1, -1):
            context, total, kinds, _, _ = self.contexts[k]
            own = keys[open_] & ((1 << 9 * (k + 1)) - 1)
            at = self._find(context, own >> 9)
            t, d = total[at] if len(total) else np.zeros(len(at)), kinds[at] if len(kinds) else np.zeros(len(at))
            if k + 1 < len(self.grams) and len(self.contexts[k + 1][0]):
                up = above[open_]
                t, d = np.where(up >= 0, self.contexts[k + 1][3][up], t), np.where(up >= 0, self.contexts[k + 1][4][up], d)
            gram = self._find(self.grams[k][0], own)
            hit = gram >= 0
            if hit.any():
                out[open_[hit]] += np.log10((self.grams[k][1][gram[hit]] - 0.5) / t[hit])
            left = ~hit & (at >= 0) & (d > 0)
            out[open_[left]] += np.log10(0.5 * d[left] / t[left])
            above[open_] = at
            open_ = open_[~hit]
        seen = self.contexts[0][2][0] if len(self.contexts[0][2]) else 0
        out[open_] -= np.log10(END + 1 - seen)
        return out


def logs(grams: DataFrame, pairs: DataFrame) -> DataFrame:
    """(part, keys, logs): the log10 probability of each distinct key of grams (part, keys, n), all of whose n-grams count.

    The n-grams of three symbols and more that a key's probability takes share the two symbols before its last, so
    the trie is built and asked in parts by these. What is shorter, at most 257 * 257 n-grams, goes to all parts.
    """
    spark = grams.sparkSession
    found = pairs.toArrow().sort_by("key")
    two = spark.sparkContext.broadcast((found.column("key").to_numpy(), found.column("n").to_numpy()))

    def answers(part: int, have: list) -> pa.RecordBatch:
        keys, n = _merged(have)
        grams = [(keys[n > 0], n[n > 0])]
        for k in range(ORDER, 2, -1):
            low = (grams[-1][0] & ((1 << 9 * k) - 1), grams[-1][1])
            grams.append(_merged([low]) if len(low[0]) else low)
        low = (two.value[0] & 511, two.value[1])
        grams += [two.value, _merged([low]) if len(low[0]) else low]
        edges = np.append(np.arange(0, len(keys), PACK), len(keys))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(edges) - 1, part)), _packed(keys, edges), _packed(Trie(grams[::-1]).log10(keys), edges)], ["part", "keys", "logs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        part, have = None, []
        for batch in batches:
            for at, own in _runs(batch):
                if have and at != part:
                    yield answers(part, have)
                    have = []
                part = at
                have.append(tuple(_numbers(own.column(c))[0] for c in ("keys", "n")))
                if len(have) > 1:
                    have = [_merged(have)]
        if have:
            yield answers(part, have)

    return grams.repartition(partitions(spark), "part").sortWithinPartitions("part").mapInArrow(run, "part long, keys binary, logs binary")


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, keys, logs) of each chunk's packs; those of the trie come first in each part, without a chunk."""
    let_go()
    part, have, known = None, [], None
    for batch in batches:
        for at, own in _runs(batch):
            if at != part:
                part, have, known = at, [], None
            model = own.filter(pc.is_null(own.column("chunk")))
            if model.num_rows:
                have.append((_numbers(model.column("keys"))[0], _numbers(model.column("logs"), np.float64)[0]))
            own = own.filter(pc.is_valid(own.column("chunk")))
            if not own.num_rows:
                continue
            if known is None:
                keys, log = (np.concatenate(x) for x in zip(*have, strict=True))
                order = np.argsort(keys)
                have, known = [], (keys[order], log[order])
            keys, edges = _numbers(own.column("keys"))
            yield pa.RecordBatch.from_arrays([own.column("chunk"), own.column("keys"), _packed(known[1][np.searchsorted(known[0], keys)], edges)], ["chunk", "keys", "logs"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """A row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    score is the trie's log10 probability of the text's bytes and its end. Null text is empty: one token, the
    end. A null id is not held out, so learned from. Rows that share an id are learned from and scored each.
    Without training rows bytes are uniform. Other columns are not read. No documents: no rows.
    """
    spark = docs.sparkSession
    rows = rows_of(docs, id_col, text_col, once=True).withColumn("out", held_out("_id", 5, 1))
    parts = PARTS * partitions(spark)
    counts = materialize(rows.select(*COLUMNS[5:]).mapInArrow(lambda b: _counts(b, parts), "kind byte, chunk long, part long, keys binary, n binary, _row long, _id long, _text string, out boolean"), "op5-counts")
    summed = [counts.where(F.col("kind") == k).select("keys", "n").mapInArrow(_unpacked, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")) for k in (PAIRS, WORDS)]
    grams, words = counts.where(F.col("kind") == GRAMS), materialize(summed[1], "op5-words")
    nodes = materialize(logs(grams.select("part", "keys", "n"), summed[0]), "op5-nodes")
    asked = nodes.select(F.lit(None).cast("long").alias("chunk"), "part", "keys", "logs").union(grams.select("chunk", "part", "keys", F.lit(None).cast("binary")))
    answered = asked.repartition(partitions(spark), "part").sortWithinPartitions("part", F.asc_nulls_first("chunk")).mapInArrow(_answered, "chunk long, keys binary, logs binary")
    texts = counts.where(F.col("kind") == TEXTS).select("chunk", *COLUMNS[5:])
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, scale = total["n"], np.log10(total["n"] + 0.5 * (total["v"] + 1))
    small = total["v"] <= broadcast_words
    known = None
    if small:
        found = words.select("key", "n").toArrow()
        keys, c = found.column("key").to_numpy(), found.column("n").to_numpy()
        del found
        order = np.argsort(keys)
        known = spark.sparkContext.broadcast((keys[order], c[order].astype(np.uint32 if len(c) and c.max() < 1 << 32 else np.int64)))
        del keys, c, order
    fields = ["_row", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "words", "times"]

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        let_go()
        own, log = (np.concatenate([_numbers(x, kind)[0] for x in found.column(c).chunks]) for c, kind in (("keys", np.int64), ("logs", np.float64)))
        order = np.argsort(own)
        own, log = own[order], log[order]
        out = []
        for batch in texts.combine_chunks().to_batches():
            for part in slices(batch, "_text", STEP_BYTES >> 2):
                raw, offsets = flat(part.column("_text"))
                docs_, (keys, edges) = part.num_rows, _symbols(raw, offsets)
                kinds, at = np.unique(keys, return_inverse=True)
                sums = np.add.reduceat(log[np.searchsorted(own, kinds)][at], edges[:-1])
                view = Words(raw, offsets, lower=True)
                tokens = np.diff(view.first) + 1
                owner = np.concatenate([np.repeat(np.arange(docs_), tokens - 1), np.arange(docs_)])
                token = np.concatenate([view.hashes(), np.full(docs_, _END_WORD)]).view(np.int64)
                base, met, lists, times = np.zeros(docs_), np.zeros(docs_, np.int64), pa.nulls(docs_, pa.list_(pa.int64())), pa.nulls(docs_, pa.list_(pa.int64()))
                if small:
                    unique, back = np.unique(token, return_inverse=True)
                    place = Trie._find(known.value[0], unique)
                    c = np.where(place >= 0, known.value[1][place], 0).astype(np.int64)[back] if len(known.value[0]) else np.zeros(len(token), np.int64)
                    base, met = np.bincount(owner, np.log10(c + 0.5) - scale, docs_), np.bincount(owner, c > 0, docs_).astype(np.int64)
                else:
                    order = np.lexsort((token, owner))
                    o, t = owner[order], token[order]
                    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])]))
                    ends = pa.array(np.searchsorted(o[first], np.arange(docs_ + 1)).astype(np.int32))
                    lists, times = pa.ListArray.from_arrays(ends, pa.array(t[first])), pa.ListArray.from_arrays(ends, pa.array(np.diff(first, append=len(t))))
                out.append(pa.RecordBatch.from_arrays([part.column("_row"), part.column("_id"), part.column("out"), pa.array(tokens.astype(np.int64)), pa.array(met), pa.array(np.full(docs_, n, np.int64)), pa.array(base), pa.array(sums), lists, times], fields))
        return pa.Table.from_batches(out)

    schema = "_row long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, words array<long>, times array<long>"
    out = texts.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(run, schema)
    if small:
        return out.drop("_row", "words", "times")
    out = materialize(out, "op5-scores")
    each = out.select("_row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("_row", F.col("x.words").alias("key"), F.col("x.times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    sums = each.join(words.select("key", "n"), "key", "left").groupBy("_row").agg(F.sum(F.col("times") * (F.log10(c + 0.5) - float(scale))).alias("base_score"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"))
    return out.drop("words", "times", "base_score", "n_known").join(sums, "_row").select(*fields[1:8])


def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
