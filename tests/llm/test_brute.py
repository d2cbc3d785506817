"""Operators against brute force, exact round trips and held-out accuracy on the small tables."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from quizforge.llm import ans, blocks, decontaminate, jaccard, ogg, packing, ppm, quality, suffix, toxicity
from quizforge.llm.tokens import Encoder, tokenizer_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t) if w]


def test_suffix(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    got = {r["doc_id"]: r for r in suffix.op1_suffix_array_dedup(spark, SF).collect()}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        assert (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()) == tuple(got[k][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def test_collections(tmp_path):
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 5))
        own = [rng.integers(0, 4, int(rng.integers(0, 25))).astype(np.uint8) for _ in range(int(rng.integers(1, 12)))]
        a, b = suffix.repeated(own, n, str(tmp_path), 32)
        seen = Counter(t[i : i + n].tobytes() for t in own for i in range(len(t) - n + 1))
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((k, i) for k, t in enumerate(own) for i in range(len(t) - n + 1) if seen[t[i : i + n].tobytes()] > 1)
    assert not list(tmp_path.iterdir())  # the columns' files are gone


def test_columns_are_files(tmp_path):
    x = suffix.Column(str(tmp_path), "x", suffix.SPILL)
    for n in (10, suffix.SPILL, 3 * suffix.READ, 4 * suffix.READ):
        values = np.arange(n, dtype=np.uint16)
        x.write(values)
        assert (x.read() == values).all()
        assert len(list(tmp_path.iterdir())) == (values.nbytes > suffix.SPILL)
    x.close()
    assert not list(tmp_path.iterdir())


def test_part_digests():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    raw[3000:3400] = raw[100:500]
    lo, size = np.array([100, 3000, 100, 101]), np.array([400, 400, 399, 400])
    large, small = suffix.part_digests(raw, lo, size)
    for k, (a, n) in enumerate(zip(lo.tolist(), size.tolist(), strict=True)):
        for base, modulus, got in zip(suffix._BASES, (suffix._LARGE, suffix._SMALL), (large[k], small[k]), strict=True):
            assert int(got) == sum((int(x) + 1) * pow(base, i, modulus) for i, x in enumerate(raw[a : a + n])) % modulus
    assert large[0] == large[1] and len(set(large.tolist())) == 3


def test_hot_anchor_is_split(spark, texts, monkeypatch):
    want = {tuple(r) for r in suffix.op1_suffix_array_dedup(spark, SF).collect()}
    monkeypatch.setattr(suffix, "COLLECTION", 2)
    monkeypatch.setattr(suffix, "SPILL", 64)
    assert {tuple(r) for r in suffix.op1_suffix_array_dedup(spark, SF).collect()} == want


def test_blocks(spark, texts):
    ws, least = {i: t.encode().split() for i, t in texts.items()}, {}
    for i in sorted(ws, reverse=True):
        least |= {tuple(ws[i][k : k + 13]): i for k in range(len(ws[i]) - 12)}
    got = {r["doc_id"]: r for r in blocks.op6_fixed_block_dedup(spark, SF).collect()}
    for i, w in ws.items():
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (len(w), sum(gone), hashlib.sha256(kept).hexdigest()) == tuple(got[i][c] for c in ("n_words", "n_removed", "kept_sha256"))


@pytest.mark.parametrize(("shingle", "num", "small"), [(3, 90, False), (5, 80, True)])
def test_jaccard(spark, tmp_path, monkeypatch, shingle, num, small):
    if small:  # blocks and pair keys for all
        monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 5)
        monkeypatch.setattr(jaccard, "RARE", 2)
    rng = np.random.default_rng(num)
    vocabulary, rows = [f"w{i}" for i in range(2000)] + ["the", "of", "and"] * 300, []
    hot = list(rng.choice(vocabulary, 40))
    for g in range(30):
        base = list(rng.choice(vocabulary, int(rng.choice([3, 9, 10, 12, 25, 60, 200])))) + hot * (g % 3 == 0)
        for _ in range(int(rng.choice([1, 2, 4, 15]))):
            w = list(base)
            for _ in range(int(rng.choice([0, 1, 2, 4]))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(w)))
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(spark.read.parquet(path), shingle=shingle, num=num).collect()}
    sets = {}
    for i, t in rows:
        w = words(t)
        k = min(shingle, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= num * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert {i: got[i]["component_id"] for i in sets} == root
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_sample_keeps_the_odds(spark, monkeypatch, module, label):
    docs = spark.createDataFrame([(i, "the same words in each text") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], f"doc_id long, {label} int")
    run = getattr(module, "quality" if label == "quality" else "toxicity")
    for each in ((30, 30), (1000, 1000), (50, 20)):
        monkeypatch.setattr(module, "SAMPLE", each)
        assert all(abs(r["score"] - 0.1) < 0.04 for r in run(docs, labels).collect())


def test_ppm(spark, texts):
    got = ppm.op5_ppm_score(spark, SF).collect()
    other = {r["doc_id"]: r for r in ppm.score(spark.read.parquet(f"{SF}/documents.parquet"), broadcast_words=0).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for i, t in texts.items()}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in got:
        ws = tokens[r["doc_id"]]
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        for x in (r, other[r["doc_id"]]):
            assert (x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(c[w] > 0 for w in ws), n)
            assert abs(x["base_score"] - base) < 1e-6 * abs(base) and abs(x["score"] - r["score"]) < 1e-6 * abs(r["score"])


def test_ppm_keeps_rare_ngrams(spark, monkeypatch):
    monkeypatch.setattr(ppm, "NODES", 100, raising=False)  # no cap on the model may change a score
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 200, raising=False)
    rng = random.Random(3)
    own = {i: "".join(rng.choice("abcd e\u00e9") for _ in range(rng.randrange(60))) for i in range(60)} | {60: "", 61: "zebra quiz"}
    spans = {i: [256] * ppm.ORDER + [*t.encode(), 256] for i, t in own.items()}
    seen: dict = {}
    for i, s in spans.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for at in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    seen.setdefault(tuple(s[at - k : at]), Counter())[s[at]] += 1

    def log10(context, symbol):
        total, gone = 0.0, set()
        for k in range(ppm.ORDER, -1, -1):
            left = {x: n for x, n in seen.get(tuple(context[ppm.ORDER - k :]), {}).items() if x not in gone}
            if symbol in left:
                return total + np.log10((left[symbol] - 0.5) / sum(left.values()))
            if left:
                total += np.log10(0.5 * len(left) / sum(left.values()))
            gone |= set(left)
        return total - np.log10(257 - len(gone))

    docs = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs).collect()}
    assert set(got) == set(own)
    for i, s in spans.items():
        assert abs(got[i] - sum(log10(s[at - ppm.ORDER : at], s[at]) for at in range(ppm.ORDER, len(s)))) < 1e-6


def test_trie_sums_to_one():
    keys = np.sort(np.unique(np.random.default_rng(1).integers(97, 101, (400, ppm.ORDER + 1)) @ (512 ** np.arange(ppm.ORDER, -1, -1))))
    grams = [(keys, np.arange(1, len(keys) + 1))]
    for k in range(ppm.ORDER, 0, -1):
        low, back = np.unique(grams[-1][0] & ((1 << 9 * k) - 1), return_inverse=True)
        grams.append((low, np.bincount(back, grams[-1][1]).astype(np.int64)))
    trie = ppm.Trie(grams[::-1])
    for context in (keys[0] >> 9, keys[7] >> 9, 0):
        assert abs((10 ** trie.log10((context << 9) + np.arange(257))).sum() - 1) < 1e-9


def test_token_ids_and_packing(spark, texts):
    own, at = Encoder(tokenizer_path()), 0
    ids = {}
    for i in sorted(texts):
        x = np.array([*own.tokenizer.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        ids[i], at = (at, x), at + len(x)
    for r in ans.op9_rans_token_ids(spark, SF).collect():
        start, x = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(x), zlib.crc32(x.tobytes()))
    got: dict = {}
    for r in packing.op10_sum_of_squares_packing(spark, SF).collect():
        x = ids[r["doc_id"]][1]
        assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, (_, x) in ids.items():
        ends = 0
        for start, length in sorted(got[i]):
            assert start == ends
            ends += length
        assert ends == len(x)


def test_rans_checks():
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.3, 300_000).clip(0, 40_000).astype(np.uint32)
    coder = ans.Coder(ans.shares(np.bincount(ids)))
    data = ans.write_chunk(np.array([3, 4]), np.array([100_000, 200_000]), ids, coder, np.array([False, True]), 5, 77)
    chunk = ans.Chunk(data, ans.Coder.of(coder.table()))
    assert (chunk.ids() == ids).all() and chunk.docs.tolist() == [3, 4] and chunk.lengths.tolist() == [100_000, 200_000]
    assert (chunk.nulls.tolist(), chunk.part, chunk.base) == ([False, True], 5, 77)
    for a, b in ((0, 5), (131_071, 131_073), (131_072, 262_144), (299_999, 300_000), (7, 7), (250_000, 400_000)):
        assert (chunk.ids(a, b) == ids[a:b]).all()
    broken = bytearray(data)
    broken[-5] ^= 1
    torn = ans.Chunk(bytes(broken), coder)
    assert (torn.ids(0, 100) == ids[:100]).all()  # another block
    with pytest.raises(ValueError):
        torn.ids()
    with pytest.raises(ValueError):
        ans.Chunk(data, ans.Coder(ans.shares(np.bincount(ids[:1000]))))


def test_token_files_are_read_elsewhere(spark, texts, tmp_path):
    want = {tuple(r) for r in ans.token_ids(spark.read.parquet(f"{SF}/documents.parquet"), out=str(tmp_path / "ids")).collect()}
    code = """
import sys, zlib, numpy as np, pyarrow.parquet as pq
from quizforge.llm import ans
out = sys.argv[1]
coder = ans.Coder.of(pq.read_table(out + "/table")["data"][0].as_py())
for data in pq.read_table(out + "/chunks")["data"].to_pylist():
    chunk = ans.Chunk(data, coder)
    ends = np.cumsum(chunk.lengths.astype(int))
    for doc, n, end in zip(chunk.docs.tolist(), chunk.lengths.tolist(), ends.tolist()):
        print(doc, n, zlib.crc32(chunk.ids(end - n, end).astype("<u4").tobytes()))
"""
    got = subprocess.run([sys.executable, "-c", code, str(tmp_path / "ids")], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout
    assert {tuple(map(int, x.split())) for x in got.splitlines()} == {(d, n, c) for d, _, n, c in want}


def test_packer_places_by_squares():
    rng, w = np.random.default_rng(4), 32
    sizes = rng.integers(1, w, 400).tolist()
    p, open_, full = packing.Packer(w, 0), [], 0
    for i, n in enumerate(sizes):
        p.place((i, 0, n, n, 0, bytes(2 * n)))
        least = None
        for k in [None, *range(len(open_))]:  # each choice, by the sum of squares it leaves
            levels = Counter(open_)
            level = 0 if k is None else open_[k]
            if level + n > w:
                continue
            levels[level] -= level > 0
            levels[level + n] += level + n < w
            cost = (sum(c * c for c in levels.values()), -level)
            least = min(least, (cost, -1 if k is None else k)) if least else (cost, -1 if k is None else k)
        level = 0 if least[1] < 0 else open_.pop(least[1])
        if level + n < w:
            open_.append(level + n)
        full += level + n == w
        assert p.count.tolist() == [Counter(open_)[k] for k in range(w + 1)]
    assert len({r[5] for r in p.out}) == full
    p.drain(2)
    assert sum(r[2] for r in p.out) == sum(sizes)
    assert p.drained == sum(open_)


def test_little_is_drained(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(32)
    placed = packing.pack(docs).collect()
    windows = Counter()
    for r in placed:
        windows[r["sequence_id"]] += r["length"]
    assert all(n == 4096 or n & (n - 1) == 0 for n in windows.values())
    assert sum(n < 4096 for n in windows.values()) <= 12
    cut = {(r["doc_id"], r["start"]) for r in placed if (r["start"] + r["length"]) % 4096 and r["start"] + r["length"] < r["doc_tokens"]}
    assert len(cut) < 0.05 * len(windows)  # only drain() cuts elsewhere than at whole windows: one cut a window


def test_ogg(spark, texts):
    for n in (0, 1, 575, 576, 577, 60_000):
        for frame in (576, 255, 510):
            payload = ogg.pad(os.urandom(n), frame)
            assert ogg.read(ogg.write(payload, frame))[0] == payload
    data = bytearray(ogg.write(ogg.pad(b"abc" * 999)))
    data[300] ^= 4
    with pytest.raises(ValueError):
        ogg.read(bytes(data))
    for r in ogg.op8_ogg_media(spark, SF).collect():
        payload = ogg.pad(texts[r["doc_id"]].encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_classifiers(spark):
    sf = SF.replace("0.001", "0.01")
    y = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for found, label, least in ((quality.op3_boosted_quality, "quality", 0.95), (toxicity.op7_subword_toxicity, "toxic", 0.85)):
        out = [r for r in found(spark, sf).collect() if r["held_out"] and r["doc_id"] in y]
        assert np.mean([r["predicted"] == y[r["doc_id"]][label] for r in out]) > least


def test_long_words_of_one_letter_pattern_differ(spark):
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b, rest = a.translate(str.maketrans("ab", "ba")), [f"w{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join([*rest[:6], a, *rest[6:12]])), (2, " ".join([*rest[:6], b, *rest[6:12]]))], "doc_id long, text string")
    assert [r["n_removed"] for r in blocks.repeated_words(docs).collect()] == [0, 0]
    assert {r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == {1, 2}


def test_blocks_need_their_index(spark, texts, monkeypatch):
    def nothing(rows):
        import pyarrow as pa

        return pa.table({"part": rows.column("part"), "bucket": rows.column("bucket"), "bits": pa.array([bytes(len(x)) for x in rows.column("flags").to_pylist()], pa.binary())})

    nothing.__module__ = "__main__"
    monkeypatch.setattr(blocks, "_met", nothing)
    assert sum(r["n_removed"] for r in blocks.op6_fixed_block_dedup(spark, SF).collect()) == 0


@pytest.mark.parametrize("how", ["repartition", "orderBy", "dropDuplicates"])
def test_rows_are_numbered_once(spark, how):
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs.withColumn("wide", F.repeat(F.col("text"), 3))
    shuffled = {"repartition": wide.repartition("doc_id"), "orderBy": wide.orderBy(F.desc("text")), "dropDuplicates": wide.dropDuplicates(["doc_id"])}[how]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for stage in (jaccard.keep_first, suffix.cut_repeats, lambda d: decontaminate.drop_contaminated(d, bench)):
        want = {(r["doc_id"], r["text"]) for r in stage(docs).collect()}
        assert {(r["doc_id"], r["text"]) for r in stage(shuffled).select("doc_id", "text").collect()} == want
