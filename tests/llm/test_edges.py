"""Every operator on the edges: nulls, empty and long texts, repeated rows and ids, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

from quizforge.llm import ans, blocks, decontaminate, jaccard, ogg, packing, ppm, quality, suffix, toxicity

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today."), (2, None), (3, ""), (4, "  \n\t "), (5, "a"), (5, "a"), (5, "b c"), (None, "no id here"), (None, None),
    (6, LONG), (7, LONG), (8, "x" * 5000), (9, "é" * 300 + " ü"), (10, "tail\x00nul \x0b sep <|endoftext|> 's"), (11, "The quick brown fox jumps over the lazy dog again and again today."),
]


def documents(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit(1).alias("_row"), F.lit("z").alias("_id"), F.lit("t").alias("_text"), F.lit(2).alias("n"), F.lit(3).alias("count"), F.lit(None).cast("string").alias("lang"), F.lit(0).alias("part"))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    documents(spark).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, None), (5, 0, 1), (None, 1, 1), (6, 1, 0), (8, 0, 1), (8, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "quick BROWN fox"), (2, None), (3, "..."), (None, "lazy dog"), (1, "jumps over")], "item_id long, text string")


RUNS = {
    "suffix": lambda d, la, b: suffix.substring_repeats(d), "decontaminate": lambda d, la, b: decontaminate.hits(d, b), "quality": lambda d, la, b: quality.quality(d, la),
    "jaccard": lambda d, la, b: jaccard.jaccard_components(d), "ppm": lambda d, la, b: ppm.score(d), "ppm_join": lambda d, la, b: ppm.score(d, broadcast_words=0), "blocks": lambda d, la, b: blocks.repeated_words(d),
    "toxicity": lambda d, la, b: toxicity.toxicity(d, la), "ogg": lambda d, la, b: ogg.media_columns(d), "ans": lambda d, la, b: ans.token_ids(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_a_row_for_each_row(docs, labels, bench, name):
    got = RUNS[name](docs, labels, bench).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ROWS)
    same = [tuple(v for k, v in r.asDict().items() if k not in ("_row", "start")) for r in got if r["doc_id"] == 5]
    assert len(set(same)) <= 2  # the repeated row has the values of its twin


@pytest.mark.parametrize("name", sorted(RUNS))
def test_no_documents(none, labels, bench, name):
    assert RUNS[name](none, labels, bench).collect() == []


def test_no_labels_no_benchmark(docs, labels, bench):
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in quality.quality(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["n_hit"] for r in decontaminate.hits(docs, bench.limit(0)).collect()} == {0}


def test_decontamination_without_broadcast(spark, docs, bench, monkeypatch):
    sf = "/root/testdata/sf0.001"
    tables = [(docs, bench), (spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))]
    want = [sorted(map(str, decontaminate.hits(d, b).drop("_row").collect())) for d, b in tables]
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert [sorted(map(str, decontaminate.hits(d, b).drop("_row").collect())) for d, b in tables] == want


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    assert packing.pack(none).collect() == []
    assert {r["doc_id"] for r in rows} == {i for i, _ in ROWS}
    windows: dict = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096 and at & (at - 1) == 0


def test_values(docs, bench):
    hit = {r["doc_id"]: r for r in decontaminate.hits(docs, bench).collect()}
    assert (hit[1]["n_words"], hit[1]["n_hit"], hit[1]["n_items"], hit[1]["contaminated"]) == (13, 7, 1, True)
    cut = {r["doc_id"]: r for r in suffix.substring_repeats(docs).collect()}
    assert (cut[8]["n_removed"], cut[9]["n_removed"], cut[6]["n_removed"], cut[1]["n_removed"]) == (5000, 600, len(LONG), 0)
    words = {r["doc_id"]: r for r in blocks.repeated_words(docs).collect()}
    assert (words[6]["n_removed"], words[7]["n_removed"], words[11]["n_removed"], words[4]["n_words"]) == (0, 20_000, 13, 0)
    link = {r["doc_id"]: r for r in jaccard.jaccard_components(docs).collect()}
    assert (link[7]["component_id"], link[11]["component_id"], link[4]["component_id"], link[3]["n_shingles"]) == (6, 1, 4, 0)


def test_stages_keep_columns(docs, labels, bench):
    for out in (suffix.cut_repeats(docs), decontaminate.drop_contaminated(docs, bench), jaccard.keep_first(docs), toxicity.drop_toxic(docs, labels)):
        assert [c for c in out.columns if c != "_row"] == [c for c in docs.columns if c != "_row"]
        out.collect()


def test_operators_return_texts_and_files(docs):
    import hashlib

    digests = sorted((str(r["doc_id"]), r["n_removed"], r["kept_sha256"]) for r in blocks.repeated_words(docs).collect())
    assert digests == sorted((str(r["doc_id"]), sum(x["end"] - x["start"] for x in r["spans"]), hashlib.sha256(r["kept"].encode()).hexdigest()) for r in blocks.cut_words(docs).collect())
    digests = sorted((str(r["doc_id"]), r["media_sha256"], r["payload_sha256"]) for r in ogg.media_columns(docs).collect())
    assert digests == sorted((str(r["doc_id"]), hashlib.sha256(r["media"]).hexdigest(), hashlib.sha256(ogg.read(r["media"])[0]).hexdigest()) for r in ogg.media_files(docs).collect())
