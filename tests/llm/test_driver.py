"""What must not burden the driver: rounds over few edges, and training; nor a worker: squares of a group's members."""

import random
import tracemalloc

import numpy as np

from quizforge.llm import graph, jaccard, toxicity


def test_few_edges_take_one_task(spark):
    """The rounds of stars over a chain took dozens of jobs, whatever its length."""
    order = random.Random(3).sample(range(400), 400)
    edges = spark.createDataFrame([*zip(order, order[1:]), (900, 901), (901, 901), (905, 905)], "a long, b long")
    spark.sparkContext.setJobGroup("few-edges", "")
    found = {tuple(r) for r in graph.components(edges).collect()}
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")
    spark.sparkContext.setJobGroup("other", "")
    assert found == {(i, 0) for i in range(400)} | {(900, 900), (901, 900)}
    assert found == {tuple(r) for r in graph.components(edges, one_task=0).collect()}
    assert len(jobs) < 10
    assert not graph.components(edges.where("a = b")).collect()


def test_training_is_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad nasty words") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(1 - doc_id % 2 AS INT) AS toxic")

    def here(*_):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(toxicity, "train", here)
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r["predicted"] == 1 - r["doc_id"] % 2 for r in got)
    assert toxicity.fit(docs, labels.where("toxic = 1")) is None


def test_comparison_holds_one_square():
    """linked() held the counts of a group's members in four squares of 8 bytes a cell besides: some 35 bytes a cell."""
    g, draw = 1500, np.random.default_rng(5)
    for pool in (10**9, 400):  # few shingles met, and many
        sets = [np.unique(draw.integers(0, pool, 12).astype(np.uint64)) for _ in range(g - 1)]
        sets.append(sets[0])
        tracemalloc.start()
        pairs = jaccard.linked(sets)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert (0, g - 1) in pairs and peak < 20 * g * g
