"""Operators without SQL: simulations, streams, registries, ordered folds."""

import json

import pytest
from pyspark.sql import functions as F

from quizforge.operators import curation, reporting, session, similarity, simulation, tracing
from quizforge.plans import applied, catalog
from quizforge.sources import readers

SF = "/root/testdata/sf0.001"


def test_simulated_runs(spark):
    pool = simulation.item_pool(applied.objectives(spark), 6, "s").cache()
    assert pool.count() == 120 and {r["label"] for r in pool.collect()} == set(simulation.LABELS)
    students = applied._thetas(spark, 400).cache()
    last = {}
    for mode in simulation.ASSESS:
        runs = simulation.assessments(students, pool, applied.WEIGHTS, mode, 20).collect()
        assert len(runs) == 400 * 20 and len({(r["student"], r["step"]) for r in runs}) == len(runs)
        last[mode] = sum((r["theta"] - r["theta_true"]) ** 2 for r in runs if r["step"] == 20) / 400
    assert last["adaptive-free"] < last["random"]
    short = simulation.assessments(students, pool, applied.WEIGHTS, "adaptive", 40, sd_stop=0.6).groupBy("student").agg(F.max("step").alias("n"), F.max_by("sd", "step").alias("sd")).collect()
    assert all(r["sd"] < 0.6 or r["n"] == 40 for r in short) and min(r["n"] for r in short) >= 3
    with pytest.raises(ValueError):
        simulation.assessments(students, pool, applied.WEIGHTS, "other", 3)
    cohort = simulation.by_student(simulation.cohort(spark.range(40).select(F.col("id").alias("student")), applied.objectives(spark), "s"))
    ends = {}
    for mode in simulation.PRACTISE:
        runs = simulation.practice(cohort, pool, applied.WEIGHTS, mode, 60).collect()
        assert len(runs) == 40 * 61
        by = {(r["student"], r["step"]): r["mastered"] for r in runs}
        assert all(by[s, t] <= by[s, t + 1] for s, t in by if t < 60)  # nothing is forgotten
        ends[mode] = sum(by[s, 60] for s in range(40)) / 40
    assert ends["adaptive"] >= ends["random"] - 0.05
    c = {r["round"]: r for r in simulation.calibration(applied._thetas(spark, 300), pool, 20, 4).collect()}
    assert c[4]["rmse_used"] < c[1]["rmse_used"] and c[4]["n"] == 300 * 20 / 120


def test_em_climbs(spark):
    rows = [([0, 0, 1, 1, 1],), ([0, 1, 0, 1],), ([1, 1, 1],), ([0, 0, 0, 0, 1, 1],)] * 5
    par, trace = tracing.fit_em(spark.createDataFrame(rows, "seq array<int>"))
    assert all(b >= a - 1e-9 for a, b in zip(trace, trace[1:], strict=False)) and trace[-1] > trace[0] and 0 < par["learn"] < 1


def test_shared_mastery_moves_neighbours(spark):
    rows = spark.createDataFrame([(1, 1, "a", 0.0, True), (1, 2, "a", 0.0, True)], "session long, seq long, lo string, b double, correct boolean")
    got = {r["lo"]: r["mastery"] for r in tracing.shared_mastery(rows, spark.createDataFrame([("a", "b", 0.9)], "src string, dst string, sim double")).collect()}
    own = {r["lo"]: r["mastery"] for r in tracing.mastery(rows).collect()}
    m, near = 0.2, 0.2
    for _ in range(2):
        post = m * 0.9 / (m * 0.9 + (1 - m) * 0.25)
        near, m = near + 0.3 * 0.9 * (post - m), post + (1 - post) * 0.12
    assert abs(got["a"] - own["a"]) < 1e-9 and abs(got["a"] - m) < 1e-9 and abs(got["b"] - near) < 1e-9


def test_stream_goes_on(spark, tmp_path):
    from quizforge.streaming import sessions

    e = spark.read.parquet(f"{SF}/events.parquet")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    half = e.orderBy("ts", "event_id").limit(e.count() // 2).collect()
    cut = half[-1]["ts"]
    for part in (e.where(F.col("ts") <= F.lit(cut)), e.where(F.col("ts") > F.lit(cut))):
        part.coalesce(1).write.mode("append").parquet(src)
        rows = sessions.write_once(sessions.record(sessions.responses(sessions.stream(spark, src))), out)
        items = sessions.calibrated(sessions.record(sessions.responses(sessions.stream(spark, src))), out)
    assert rows.count() == e.count()
    want = {(r["session"], r["seq"]): r for r in tracing.trajectory(catalog.responses(spark, SF)).collect()}
    got = {(r["session"], r["seq"]): r for r in rows.collect()}
    assert all(abs(got[k]["theta"] - r["theta"]) < 1e-6 and abs(got[k]["sd"] - r["sd"]) < 1e-6 for k, r in want.items())
    mastered = {(r["session"], r["lo"]): r["mastery"] for r in tracing.mastery(catalog.responses(spark, SF)).collect()}
    assert all(abs(r["mastery"] - mastered[r["session"], r["lo"]]) < 1e-6 for r in rows.groupBy("session", "lo").agg(F.max_by("mastery", "seq").alias("mastery")).collect())
    elo = {r["item"]: r for r in catalog.elo_calibration(spark, SF).collect()}
    assert all(r["n"] == elo[r["item"]]["n"] and abs(r["b"] - elo[r["item"]]["b"]) < 1e-4 for r in items.collect())


def test_registries_and_banks(spark, tmp_path):
    text = json.dumps([{"key": "bio", "subject": "b", "role": "ood", "sha": "x"}, {"key": "phy", "subject": "p", "role": "train", "sha": "y"}])
    assert [r["key"] for r in curation.registry(spark.createDataFrame([(text,)], "value string")).collect()] == ["bio", "phy"]
    sample, made = str(tmp_path / "sample"), str(tmp_path / "made")
    spark.createDataFrame([(1, "s"), (2, "s")], "id long, v string").write.json(sample)
    spark.createDataFrame([(2, "g"), (3, "g")], "id long, v string").write.json(made)
    got = curation.bank(spark, str(tmp_path / "none"), sample, made, "id long, v string")
    assert sorted(map(tuple, got.collect())) == [(1, "s"), (2, "s"), (3, "g")]
    spark.createDataFrame([("arm", "a1", 1)], "k string, arm string, n int").write.json(str(tmp_path / "gen_a1.jsonl"))
    modes = spark.createDataFrame([("m", 0.5)], "mode string, tau double")
    scores = spark.createDataFrame([(1, 0.4), (2, 0.6)], "id long, score double")
    assert [r["aligned"] for r in curation.calibration(modes, "m", scores).orderBy("id").collect()] == [False, True]
    assert [r["aligned"] for r in curation.calibration(modes, "x", scores).collect()] == [False, False]


def test_torn_tail_only(spark, tmp_path):
    good, torn, broken = (str(tmp_path / n) for n in ("a.jsonl", "b.jsonl", "c.jsonl"))
    open(good, "w").write('{"a": 1}\n{"a": 2}\n')
    open(torn, "w").write('{"a": 1}\n{"a": ')
    open(broken, "w").write('{"a": 1}\n{"a": \n{"a": 3}\n')
    assert [r["a"] for r in readers.append_only(spark, good, "a int").collect()] == [1, 2]
    assert [r["a"] for r in readers.append_only(spark, torn, "a int").collect()] == [1]
    with pytest.raises(Exception, match="broken line"):
        readers.append_only(spark, broken, "a int").collect()


def test_novel_so_far_and_copies(spark):
    v = spark.createDataFrame([(1, "x", 1, [1.0, 0.0]), (2, "x", 2, [0.99, 0.14]), (3, "x", 3, [0.0, 1.0]), (4, "y", 4, [1.0, 0.0])], "id long, key string, ordinal long, vec array<double>")
    assert {r["id"]: r["novel"] for r in similarity.accepted(v, "key").collect()} == {1: True, 2: False, 3: True, 4: True}
    items = v.where("id < 4").withColumn("source_vec", F.when(F.col("id") == 3, F.array(F.lit(0.0), F.lit(1.0))))
    train = spark.createDataFrame([(9, [1.0, 0.0])], "id long, vec array<double>")
    assert {r["id"]: (r["memorised"], r["source_copy"]) for r in similarity.copies(items, train).collect()} == {1: (True, False), 2: (True, False), 3: (False, True)}


def test_audits_refuse(spark):
    key = spark.createDataFrame([("a1", "x", 1), ("a2", "y", 2)], "audit_id string, arm string, id long")
    sheet = "audit_id string, key_correct boolean, lo_fit boolean"
    for rows in ([("a1", True, True)], [("a1", True, True), ("a1", True, True), ("a2", True, True)], [("a1", None, True), ("a2", True, True)]):
        with pytest.raises(ValueError):
            reporting.audit(spark.createDataFrame(rows, sheet), key)
    with pytest.raises(ValueError):
        p = spark.createDataFrame([(0, "a"), (1, "b")], "ordinal int, prompt string")
        curation.zipped(p, spark.createDataFrame([(0, 5)], "ordinal int, id long"), spark.createDataFrame([(5, "train")], "id long, final_split string"))


def test_copied_share(spark):
    words = F.split(F.lit("the cell wall is made of lignin here"), " ")
    r = spark.range(1).select(curation.copied_share(F.lit(""), F.lit(" we say the cell wall is made by plants "), words).alias("a"), curation.copied_share(F.lit(""), F.lit(" none "), words).alias("b")).first()
    assert abs(r["a"] - 5 / 8) < 1e-9 and r["b"] == 0


def test_request_problems(spark):
    rows = [("bio", "practice", "10"), ("bio", "practice", "61"), ("bio", "exam", "10"), ("art", "practice", "10"), ("bio", "practice", "٣"), ("bio", "practice", None), (None, "practice", "1")]
    d = spark.createDataFrame(rows, "s string, m string, n string")
    assert [r[0] for r in d.select(session.request_problem(F.col("s"), F.col("m"), F.col("n"), ["bio"])).collect()] == [None, "length", "mode", "subject", "length", "length", "subject"]
