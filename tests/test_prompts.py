"""Requests survive rendering and parsing."""

from pyspark.sql import functions as F

from quizforge import schemas
from quizforge.operators import leakage, prompts, quota

ROWS = [
    ("bio", "Cells", "Membranes", "b.1", "Explain: transport", "easy", "standard", "A passage.\n\nWith two parts.", None, []),
    ("chem", "Acids", "pH", "c.2", "Compute pH", "hard", "stimulus", "Text\n\nReturn JSON is named here.", "pH is 'mass'", ["What is pH?", "Why - so?"]),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(r,) for r in ROWS], f"r {schemas.REQUEST}")
    back = df.select("r", prompts.parse(prompts.render(F.col("r"))).alias("p")).collect()
    assert [x["p"].asDict() for x in back] == [x["r"].asDict() for x in back]
    text = df.select(prompts.render(F.col("r")).alias("t")).collect()[1]["t"].split("\n")
    assert text[:6] == ["Subject: chem", "Unit: Acids", "Topic: pH", "Learning objective (c.2): Compute pH", "Difficulty: hard", "Format: stimulus"]


def test_messages(spark):
    item = F.from_json(F.lit('{"stem": "S?", "choices": {"A": "a", "B": "b", "C": "c", "D": "d"}, "answer": "A", "explanation": "e", "lo_id": "l", "difficulty": "easy"}'), "stem string, stimulus string, choices map<string,string>, answer string, explanation string, lo_id string, difficulty string")
    df = spark.createDataFrame([(ROWS[0],)], f"r {schemas.REQUEST}")
    m = df.select(prompts.messages("Be brief.", F.col("r"), item).alias("m"), prompts.solver_body(F.lit("S?"), item["choices"], F.lit(None).cast("string"), F.lit(" P ")).alias("b")).first()
    assert [x["role"] for x in m["m"]] == ["system", "user", "assistant"] and m["m"][2]["content"].startswith('{"stem":"S?","choices"')
    assert m["b"] == "Passage: P\n\nS?\nA. a\nB. b\nC. c\nD. d\nAnswer:"


def test_draws_and_matches(spark):
    pool = spark.createDataFrame([(i, f"s{i % 3}") for i in range(30)], "id long, s string")
    got = quota.round_robin(pool, "s", "x", 3, 5, F.lit(True)).groupBy("s").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2, 2]
    scores = spark.createDataFrame([("b", 1, 7, 0.9), ("b", 2, 7, 0.95), ("b", 2, 8, 0.7), ("b", 3, 9, 0.1)], "book string, passage long, question long, score double")
    assert {(r["passage"], r["question"]) for r in leakage.greedy_match(scores).collect()} == {(1, 7), (2, 8)}
