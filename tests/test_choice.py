"""Items chosen without pairing every session with every item."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quizforge.functions import response as R
from quizforge.operators import grouping, session


@pytest.mark.parametrize("step", [1e-5, 0.01, 0.05])
def test_most_fitting_is_the_best_of_all(spark, step):
    rng = random.Random(5)
    own = spark.createDataFrame([(i, i % 3, rng.uniform(-4, 4)) for i in range(300)] + [(900, 1, None), (901, 7, 0.0)], "id long, lo long, theta double")
    bank = spark.createDataFrame([(i, j % 2, rng.randrange(-400, 400) * step) for j, i in enumerate(rng.sample(range(10_000), 700))] + [(20_000, 2, 0.5)], "item long, lo long, b double")
    pairs = own.where("theta IS NOT NULL").join(bank, "lo")
    for value, peak, old in (
        (session.information, math.log((R.optimal_p() - R.GUESS) / (1 - R.optimal_p())), F.desc(F.round(R.information(F.col("theta"), F.col("b")), 9))),
        (session.nearness, math.log((R.TARGET_P - R.GUESS) / (1 - R.TARGET_P)), F.round(F.abs(R.p_correct(F.col("theta"), F.col("b")) - R.TARGET_P), 9)),
    ):
        got = {r["id"]: r["item"] for r in session.most_fitting(own, bank, value, peak).collect()}
        assert got == {r["id"]: r["item"] for r in grouping.first_by(pairs, ["id"], [old, "item"]).collect()}
        assert len(got) == 300


def test_choose_from_bank_is_choose_item(spark):
    rng = random.Random(7)
    score = {lo: (rng.randrange(3), rng.random() < 0.5) for lo in range(12)}
    bank = spark.createDataFrame([(lo := rng.randrange(12), *score[lo], i, rng.randrange(9) / 2) for i in range(80)], "lo long, score long, capped boolean, item long, gap double")
    asked = spark.createDataFrame([(s, lo) for s in range(40) for lo in rng.sample(range(14), 3)], "session long, lo long")
    none = spark.createDataFrame([], "session long, item long")
    want = {tuple(r) for r in session.choose_item(asked.join(bank, "lo"), none).select("session", "lo", "item").collect()}
    assert {tuple(r) for r in session.choose_from_bank(asked, bank).collect()} == want
