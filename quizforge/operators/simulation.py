"""Simulated students: item pools, cohorts, assessments, practice, item calibration.

Draws of pools and cohorts are expressions over md5 of (seed, names), so any engine gives the same. Runs are per
student, each with a seed of its own: a student is one row, and its run is a loop over the pool, which the curriculum bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import response as R
from .tracing import GRID, calibrate

# Fixed values of the simulated students.
LABELS = {"easy": -1.0, "medium": 0.0, "hard": 1.0}
SPREAD, OFFSET_SD, MASTERY_SHIFT, BONUS, LEARN_MAX, LEARN_WIDTH = 0.5, 0.5, -1.2, 1.5, 0.3, 0.15
ASSESS, PRACTISE = ("adaptive", "adaptive-free", "random", "fixed"), ("adaptive", "random-lo-targeted", "random", "round-robin")


def uniform(*parts: Column | str) -> Column:
    """In (0, 1), from md5 of the parts joined by ':'."""
    h = F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(*parts: Column | str) -> Column:
    return F.sqrt(-2 * F.log(uniform("u", *parts))) * F.cos(2 * np.pi * uniform("v", *parts))


def item_pool(objectives: DataFrame, per_lo: int, seed: str) -> DataFrame:
    """(item, lo, unit, label, b_label, b_true): per_lo items of each objective (lo, unit), labels in turn."""
    each = objectives.select("lo", "unit", F.explode(F.sequence(F.lit(0), F.lit(per_lo - 1))).alias("k"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.col("k") % 3 + 1)
    b = F.element_at(F.array(*map(F.lit, LABELS.values())), F.col("k") % 3 + 1)
    item = F.concat("lo", F.lit("#"), F.col("k").cast("string"))
    return each.select(item.alias("item"), "lo", "unit", label.alias("label"), b.alias("b_label"), (b + SPREAD * normal(seed, "b", item)).alias("b_true"))


def cohort(students: DataFrame, objectives: DataFrame, seed: str) -> DataFrame:
    """(student, theta, lo, unit, ability, mastered) of students (student): ability is theta and the unit's offset."""
    theta = normal(seed, "theta", F.col("student"))
    placed = students.select("student", theta.alias("theta")).crossJoin(F.broadcast(objectives.select("lo", "unit")))
    own = placed.withColumn("ability", F.col("theta") + OFFSET_SD * normal(seed, "offset", F.col("student"), F.col("unit")))
    return own.withColumn("mastered", uniform(seed, "mastery", F.col("student"), F.col("lo")) < R.sigmoid(F.col("ability") + MASTERY_SHIFT))


def chance(ability: Column, mastered: Column, b: Column) -> Column:
    """The probability of a right answer: a mastered objective lifts the ability."""
    return R.p_correct(ability + F.when(mastered, BONUS).otherwise(0.0), b)


class _Grid:
    points = np.linspace(-5, 5, GRID)

    def __init__(self) -> None:
        self.lw = -(self.points**2) / 2
        self.theta, self.sd = 0.0, 1.0

    def update(self, b: float, right: bool) -> None:
        p = curve(self.points, b)
        self.lw = self.lw + np.log(p if right else 1 - p)
        w = np.exp(self.lw - self.lw.max())
        w /= w.sum()
        self.theta = float(w @ self.points)
        self.sd = float(np.sqrt(max(w @ self.points**2 - self.theta**2, 0)))


def curve(theta, b):
    return R.GUESS + (1 - R.GUESS) / (1 + np.exp(-(theta - b)))


def fisher(theta: float, b: np.ndarray) -> np.ndarray:
    p = curve(theta, b)
    s = (p - R.GUESS) / (1 - R.GUESS)
    return ((1 - R.GUESS) * s * (1 - s)) ** 2 / (p * (1 - p))


def _pool(pool: DataFrame, weights: dict[str, float]) -> dict[str, np.ndarray]:
    rows = pool.orderBy("lo", "item").collect()  # bounded by the curriculum
    los = sorted({r["lo"] for r in rows})
    units = {r["lo"]: r["unit"] for r in rows}
    return {"lo": np.array([los.index(r["lo"]) for r in rows]), "b_true": np.array([r["b_true"] for r in rows]), "b_label": np.array([r["b_label"] for r in rows]), "los": los, "units": [units[x] for x in los], "weight": np.array([weights[units[x]] for x in los])}


def assessments(students: DataFrame, pool: DataFrame, weights: dict[str, float], policy: str, length: int, sd_stop: float | None = None, seed: int = 0) -> DataFrame:
    """(student, step, theta_true, theta, sd) of students (student, theta).

    adaptive: the objective by blueprint under unit caps (without, if none is left), then the item of most information;
    adaptive-free: the latter over the whole pool; random; fixed: one drawn form for all.
    """
    if policy not in ASSESS:
        raise ValueError(policy)
    have = _pool(pool, weights)

    def one(student: int, true: float) -> list[tuple]:
        rng, grid, out = np.random.default_rng([seed, int(student)]), _Grid(), []
        lo, b, unit = have["lo"], have["b_true"], np.array(have["units"])
        free, n_lo = np.ones(len(b), bool), np.zeros(len(have["los"]))
        form = np.random.default_rng(seed + 99).permutation(len(b))
        for t in range(min(length, len(b))):
            if policy == "fixed":
                k = int(form[t])
            elif policy == "random":
                k = int(rng.choice(np.flatnonzero(free)))
            else:
                may = free
                if policy == "adaptive":
                    n_unit = np.array([n_lo[unit == u].sum() for u in unit])
                    score = have["weight"] * (t + 1) - n_unit - 0.01 * n_lo
                    open_ = n_unit < np.maximum(1, np.ceil(have["weight"] * length))
                    best = int(np.argmax(np.where(open_ if open_.any() else True, score, -np.inf)))
                    may = free & (lo == best) if (free & (lo == best)).any() else free
                k = int(np.argmax(np.where(may, fisher(grid.theta, b), -1)))
            free[k] = False
            n_lo[lo[k]] += 1
            grid.update(b[k], bool(rng.random() < curve(true, b[k])))
            out.append((int(student), t + 1, float(true), grid.theta, grid.sd))
            if sd_stop is not None and t + 1 >= 3 and grid.sd < sd_stop:
                break
        return out

    return _runs(students.select("student", "theta"), one, "student long, step int, theta_true double, theta double, sd double")


def practice(students: DataFrame, pool: DataFrame, weights: dict[str, float], policy: str, steps: int, seed: int = 0) -> DataFrame:
    """(student, step, mastered, brier) of students (student, lo -> struct<ability, mastered> as `los`), step 0 first.

    adaptive: the objective of the best need-and-novelty score, then the item nearest to the target chance;
    random-lo-targeted: a random objective, the same item rule; random: both random; round-robin: objectives in turn.
    """
    if policy not in PRACTISE:
        raise ValueError(policy)
    have = _pool(pool, weights)
    order = F.array_sort(F.map_entries("los"))

    def one(student: int, los: list) -> list[tuple]:
        rng, grid = np.random.default_rng([seed, int(student)]), _Grid()
        ability, known = np.array([x["value"]["ability"] for x in los]), np.array([x["value"]["mastered"] for x in los], bool)
        belief, n_lo = np.full(len(los), R.P_INIT), np.zeros(len(los))
        free = np.ones(len(have["lo"]), bool)
        out = [(int(student), 0, float(known.mean()), float(((belief - known) ** 2).mean()))]
        for t in range(steps):
            if policy == "adaptive":
                lo = int(np.argmax(have["weight"] * (1 - belief) + 0.3 * np.sqrt(np.log(t + 1) / (n_lo + 1))))
            else:
                lo = t % len(los) if policy == "round-robin" else int(rng.integers(len(los)))
            mine = np.flatnonzero(have["lo"] == lo)
            if policy in ("random", "round-robin"):
                k = int(rng.choice(mine))
            else:
                if not free[mine].any():
                    free[mine] = True
                left = mine[free[mine]]
                k = int(left[np.argmin(np.abs(curve(grid.theta, have["b_label"][left]) - R.TARGET_P))])
                free[k] = False
            b = have["b_label"][k]
            p = float(curve(ability[lo] + BONUS * known[lo], have["b_true"][k]))
            right = bool(rng.random() < p)
            g, s = min(max(R.P_GUESS - R.B_SCALE * b, 0.05), 0.45), min(max(R.P_SLIP + R.B_SCALE * b, 0.02), 0.40)
            top, rest = (belief[lo] * (1 - s), (1 - belief[lo]) * g) if right else (belief[lo] * s, (1 - belief[lo]) * (1 - g))
            post = top / max(top + rest, R.EPS)
            belief[lo] = post + (1 - post) * R.P_LEARN
            grid.update(b, right)
            n_lo[lo] += 1
            if not known[lo] and rng.random() < LEARN_MAX * np.exp(-((p - R.TARGET_P) ** 2) / (2 * LEARN_WIDTH**2)):
                known[lo] = True
            out.append((int(student), t + 1, float(known.mean()), float(((belief - known) ** 2).mean())))
        return out

    return _runs(students.select("student", order.alias("los")), one, "student long, step int, mastered double, brier double")


def _runs(students: DataFrame, one, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame(one(*row), columns=names)

    return students.mapInPandas(run, schema)


def by_student(cohort_rows: DataFrame) -> DataFrame:
    """(student, los): the rows of cohort() as one map a student."""
    return cohort_rows.groupBy("student").agg(F.map_from_entries(F.collect_list(F.struct("lo", F.struct("ability", "mastered")))).alias("los"))


def calibration(students: DataFrame, pool: DataFrame, per_student: int, rounds: int, seed: int = 0) -> DataFrame:
    """(round, n, rmse, rmse_used): how near item difficulties come to the true ones as students (student, theta) answer.

    Each student answers per_student drawn items and is estimated with the difficulties served; each answer then
    moves its item. Students come in rounds: within one, all are served the difficulties of its start, and an
    item's answers are folded in order. (One student at a time can't be spread.)
    """
    from .grouping import cut

    spark = students.sparkSession
    state = cut(pool.select("item", "b_true", "b_label", F.col("b_label").alias("b"), F.lit(0).cast("long").alias("n")))
    errors: list[DataFrame] = []
    for k in range(rounds):
        items = [(r["item"], r["b_true"], r["b"] if r["n"] >= R.MIN_N else r["b_label"]) for r in state.orderBy("item").collect()]  # bounded by the pool

        def one(student: int, theta: float, items: list = items) -> list[tuple]:
            rng, grid, out = np.random.default_rng([seed, int(student)]), _Grid(), []
            for seq, j in enumerate(rng.permutation(len(items))[:per_student]):
                name, b, served = items[j]
                right = bool(rng.random() < curve(theta, b))
                out.append((int(student), seq + 1, name, grid.theta, right))
                grid.update(served, right)
            return out

        mine = students.where(F.pmod("student", F.lit(rounds)) == k).select("student", "theta")
        log = _runs(mine, one, "session long, seq long, item string, theta_pre double, correct boolean").join(state.select("item", "b", "n"), "item")
        log = cut(log.withColumn("ord", F.struct("session", "seq")))
        moved = calibrate(log, log.select("session", "seq", "theta_pre"), given=True).select("item", F.col("n").alias("more"), F.col("b").alias("now"))
        state = cut(state.join(moved, "item", "left").select("item", "b_true", "b_label", F.coalesce("now", "b").alias("b"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        gap = lambda x: F.sqrt(F.avg((x - F.col("b_true")) ** 2))
        errors.append(state.agg(F.lit(k + 1).alias("round"), F.avg("n").alias("n"), gap(F.col("b")).alias("rmse"), gap(R.effective_b(F.col("b"), F.col("n"), F.col("b_label"))).alias("rmse_used")))
    return reduce(DataFrame.union, errors) if errors else spark.createDataFrame([], "round int, n double, rmse double, rmse_used double")


def curves(runs: DataFrame) -> DataFrame:
    """(step, rmse, bias, coverage) of assessments()."""
    gap = F.col("theta") - F.col("theta_true")
    return runs.groupBy("step").agg(F.count("*").alias("n"), F.sqrt(F.avg(gap**2)).alias("rmse"), F.avg(gap).alias("bias"), F.avg((F.abs(gap) <= 1.96 * F.col("sd")).cast("double")).alias("coverage"))
