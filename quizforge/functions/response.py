"""The response model, knowledge tracing steps, item calibration and policy scores as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GUESS = 0.25
TARGET_P = 0.7
# Fixed values of knowledge tracing and of item calibration.
P_INIT, P_LEARN, P_GUESS, P_SLIP, B_SCALE, EPS = 0.2, 0.12, 0.25, 0.10, 0.08, 1e-6
K0, K_DECAY, MIN_N = 0.15, 0.02, 5


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def p_correct(theta: Column, b: Column, c: float = GUESS) -> Column:
    return c + (1 - c) * sigmoid(theta - b)


def slope(theta: Column, b: Column, c: float = GUESS) -> Column:
    s = sigmoid(theta - b)
    return (1 - c) * s * (1 - s)


def information(theta: Column, b: Column, c: float = GUESS) -> Column:
    p = p_correct(theta, b, c)
    return slope(theta, b, c) ** 2 / (p * (1 - p))


def optimal_p(c: float = GUESS) -> float:
    return (1 + math.sqrt(1 + 8 * c)) / 4


def optimal_offset(c: float = GUESS) -> float:
    s = (optimal_p(c) - c) / (1 - c)
    return math.log(s / (1 - s))


def info_se(total: Column) -> Column:
    return F.when(total > 0, 1 / F.sqrt(total)).otherwise(F.lit(float("inf")))


def should_stop(n: Column, sd: Column, cap: Column, limit: Column) -> Column:
    """The cap comes first; a small deviation counts from three answers on."""
    return (n >= cap) | ((n >= 3) & (sd < limit))


def b_for_target(theta: Column, p: float, c: float = GUESS) -> Column:
    s = min(max((p - c) / (1 - c), 1e-4), 1 - 1e-4)
    return theta - math.log(s / (1 - s))


def difficulty_label(b: Column) -> Column:
    return F.when(b < -0.5, "easy").when(b < 0.5, "medium").otherwise("hard")


def guess_slip(b: Column) -> tuple[Column, Column]:
    return F.least(F.greatest(P_GUESS - B_SCALE * b, F.lit(0.05)), F.lit(0.45)), F.least(F.greatest(P_SLIP + B_SCALE * b, F.lit(0.02)), F.lit(0.40))


def mastery_after(prior: Column, correct: Column, b: Column) -> Column:
    g, s = guess_slip(b)
    top = F.when(correct, prior * (1 - s)).otherwise(prior * s)
    rest = F.when(correct, (1 - prior) * g).otherwise((1 - prior) * (1 - g))
    return top / F.greatest(top + rest, F.lit(EPS))


def mastery_step(prior: Column, correct: Column, b: Column, learning: bool = True) -> Column:
    post = mastery_after(prior, correct, b)
    return post + (1 - post) * P_LEARN if learning else post


def mastery_p(mastery: Column, b: Column) -> Column:
    g, s = guess_slip(b)
    return mastery * (1 - s) + (1 - mastery) * g


def calibrated(b: Column, n: Column, theta: Column, correct: Column) -> Column:
    return b - K0 / (1 + K_DECAY * n) * (correct.cast("double") - p_correct(theta, b))


def effective_b(b: Column, n: Column, label: Column) -> Column:
    return F.when(n < MIN_N, label).otherwise(b)


def practice_score(weight: Column, mastery: Column, n_lo: Column, t: Column) -> Column:
    return weight * (1 - mastery) + 0.3 * F.sqrt(F.log(t + 1) / (n_lo + 1))


def assessment_score(weight: Column, t: Column, n_unit: Column, n_lo: Column) -> Column:
    return weight * (t + 1) - n_unit - 0.01 * n_lo


def unit_cap(weight: Column, length: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(weight * length))


def learning_p(p: Column) -> Column:
    return 0.3 * F.exp(-((p - TARGET_P) ** 2) / (2 * 0.15**2))


def scale_score(theta: Column, cuts: tuple[float, ...] = (-1.5, -0.5, 0.5, 1.5)) -> Column:
    out = F.lit(1)
    for c in cuts:
        out = out + (theta >= c).cast("int")
    return out
