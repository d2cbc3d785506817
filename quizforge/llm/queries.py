"""The queries of this folder's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ans, blocks, decontaminate, jaccard, ogg, packing, ppm, quality, suffix, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in (suffix, blocks, decontaminate, quality, jaccard, ppm, toxicity, ogg, ans, packing):
        out |= {k: v for k, v in vars(module).items() if k.startswith("op") and k[2:3].isdigit()}
    return out


def oracle_sql() -> dict[str, str]:
    return {"op2_benchmark_decontamination": decontaminate.OP2_SQL}
