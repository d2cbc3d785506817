"""Reports over arms, samples, audits and judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def timing(generations: DataFrame) -> DataFrame:
    """Per arm: mean speed and seconds over rows that have them, the highest memory."""
    return generations.groupBy("arm").agg(F.avg("tps").alias("tps"), F.avg("seconds").alias("seconds"), F.max("memory").alias("memory"))


def sample_summary(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((shots, reason, n) with 'passed' for what fails nothing, (shots, samples, passed, prompts with a pass))."""
    reason = F.coalesce("first_fail", F.lit("passed"))
    whole = samples.groupBy("shots").agg(F.count("*").alias("samples"), F.count_if(F.col("first_fail").isNull()).alias("passed"), F.countDistinct(F.when(F.col("first_fail").isNull(), F.col("id"))).alias("prompts"))
    return samples.groupBy("shots", reason.alias("reason")).agg(F.count("*").alias("n")), whole


def audit(sheet: DataFrame, key: DataFrame) -> DataFrame:
    """Sheet rows with the arm and id behind their alias. Raises unless the aliases match one to one and verdicts are given."""
    both = sheet.groupBy("audit_id").agg(F.count("*").alias("n")).join(key.groupBy("audit_id").agg(F.count("*").alias("k")), "audit_id", "full")
    if not both.where("coalesce(n, 0) <> 1 or coalesce(k, 0) <> 1").isEmpty():
        raise ValueError("aliases of the sheet and of the key differ")
    if not sheet.where("key_correct is null or lo_fit is null").isEmpty():
        raise ValueError("a verdict is missing")
    return sheet.join(key, "audit_id")


def audit_score(audited: DataFrame) -> DataFrame:
    return audited.groupBy("arm").agg(F.count("*").alias("n"), F.count_if("key_correct").alias("key_correct"), F.count_if("lo_fit").alias("lo_fit"), F.count_if(F.col("key_correct") & F.col("lo_fit")).alias("both"))


def secondary(primary: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """key_secondary, null where the second judge has no row."""
    return primary.join(second.select(*keys, F.col("agrees").alias("key_secondary")), keys, "left")


def secondary_rates(rows: DataFrame) -> DataFrame:
    """Per arm: the second judge's rate over all rows, and the judges' agreement over those both judged (null if none)."""
    return rows.groupBy("arm").agg(
        F.count("*").alias("n"), (F.count_if("key_secondary") / F.count("*")).alias("secondary_rate"), F.avg(F.when(F.col("key_secondary").isNotNull(), (F.col("key_ok") == F.col("key_secondary")).cast("double"))).alias("agreement")
    )


def crosscheck(verdicts: DataFrame, key: DataFrame, verify: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts that could be read, with arm, id and verification, how many could not)."""
    read = verdicts.where("key_correct is not null")
    return read.join(key, "audit_id").join(verify, ["arm", "id"]), verdicts.agg(F.count_if(F.col("key_correct").isNull()).alias("unparsed"))


def most_common(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, n, rank) by count, ties by first appearance."""
    from pyspark.sql.window import Window

    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "_first"))).drop("_first")  # one row a distinct value


def needs_judge(checks: dict[str, Column]) -> Column:
    """Whether all checks but the key's pass, so the judge has to be asked."""
    out = F.lit(True)
    for name, ok in checks.items():
        if name != "key":
            out = out & F.coalesce(ok, F.lit(False))
    return out


def without_ids(rows: DataFrame, ids: tuple, id_col: str = "id") -> DataFrame:
    return rows.where(~F.col(id_col).isin(*ids))


def headline(rates: DataFrame, prefer: str) -> DataFrame:
    """The arm of the highest usable rate; a tie goes to the preferred arm, then by name."""
    order = F.struct("usable", (F.col("arm") == prefer).cast("int"))
    best = rates.agg(F.max(order).alias("m"))
    return rates.crossJoin(F.broadcast(best)).where(order == F.col("m")).agg(F.min("arm").alias("arm"), F.max("usable").alias("usable"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often."""
    names = sorted(a.columns)
    return names == sorted(b.columns) and a.select(*names).exceptAll(b.select(*names)).isEmpty() and b.select(*names).exceptAll(a.select(*names)).isEmpty()


def in_sheet_order(progress: DataFrame, sheet: DataFrame) -> DataFrame:
    """Partial verdicts, the last of each alias by `at`, in the sheet's order; those not done yet are left out."""
    last = progress.groupBy("audit_id").agg(F.max_by(F.struct(*[c for c in progress.columns if c != "audit_id"]), "at").alias("v"))
    return sheet.select("audit_id", "ordinal").join(last, "audit_id").orderBy("ordinal").select("audit_id", "ordinal", "v.*")
