"""Validation waterfalls, rates by arm, promotion, resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The orders in which checks are reported.
VALIDATOR = ("no_json", "bad_json", "schema", "structure", "misconception_missing", "key_disagreement", "not_aligned", "duplicate", "key_unverified")
SAMPLER = ("schema", "structure", "misconception", "aligned", "novel", "not_source_copy", "not_memorized", "key")


def first_failure(checks: dict[str, Column]) -> Column:
    """The first check, in order, that fails or is null (unchecked:<name>); null if all pass."""
    return F.coalesce(*(F.when(c.isNull(), F.lit(f"unchecked:{name}")).when(~c, F.lit(name)) for name, c in checks.items()))


def exclusion_reason(blank: Column, no_sentence: Column, unaligned: Column) -> Column:
    return F.when(blank, "blank").when(no_sentence, "no_sentence").when(unaligned, "unaligned").otherwise("eligible")


def verified(agrees: Column, p_key: Column) -> Column:
    return F.coalesce(agrees, F.lit(False)) & F.coalesce(p_key > 0.5, F.lit(False))


def eligibility(items: DataFrame, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """(split, total, grounded, blank), zeros for a split without items."""
    domain = items.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    found = items.groupBy("split").agg(F.count("*").alias("total"), F.count_if("grounded").alias("grounded"), F.count_if(~F.col("grounded")).alias("blank"))
    return domain.join(found, "split", "left").na.fill(0)


def quota_report(items: DataFrame, keys: list[str], counted: Column) -> DataFrame:
    """Counts by each key on its own, and over all; '-' and -1 stand for a key that is not grouped by."""
    cube = items.select(*keys, counted.alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(len(keys)))).alias("_set"))
    own = [F.when(F.col("_set") == i, F.col(k).cast("string")).alias(k) for i, k in enumerate(keys)]
    found = cube.select("_c", "_set", *own).groupBy("_set", *keys).agg(F.count("*").alias("n"), F.count_if("_c").alias("first_source"))
    kinds = dict(items.dtypes)
    return found.select(*(F.coalesce(k, F.lit("-")).alias(k) if kinds[k] == "string" else F.coalesce(F.col(k).cast("long"), F.lit(-1)).alias(k) for k in keys), "n", "first_source")


def cells(rows: DataFrame, arm: str, passed: str, right: str) -> DataFrame:
    """(arm, verdict, n, k, rate, lo, hi) by arm and verdict, by verdict over all arms, and over all: Wilson intervals."""
    from .stats import wilson

    verdict = F.when(F.col(passed), "pass").otherwise("fail")
    spread = F.explode(F.array(F.struct(F.col(arm).alias("arm"), verdict.alias("verdict")), F.struct(F.lit("all").alias("arm"), verdict.alias("verdict")), F.struct(F.lit("all").alias("arm"), F.lit("all").alias("verdict"))))
    found = rows.select(spread.alias("g"), F.col(right).alias("_k")).groupBy("g.arm", "g.verdict").agg(F.count("*").alias("n"), F.count_if("_k").alias("k"))
    w = wilson(F.col("k"), F.col("n"))
    return found.select("arm", "verdict", "n", "k", (F.col("k") / F.col("n")).alias("rate"), w["lo"].alias("lo"), w["hi"].alias("hi"))


def split_summary(rows: DataFrame, arm: str, usable: Column, ok: Column) -> DataFrame:
    """(arm, n, usable, promoted, survival): the share of usable items that are verified, null without any."""
    found = rows.groupBy(arm).agg(F.count("*").alias("n"), F.count_if(usable).alias("usable"), F.count_if(usable & ok).alias("promoted"))
    return found.withColumn("survival", F.try_divide(F.col("promoted").cast("double"), F.col("usable")))


def ledger(events: DataFrame, key: str, started: Column, finished: Column) -> DataFrame:
    found = events.groupBy(key).agg(F.count_if(started).alias("started"), F.count_if(finished).alias("finished"))
    return found.withColumn("unfinished", F.col("started") - F.col("finished"))


def rates(rows: DataFrame, arm: str, checks: list[str]) -> DataFrame:
    """The rate of each check over all rows of an arm: a null, such as a missing generation, fails."""
    return rows.groupBy(arm).agg(F.count("*").alias("n"), *(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")).alias(f"{c}_rate") for c in checks))


def promote(items: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Items that pass all checks, copy no source and are verified. Raises where a usable item has no verdict."""
    joined = items.join(verdicts, keys, "left")
    usable = F.col("all_checks") & ~F.col("source_copy")
    if not joined.where(usable & F.col("verified").isNull()).isEmpty():
        raise ValueError("usable items without a verification row")
    return joined.where(usable & F.col("verified"))


def pending(slots: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Slots not yet done."""
    return slots.join(done.select(*keys).distinct(), keys, "left_anti")


def stale(checked: DataFrame, judged: DataFrame, slot: list[str], sha: str = "sha", keep: bool = False) -> DataFrame:
    """Judged rows of a slot whose text has since changed; with keep=True also what it is now (now_<sha>)."""
    now = checked.select(*slot, F.col(sha).alias(f"now_{sha}"))
    found = judged.join(now, slot).where(F.col(sha) != F.col(f"now_{sha}"))
    return found if keep else found.drop(f"now_{sha}")


def require_same(df: DataFrame, columns: list[str]) -> None:
    """Raises where a file mixes settings."""
    if df.select(*columns).distinct().limit(2).count() > 1:
        raise ValueError(f"mixed {', '.join(columns)}")


def structure_kinds(items: DataFrame, problems: str, arm: str) -> DataFrame:
    """How many items have each kind of structure problem."""
    return items.select(arm, F.explode(F.array_distinct(problems)).alias("kind")).groupBy(arm, "kind").agg(F.count("*").alias("n"))


def replace_arm(table: DataFrame, new: DataFrame, arm: str = "arm") -> DataFrame:
    return table.join(new.select(arm).distinct(), arm, "left_anti").unionByName(new)


def add_items(bank: DataFrame, new: DataFrame, replace: bool = False, id_col: str = "id") -> DataFrame:
    """Insert or ignore, or insert or replace, by id."""
    old, more = (bank.join(new.select(id_col), id_col, "left_anti"), new) if replace else (bank, new.join(bank.select(id_col), id_col, "left_anti"))
    return old.unionByName(more)


def row_set_hash(df: DataFrame) -> str:
    """A hash of the rows as a set: the sum of row hashes, so no task gathers them."""
    return df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h")).agg(F.sha2(F.concat_ws(":", F.count("*"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)"))), 256)).first()[0]
