"""Readers: JSON lines, whole-file arrays, curriculum, logs, registries, versioned vectors."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import clean


def jsonl(spark: SparkSession, path: str, schema: str, torn: bool = False) -> DataFrame:
    """One object a line; a broken line raises, or with torn=True (an append-only file's last line) is left out."""
    if not torn:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    found = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return found.where(F.col("_corrupt").isNull()).drop("_corrupt")


def append_only(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only file of JSON lines: a last line that was not finished is left out, a broken one before it raises."""
    found = spark.read.schema(schema + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    texts = spark.read.format("binaryFile").load(path).select(F.coalesce(F.substring_index(F.decode("content", "UTF-8"), "\n", -1), F.lit("")).alias("tail"))
    tails = [r["tail"] for r in texts.where("tail <> ''").collect()]  # one unfinished line a file at most
    torn = F.coalesce(F.col("_corrupt").isin(*tails), F.lit(False)) if tails else F.lit(False)
    whole = F.col("_corrupt").isNull()
    checked = found.where(~torn).where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("broken line: "), F.col("_corrupt")))))
    return checked.drop("_corrupt")


def per_item(spark: SparkSession, path: str, schema: str, arm: str) -> DataFrame:
    """The rows of one arm of a table of JSON lines."""
    return jsonl(spark, path, schema).where(F.col("arm") == arm)


def split_file(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A file that is one JSON array of raw records; the place in it is part of the id."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{schemas.RAW.replace(' string', ': string')}>>").alias("rows"))
    each = whole.select(F.posexplode("rows").alias("i", "r"))
    return each.select(F.format_string("%s-%05d", F.lit(split), "i").alias("id"), F.lit(split).alias("split"), *record(F.col("r")))


def record(r: Column) -> list[Column]:
    support = clean(r["support"])
    wrong = F.array(*(clean(r[f"distractor{k}"]) for k in (1, 2, 3)))
    return [clean(r["question"]).alias("question"), clean(r["correct_answer"]).alias("correct"), wrong.alias("distractors"), support.alias("support"), (support != "").alias("grounded")]


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for order, split in enumerate(("train", "valid", "test")):
        part = split_file(spark, f"{folder}/{split}.json", split).withColumn("ordinal", F.struct(F.lit(order), "id"))
        out = part if out is None else out.unionByName(part)
    return out


def curriculum(spark: SparkSession, trees: list[dict[str, Any]]) -> DataFrame:
    """Objectives of parsed subject files; a missing field raises."""
    rows = [
        (s["id"], s["name"], u["id"], u["name"], float(u["weight"]), t["id"], t["name"], o["id"], o["text"], [k.strip().lower() for k in o["keywords"]], o["bloom"])
        for s in trees for u in s["units"] for t in u["topics"] for o in t["objectives"]
    ]
    return spark.createDataFrame(rows, schemas.OBJECTIVES)


def curriculum_problems(objectives: DataFrame) -> DataFrame:
    """(rule, id) of every broken rule of the curriculum."""
    units = objectives.select("subject", "unit_id", "unit_weight").distinct()
    weights = units.groupBy("subject").agg(F.sum("unit_weight").alias("w")).where(F.abs(F.col("w") - 1) > 1e-6).select(F.lit("weights").alias("rule"), F.col("subject").alias("id"))
    twice = objectives.groupBy("lo_id").count().where("count > 1").select(F.lit("duplicate"), "lo_id")
    rules = {
        "unit_prefix": ~F.col("unit_id").startswith(F.col("subject")), "topic_prefix": ~F.col("topic_id").startswith(F.col("unit_id")), "lo_prefix": ~F.col("lo_id").startswith(F.col("topic_id")),
        "bloom": ~F.col("bloom").isin(*schemas.BLOOM), "keywords": F.size("keywords") < 3, "text": F.length("text") < 30,
    }
    each = objectives.select("lo_id", F.explode(F.array(*(F.when(bad, name) for name, bad in rules.items()))).alias("rule")).where("rule is not null").select("rule", "lo_id")
    return weights.union(twice).union(each)


def arms(spark: SparkSession, folder: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Arms that have a gen_<arm>.jsonl: named ones in their order, then the others by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "gen_*.jsonl").load(folder).select(F.regexp_extract("path", r"gen_([^/]*)\.jsonl$", 1).alias("arm"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("arm")) if order else F.lit(0)
    return files.orderBy(F.when(place > 0, place).otherwise(1 << 30), "arm")


def training_log(lines: DataFrame) -> DataFrame:
    """(iter, train_loss, val_loss, tokens_per_s, memory_gb) of log lines (value)."""
    number = lambda p: F.expr(f"try_cast(regexp_extract(value, r'{p}', 1) AS DOUBLE)")
    names = {"iter": r"Iter (\d+):", "train_loss": r"Train loss ([\d.]+)", "val_loss": r"Val loss ([\d.]+)", "tokens_per_s": r"Tokens/sec ([\d.]+)", "memory_gb": r"Peak mem ([\d.]+)"}
    rows = lines.select(*(number(p).alias(k) for k, p in names.items()))
    return rows.where("iter is not null").groupBy("iter").agg(*(F.max(c).alias(c) for c in ("train_loss", "val_loss", "tokens_per_s", "memory_gb")))


def vectors(spark: SparkSession, path: str, embedder_id: str) -> DataFrame:
    """Vectors of one embedder; raises where the table holds another's only."""
    found = spark.read.parquet(path)
    own = found.where(F.col("embedder_id") == embedder_id)
    if own.isEmpty() and not found.isEmpty():
        raise ValueError(f"vectors are not of {embedder_id}")
    return own


def graph(text: DataFrame) -> DataFrame:
    """(src, dst, sim) of a JSON object of edge lists (value); no rows give no edges."""
    parsed = text.select(F.explode(F.from_json("value", "map<string, array<struct<dst: string, sim: double>>>")).alias("src", "near"))
    return parsed.select("src", F.inline("near"))


def shots(prompts: DataFrame) -> DataFrame:
    """The first row of each format without misconception and avoid list."""
    from ..operators.grouping import first_by

    return first_by(prompts.where("target_misconception is null and coalesce(size(avoid), 0) <= 0"), ["format"], ["ordinal"])
