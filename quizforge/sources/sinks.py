"""Writers: JSON lines, resumable appends, partition replacement, pins, samples, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import pending
from ..operators.grouping import first_by
from ..operators.quota import per_key


def jsonl(df: DataFrame, path: str) -> None:
    """Whole files only appear once the job commits."""
    df.write.mode("overwrite").json(path)


def outputs(frames: dict[str, DataFrame], folder: str) -> None:
    for name, df in frames.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def append_new(df: DataFrame, path: str, keys: list[str], schema: str) -> int:
    """Append the rows whose keys the table lacks; returns how many."""
    spark = df.sparkSession
    try:
        done = spark.read.schema(schema).parquet(path)
    except Exception as e:  # the table's first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], schema)
    new = pending(df, done, keys)
    n = new.count()
    new.write.mode("append").parquet(path)
    return n


def replace_partition(df: DataFrame, path: str, key: str = "arm") -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def pins(spark, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def sample(items: DataFrame, each: int = 5, ungrounded: int = 20) -> DataFrame:
    """Up to so many aligned rows of each objective and so many ungrounded ones; an id once."""
    a = per_key(items.where("aligned"), "lo_id", each, ["id"]).withColumn("_from", F.lit(0))
    b = items.where("not grounded").orderBy("id").limit(ungrounded).withColumn("_from", F.lit(1))
    return first_by(a.unionByName(b), ["id"], ["_from"]).drop("_from")


def card(frames: dict[str, DataFrame]) -> dict[str, list[dict]]:
    """Aggregated frames as plain data for a report."""
    return {name: [r.asDict(True) for r in df.collect()] for name, df in frames.items()}
