"""The response log as a stream: session state, item calibration, duplicate answers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import response as R
from ..operators.tracing import GRID, calibrate

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
OUT = "session long, seq long, ts timestamp_ntz, event_id long, item long, lo string, b double, correct boolean, p double, theta_pre double, theta double, sd double, mastery double, right long, misconception long"
STATE = "s string"


def stream(spark: SparkSession, folder: str, schema: str = EVENTS, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def responses(events: DataFrame) -> DataFrame:
    """(session, ord, item, lo, b, correct) of events."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("ord"), k.alias("item"), F.col("event_type").alias("lo"), ((k - 50) / 25).alias("b"), (F.col("value") < 35).alias("correct"), "ts")


def record(rows: DataFrame) -> DataFrame:
    """A row per response, in append mode: (session, seq, ord, item, lo, b, correct, p, theta_pre, theta, sd, mastery, right, misconception).

    The state of a session, as JSON: the grid's log weights, mastery and last wrong item by objective, counters, items seen. p is
    the chance predicted before the response. Responses of a batch are taken in their order.
    """
    points = np.linspace(-5, 5, GRID)

    def moments(lw: np.ndarray) -> tuple[float, float]:
        w = np.exp(lw - lw.max())
        w /= w.sum()
        theta = float(w @ points)
        return theta, float(np.sqrt(max(float(w @ points**2) - theta * theta, 0.0)))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"n": 0, "right": 0, "lw": list(-(points**2) / 2), "theta": 0.0, "mastery": {}, "wrong": {}, "seen": []}
        lw, out = np.asarray(s["lw"], float), []
        for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            prior, before = s["mastery"].get(r.lo, R.P_INIT), s["theta"]
            chance = R.GUESS + (1 - R.GUESS) / (1 + np.exp(-(before - r.b)))
            at = R.GUESS + (1 - R.GUESS) / (1 + np.exp(-(points - r.b)))
            lw = lw + np.log(at if r.correct else 1 - at)
            s["theta"], sd = moments(lw)
            g, slip = min(max(R.P_GUESS - R.B_SCALE * r.b, 0.05), 0.45), min(max(R.P_SLIP + R.B_SCALE * r.b, 0.02), 0.40)
            top = prior * (1 - slip) if r.correct else prior * slip
            post = top / max(top + ((1 - prior) * g if r.correct else (1 - prior) * (1 - g)), R.EPS)
            s["mastery"][r.lo] = post + (1 - post) * R.P_LEARN
            s["n"], s["right"] = s["n"] + 1, s["right"] + int(r.correct)
            if int(r.item) not in s["seen"]:
                s["seen"].append(int(r.item))
            if not r.correct:
                s["wrong"][r.lo] = int(r.item)
            out.append((key[0], s["n"], r.ts, r.event_id, int(r.item), r.lo, r.b, bool(r.correct), float(chance), before, s["theta"], sd, s["mastery"][r.lo], s["right"], s["wrong"].get(r.lo)))
        s["lw"] = lw.tolist()
        state.update((json.dumps(s),))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])
        frame["misconception"] = frame["misconception"].astype("Int64")
        yield frame

    flat = rows.select("session", "ord.ts", "ord.event_id", "item", "lo", "b", "correct")
    return flat.groupBy("session").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def write_once(rows: DataFrame, folder: str) -> DataFrame:
    """Run the stream over the files there are now into a Parquet table of the folder, and read it. A second run appends what is new."""
    spark = rows.sparkSession
    rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def once(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A session answers an item once within the delay."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["session", "item"])


def fold_items(path: str):
    """foreachBatch over record(): each batch's answers move their items, from the last version's b and n.

    The item table at path has one version a batch: a batch that runs again writes the same version.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = batch.select("session", "seq", F.struct("ts", "event_id").alias("ord"), "item", "b", "correct", "theta_pre")
        if number:
            old = spark.read.parquet(f"{path}/v={number - 1}")
        else:
            old = spark.createDataFrame([], "item long, n long, b double, label double")
        log = log.withColumnRenamed("b", "first").join(old, "item", "left").withColumns({"b": F.coalesce("b", "first"), "n": F.coalesce("n", F.lit(0)), "label": F.coalesce("label", "first")})
        labels = log.groupBy("item").agg(F.min_by("label", "ord").alias("new_label"))
        moved = calibrate(log, log.select("session", "seq", "theta_pre"), given=True).select("item", F.col("n").alias("more"), F.col("b").alias("now")).join(labels, "item")
        new = old.join(moved, "item", "full").select("item", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("now", "b").alias("b"), F.coalesce("label", "new_label").alias("label"))
        new.write.mode("overwrite").parquet(f"{path}/v={number}")

    return run


def calibrated(rows: DataFrame, folder: str) -> DataFrame:
    """(item, n, b, b_used) after the stream record() over the files there are now."""
    spark = rows.sparkSession
    query = rows.writeStream.foreachBatch(fold_items(f"{folder}/items")).option("checkpointLocation", f"{folder}/checkpoint-items").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    versions = spark.read.parquet(f"{folder}/items")
    last = versions.agg(F.max("v")).first()[0]
    return versions.where(F.col("v") == last).select("item", "n", "b", R.effective_b(F.col("b"), F.col("n"), F.col("label")).alias("b_used"))
