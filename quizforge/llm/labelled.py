"""Labelled samples for the classifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32(id as text) mod folds is fold; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(rows: DataFrame, labels: DataFrame, label: str, out: Column, each: tuple[int, int], label_id: str = "doc_id") -> tuple[DataFrame, float]:
    """(_id, _text, y) of at most each[y] labelled ids of _id, _text that are not held out, in hash order, and the log-odds to add.

    Labels other than 0 and 1, and null ids, are left out; labels that repeat an id count once, and of rows that share an id the
    one of the least text, so the sample is bounded whatever the rows. Where the labels are
    drawn at different rates, the odds of label 1 in the sample are not those of all labelled rows: what is
    learned from the sample lacks log(rate of 0 / rate of 1) in log-odds. 0 if both are drawn whole.
    """
    marks = labels.select(labels[label_id].alias("_id"), labels[label].cast("int").alias("y")).where("y in (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    ids = marks.where(~out)
    many = dict(ids.groupBy("y").count().collect())
    rate = [min(1.0, each[y] / many[y]) if many.get(y) else 1.0 for y in (0, 1)]
    order = F.xxhash64(F.col("_id"))
    picked = ids.where("y = 0").orderBy(order, "_id").limit(each[0]).union(ids.where("y = 1").orderBy(order, "_id").limit(each[1]))
    found = rows.join(F.broadcast(picked), "_id").groupBy("_id", "y").agg(F.min("_text").alias("_text"))
    return found.select("_id", "_text", "y"), math.log(rate[0] / rate[1])
