"""Near-duplicate groups and leak-free splits."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Splits by priority: a group goes to the first one that any member has.
PRIORITY = ("test", "valid", "train")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder in the shared checkpoint folder; it goes when the application ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = os.path.join(tempfile.gettempdir(), f"shared-{spark.sparkContext.applicationId}")
    path = f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    files.deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the table of cut() once no plan needs it."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def star_links(items: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """(a, b): each item to the least one with its key. Null keys never link."""
    first = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(id_col).alias("b"))
    return items.join(first, key).where(F.col(id_col) != F.col("b")).select(F.col(id_col).alias("a"), "b")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable. Labels spread along edges and jump to their own label's label."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        spread = label.join(near, label["node"] == near["a"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = spread.select(F.col("node").alias("via"), F.col("root").alias("far"))
        new = cut(spread.join(jump, spread["root"] == jump["via"], "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "old"))
        drop_cut(label)
        label = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            drop_cut(both)
            return label


def groups(items: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Items with their group: the least id of their component."""
    found = connected(edges)
    return items.join(found, items[id_col] == found["node"], "left").withColumn("group", F.coalesce("root", id_col)).drop("node", "root")


def assign_splits(items: DataFrame, split: str = "split", group: str = "group") -> DataFrame:
    """final_split: of the splits of a group's members the first by priority, so no group spans two."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col(split))
    best = items.groupBy(group).agg(F.min(rank).alias("_rank"))
    return items.join(best, group).withColumn("final_split", F.element_at(F.array(*map(F.lit, PRIORITY)), F.col("_rank").cast("int"))).drop("_rank")


def moves(items: DataFrame, split: str = "split") -> DataFrame:
    return items.where(F.col(split) != F.col("final_split")).groupBy(F.concat(split, F.lit("->"), "final_split").alias("move")).agg(F.count("*").alias("n"))


def leaks(items: DataFrame, group: str = "group") -> DataFrame:
    """Groups that span more than one final split: none, after assign_splits()."""
    return items.groupBy(group).agg(F.countDistinct("final_split").alias("splits")).where("splits > 1")


def link_counts(items: DataFrame, stages: list[tuple[str, DataFrame]], id_col: str = "id") -> list[tuple[str, int]]:
    """How many unions each edge source adds after those before it: the drop in the number of groups."""
    out, edges, have = [], None, items.count()
    for name, more in stages:
        edges = more if edges is None else edges.union(more)
        now = groups(items, edges, id_col).select("group").distinct().count()
        out.append((name, have - now))
        have = now
    return out


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of the rows of each key the first in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
