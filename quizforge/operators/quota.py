"""Exact quotas by deterministic draws: every random order is that of md5(seed:id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LETTERS = "ABCD"


def draw(seed: str, id_col: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))


def numbered(df: DataFrame, order: list, out: str, parts: int | None = None) -> DataFrame:
    """The place of each row, from 0, in a total order, without a window over all rows.

    Rows are dealt by range, counted per part, and numbered within their part from the sum of the parts before it.
    The parts are written between, since a second evaluation could deal them elsewhere.
    """
    from .grouping import cut

    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({k: c if isinstance(c, Column) else F.col(c) for k, c in zip(names, order, strict=True)})
    dealt = cut(keyed.repartitionByRange(n, *names).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")  # a row a part
    within = Window.partitionBy("_part").orderBy(*names)
    return dealt.join(F.broadcast(sizes), "_part").withColumn(out, F.col("_before") + F.row_number().over(within) - 1).drop("_part", "_before", *names)


def stratified(pool: DataFrame, stratum: str, n: int, seed: str, id_col: str = "id") -> DataFrame:
    """n rows, proportional to strata with the largest remainders (ties: the stratum); all rows if n is as many.

    Ranks are taken within strata; no window spans the pool.
    """
    size = pool.groupBy(stratum).agg(F.count("*").alias("k"))
    total = size.agg(F.sum("k").alias("total"))
    share = size.crossJoin(F.broadcast(total)).withColumn("exact", F.col("k") * F.least(F.lit(n), F.col("total")) / F.col("total"))
    w = Window.orderBy(F.desc(F.col("exact") - F.floor("exact")), stratum)
    left = F.least(F.lit(n), F.col("total")) - F.sum(F.floor("exact")).over(Window.partitionBy())
    alloc = share.withColumn("take", F.floor("exact") + (F.row_number().over(w) <= left).cast("long")).select(stratum, "take")
    ranked = pool.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, id_col), id_col)))
    return ranked.join(F.broadcast(alloc), stratum).where("_n <= take").drop("_n", "take")


def balanced_letters(ids: DataFrame, seed: str, id_col: str = "id") -> DataFrame:
    """Letters in turn over the drawn order: counts differ by one at most."""
    placed = numbered(ids, [draw(seed, id_col), id_col], "_n")
    return placed.withColumn("letter", F.substring(F.lit(LETTERS), (F.col("_n") % 4 + 1).cast("int"), 1)).drop("_n")


def balanced_letters_fixed(free: DataFrame, fixed: DataFrame, id_col: str = "id") -> DataFrame:
    """Free ids in sha1 order, each to the letter used least so far (ties: the first), fixed letters counted.

    Closed form: the k-th use of a letter has the slot (its fixed count + k, letter); the i-th id takes the i-th slot.
    """
    n = free.count()
    spark = free.sparkSession
    letters = spark.createDataFrame([(x,) for x in LETTERS], "letter string")
    have = letters.join(fixed.groupBy("letter").agg(F.count("*").alias("c")), "letter", "left").na.fill(0, ["c"])
    slots = have.crossJoin(spark.range(n).select(F.col("id").alias("k"))).select("letter", (F.col("c") + F.col("k")).alias("level"))
    slots = numbered(slots, ["level", "letter"], "i").where(F.col("i") < n).select("i", "letter")
    order = numbered(free, [F.sha1(F.col(id_col).cast("string")), id_col], "i")
    return order.join(slots, "i").drop("i")


def subset(pool: DataFrame, fraction: float, n: int, seed: str, can: Column, id_col: str = "id") -> DataFrame:
    """round(fraction * n) drawn rows of those that can be, or all of these if they are fewer."""
    return pool.where(can).orderBy(draw(seed, id_col), id_col).limit(round(fraction * n))


def per_key(df: DataFrame, key: str, n: int, order: list, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; rank names a column for their places."""
    found = df.withColumn(rank or "_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank or "_n") <= n)
    return found if rank else found.drop("_n")


def avoid(ids: DataFrame, key: str, seed: str, id_col: str = "id") -> DataFrame:
    """avoid: up to two others of the same key, the next ones in drawn order (after the last the first)."""
    w = Window.partitionBy(key).orderBy(draw(seed, id_col), id_col)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a, b, f1, f2 = F.lead(id_col, 1).over(w), F.lead(id_col, 2).over(w), F.first(id_col).over(whole), F.nth_value(id_col, 2).over(whole)
    placed = ids.withColumns({"_a": a, "_b": b, "_f1": f1, "_f2": f2})
    two = F.when(F.col("_a").isNull(), F.col("_f2")).when(F.col("_b").isNull(), F.col("_f1")).otherwise(F.col("_b"))
    others = F.array_distinct(F.filter(F.array(F.coalesce("_a", "_f1"), two), lambda x: x.isNotNull() & (x != F.col(id_col))))
    return placed.withColumn("avoid", others).drop("_a", "_b", "_f1", "_f2")


def holdout(id_col: str, fraction: float = 0.05) -> Column:
    return F.conv(F.substring(F.sha1(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("double") / 4294967295.0 < fraction


def blinded(items: DataFrame, arm: str, n: int, seed: str, id_col: str = "id") -> DataFrame:
    """n of each arm, in one drawn order, under aliases a000, a001, ..."""
    ranked = numbered(per_key(items, arm, n, [draw(seed, id_col), id_col]), [draw(seed + "/order", id_col), arm, id_col], "_n")
    return ranked.withColumn("audit_id", F.format_string("a%03d", "_n")).drop("_n")


def shuffle_options(options: Column, key: Column, letter: Column, seed: str, id_col: str) -> Column:
    """letter -> option: the key at its letter, the others in drawn order on the letters left."""
    order = F.array_sort(F.transform(options, lambda o: F.struct(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), o)).alias("h"), o.alias("o"))))
    rest = F.filter(F.transform(order, lambda s: s["o"]), lambda o: o != key)
    places = F.filter(F.array(*map(F.lit, LETTERS)), lambda x: x != letter)
    return F.map_from_entries(F.array_sort(F.concat(F.arrays_zip(places.alias("k"), rest.alias("v")), F.array(F.struct(letter.alias("k"), key.alias("v"))))))


def round_robin(pool: DataFrame, section: str, seed: str, rounds: int, n: int, screen: Column, id_col: str = "id") -> DataFrame:
    """One of each section a round, in drawn order within sections and section order within rounds: the first n that pass the screen."""
    ranked = pool.withColumn("_round", F.row_number().over(Window.partitionBy(section).orderBy(draw(seed, id_col), id_col))).where(F.col("_round") <= rounds)
    return ranked.where(screen).orderBy("_round", section).limit(n).drop("_round")
