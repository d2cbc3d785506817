"""Pools, objectives, registries: what is joined, drawn and screened before items are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quota import draw, numbered


def with_objectives(items: DataFrame, objectives: DataFrame) -> DataFrame:
    """Items with their objective's columns; one of an unknown objective is left out."""
    return items.join(objectives, "lo_id")


def candidates(items: DataFrame, used: DataFrame, split: str) -> DataFrame:
    """Grounded items of a split that hold a sentence and are not in `used`; those of other splits than test are aligned too."""
    fit = F.col("grounded") & (F.col("final_split") == split) & (F.col("n_sentences") > 0)
    return items.where(fit if split == "test" else fit & F.col("aligned")).join(used.select("id"), "id", "left_anti")


def first_labelled(pool: DataFrame, n: int, label: str, order: list) -> DataFrame:
    return pool.where(F.col(label).isNotNull()).orderBy(*order).limit(n)


def take_screened(pool: DataFrame, screens: dict[str, Column], n: int, order: list) -> tuple[DataFrame, DataFrame]:
    """(the first n that pass all screens, how many of the whole pool each screen stops first)."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in screens.items()), F.lit("kept"))
    marked = pool.withColumn("reason", reason)
    return marked.where("reason = 'kept'").drop("reason").orderBy(*order).limit(n), marked.groupBy("reason").agg(F.count("*").alias("n"))


def simple_sample(pool: DataFrame, n: int, seed: str, id_col: str = "id") -> DataFrame:
    return pool.orderBy(draw(seed, id_col), id_col).limit(n)


def in_turn(ids: DataFrame, values: tuple[str, ...], seed: str, out: str, id_col: str = "id") -> DataFrame:
    """Values in turn over the drawn order: counts differ by one at most."""
    placed = numbered(ids, [draw(seed, id_col), id_col], "_n")
    return placed.withColumn(out, F.element_at(F.array(*map(F.lit, values)), (F.col("_n") % len(values) + 1).cast("int"))).drop("_n")


def halves(ids: DataFrame, seed: str, id_col: str = "id") -> DataFrame:
    """fold 0 for exactly half of the ids, rounded down, in drawn order; else 1."""
    n = ids.count()
    return numbered(ids, [draw(seed, id_col), id_col], "_n").withColumn("fold", (F.col("_n") >= n // 2).cast("int")).drop("_n")


def promoted_explanation(text: Column, letter: Column) -> Column:
    """The explanation with the letter at its start made the key's; other letters stay."""
    return F.when(text.rlike(r"^[ABCD] is correct\."), F.concat(letter, F.substring(text, 2, 1 << 30))).otherwise(text)


def difficulty_by_split(items: DataFrame) -> DataFrame:
    """Grounded items of each final split by difficulty: a column a label, 0 where there is none."""
    return items.where("grounded").groupBy("final_split").pivot("difficulty", ["easy", "medium", "hard"]).agg(F.count(F.lit(1))).na.fill(0)


def mix(rows: DataFrame) -> DataFrame:
    """Counts of format/misconception, the latter 'none' where there is none."""
    kind = F.concat("format", F.lit("/"), F.when(F.coalesce("misconception", F.lit("")) == "", "none").otherwise(F.col("misconception")))
    return rows.groupBy(kind.alias("mix")).agg(F.count("*").alias("n"))


def zipped(prompts: DataFrame, metas: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of two files in step (ordinal), with their tagged item (id). Raises where the files differ in length or an item is not of training."""
    both = prompts.join(metas, "ordinal", "full")
    if not both.where("id is null or prompt is null").isEmpty():
        raise ValueError("the files do not match row by row")
    out = both.join(items, "id", "left")
    if not out.where("final_split is null or final_split <> 'train'").isEmpty():
        raise ValueError("a prompt whose item is not of the training split")
    return out


def by_bare_id(bank: DataFrame, groups: DataFrame, prefix: str) -> DataFrame:
    """Bank rows with the group of the item they stem from: ids are equal but for the prefix."""
    return bank.withColumn("_bare", F.regexp_replace("id", f"^{prefix}", "")).join(groups.withColumnRenamed("id", "_bare"), "_bare").drop("_bare")


def same_titles(sections: DataFrame, other: DataFrame, title: Column) -> DataFrame:
    """(module, other): sections of two books with one normalised title; of several in the other book the last counts."""
    last = other.select(F.col("module").alias("other"), title.alias("t"), "ordinal").groupBy("t").agg(F.max_by("other", "ordinal").alias("other"))
    return sections.select("module", title.alias("t")).join(last, "t").select("module", "other")


def registry(text: DataFrame) -> DataFrame:
    """(key, subject, role, sha) of a JSON registry of books (value)."""
    return text.select(F.inline(F.from_json("value", "array<struct<key: string, subject: string, role: string, sha: string>>")))


def calibration(modes: DataFrame, mode: str, items: DataFrame) -> DataFrame:
    """Items aligned by the mode's tau; a mode without tau gives a null tau, and then nothing is aligned."""
    tau = modes.where(F.col("mode") == mode).agg(F.max("tau").alias("tau"))
    return items.crossJoin(F.broadcast(tau)).withColumn("aligned", F.coalesce(F.col("score") >= F.col("tau"), F.lit(False)))


def bank(spark: SparkSession, built: str, sample: str, generated: str | None, schema: str) -> DataFrame:
    """The built bank if there is one, else the sample, and generated items; of an id the built row stays."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(built)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    base = spark.read.schema(schema).json(built if there else sample)
    if generated is None:
        return base
    new = spark.read.schema(schema).json(generated)
    return base.unionByName(new.join(base.select("id"), "id", "left_anti"))


def lagged(rows: DataFrame) -> DataFrame:
    """Paragraphs (doc, pos, sec, text, equation) with `gap`, whether one is right before, and text null where an equation of its section follows."""
    w = Window.partitionBy("doc").orderBy("pos")
    leads = F.coalesce(F.lead("equation").over(w) & (F.lead("sec").over(w) == F.col("sec")), F.lit(False))
    text = F.when(~leads & ~F.col("equation"), F.col("text"))
    cut = rows.withColumn("text", text)
    return cut.withColumn("gap", F.lag(F.col("text").isNull(), 1, True).over(w))


def sampled_target(choices: Column, stem: Column, answer: Column, explanation: Column, lo_id: Column, difficulty: Column) -> Column:
    """The contract's fields of a sampled item, options in letter order; the requested objective and difficulty replace its own."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(choices)))
    return F.struct(stem.alias("stem"), ordered.alias("choices"), answer.alias("answer"), explanation.alias("explanation"), lo_id.alias("lo_id"), difficulty.alias("difficulty"))


def copied_share(field: Column, source: Column, words: Column, n: int = 4) -> Column:
    """The share of a field's words that stand in a run of n words found word for word in the source."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.when(F.contains(source, F.concat(F.lit(" "), F.array_join(F.slice(words, i + 1, n), " "), F.lit(" "))), i))
    starts = F.when(F.size(words) >= n, F.filter(runs, lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + n - 1)))))
    return F.when(F.size(words) > 0, covered / F.size(words)).otherwise(F.lit(0.0))
