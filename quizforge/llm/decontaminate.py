"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, rows_of, table

WINDOW = 13
#: A document is contaminated where hits are at least one in this many words.
ONE_IN = 20
#: Bytes of all distinct benchmark windows, with their items, up to which they are broadcast; beyond, probes are shuffled to them.
BROADCAST_BYTES = 64 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-case A-Z (only these) and cut at ASCII that is neither letter nor digit."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, _GAP), "")


def _hash(ws: Column, at: Column | int, n: int) -> Column:
    """Of the n words from index at, counted from 0. (slice() in a lambda would copy the whole array each time.)"""
    return F.xxhash64(*(ws[at + j] for j in range(n)))


def _windows(ws: Column, n: int) -> Column:
    """(at, len, hash) of each run of n words; at counts from 1."""
    at = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), _hash(ws, i - 1, n).alias("hash")))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(len, hash, win, items): each distinct window and the ids, as strings, of the items that hold it."""
    ws = benchmark.select(benchmark[id_col].cast("string").alias("item"), words(F.coalesce(benchmark[text_col], F.lit(""))).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(window))
    each = ws.select("item", n.alias("len"), "ws", F.explode_outer(F.sequence(F.lit(1), F.size("ws") - n + 1)).alias("at"))
    win = each.select("item", "len", F.slice("ws", F.col("at"), F.col("len")).alias("win"))
    return win.groupBy("len", "win").agg(F.collect_set("item").alias("items")).select("len", F.coalesce(*(F.when(F.col("len") == n, _hash(F.col("win"), 0, n)) for n in range(1, window + 1))).alias("hash"), "win", "items")


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, one_in: int = ONE_IN, row: str | None = None) -> DataFrame:
    """A row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and _row.

    Word windows are hashed and probed against the hashed benchmark windows; a probe that meets one is
    verified word for word. The probe runs next to the scan: no document text is shuffled, only verified
    hits and one row per document are. A benchmark too large to broadcast is joined by hash instead. Null or empty text has no words and is not contaminated. A benchmark
    item without words has no windows; one without id hits but isn't listed; items that share an id count
    once. Rows that share a doc_id, or a text, are judged each. Other columns are not read. row names the
    column of row numbers, if docs has one.
    """
    win = benchmark_windows(benchmark, item_col, item_text_col, window)
    size = F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("items", " ")) + 100
    sizes = win.groupBy("len").agg(F.sum(size).alias("bytes")).collect()  # at most `window` rows
    side = win.withColumnRenamed("len", "wlen").withColumnRenamed("hash", "whash")
    parsed = rows_of(docs, id_col, text_col, row).select("_row", "_id", words(F.col("_text")).alias("ws"))
    probes = F.concat(F.array().cast("array<struct<at:int,len:int,hash:bigint>>"), *(_windows(F.col("ws"), x["len"]) for x in sorted(sizes, key=lambda x: x["len"])))
    same = (F.col("hash") == F.col("whash")) & (F.col("len") == F.col("wlen"))
    if sum(x["bytes"] for x in sizes) <= BROADCAST_BYTES:
        lone = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("hash")))  # keeps documents without hits
        # the _outer form: the plain one infers a filter that would cut the words anew for every window
        probed = parsed.select("_row", "_id", "ws", F.size("ws").alias("n_words"), F.concat(lone, probes).alias("probes")).select("_row", "_id", "ws", "n_words", F.inline_outer("probes"))
        met = probed.join(F.broadcast(side), same, "left")
        real = met.where((F.col("at") == 0) | (F.slice("ws", F.greatest("at", F.lit(1)), F.col("len")) == F.col("win")))
        found = real.where((F.col("at") == 0) | F.col("win").isNotNull()).select("_row", "_id", "n_words", F.when(F.col("at") > 0, F.struct("at", "len")).alias("hit"), F.when(F.col("at") > 0, F.col("items")).alias("items"))
        whole = found.groupBy("_row").agg(F.first("_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"), F.sort_array(F.collect_list("hit")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    else:
        # only (row, place, hash) is shuffled to the windows; what meets goes back to its document, which verifies it
        met = parsed.select("_row", F.inline(probes)).join(side, same).groupBy("_row").agg(F.collect_list(F.struct("at", "len", "win", "items")).alias("met"))
        hit = F.filter(F.coalesce("met", F.array().cast("array<struct<at:int,len:int,win:array<string>,items:array<string>>>")), lambda x: F.slice(F.col("ws"), x["at"], x["len"]) == x["win"])
        real = parsed.join(met, "_row", "left").select("_row", F.col("_id").alias("doc_id"), F.size("ws").cast("long").alias("n_words"), hit.alias("hit"))
        whole = real.select("_row", "doc_id", "n_words", F.sort_array(F.transform("hit", lambda x: F.struct(x["at"].alias("at"), x["len"].alias("len")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.transform("hit", lambda x: x["items"])))).alias("items"))
    # spans in order: each adds what lies beyond the furthest end so far
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["len"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(s["end"], x["at"]))).alias("n")),
        lambda s: s["n"],
    )
    out = whole.select("_row", "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how: object) -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever their names.

    A null or empty text has no words and stays. Rows that share an id, or a text, are judged each. No documents: no
    rows; an empty benchmark: all stay.
    """
    own, row = numbered(docs)
    gone = hits(own, benchmark, row=row, **how).where("contaminated").select(F.col("_row").alias(row))
    return own.join(gone, row, "left_anti").drop(row)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_row")


#: DuckDB: windows as joined strings, every document window probed by an equi-join.
OP2_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, ws, least(len(ws), 13) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
bwin AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT item_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM bw)),
lens AS (SELECT DISTINCT n FROM bwin),
dwin AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens)),
hit AS (SELECT doc_id, n, i, item_id FROM dwin JOIN bwin USING (n, win)),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""
