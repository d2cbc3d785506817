"""All queries: operators over the tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import response as R
from ..functions import text as T
from ..functions.dialect import Duck, Spark
from ..operators import curation, grouping, jsonval, leakage, quota, similarity, stats, textbook, tracing
from . import shared

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = Duck()
#: Resamples of a bootstrap.
DRAWS = 5000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name == "documents" and len(df.inputFiles()) < spark.sparkContext.defaultParallelism:
        df = df.repartition(spark.sparkContext.defaultParallelism)  # text is dear: a few files would keep a few cores busy
    return df


def _from_sql(make: Callable[[Spark], str]) -> Callable[[SparkSession, str], DataFrame]:
    text = make(Spark())

    def run(spark: SparkSession, sf: str) -> DataFrame:
        for name in TABLES:
            if f" {name}" in text:
                table(spark, sf, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


def items(spark: SparkSession, sf: str) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.concat(F.lit("split:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long") % 10
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("subject"), "source", F.when(h == 0, "test").when(h == 1, "valid").otherwise("train").alias("split"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    k = F.get_json_object("props", "$.k").cast("long")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf, "events").select(F.col("user_id").alias("session"), seq.alias("seq"), k.alias("item"), F.col("event_type").alias("lo"), ((k - 50) / 25).alias("b"), (F.col("value") < 35).alias("correct"), F.struct("ts", "event_id").alias("ord"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Links of equal passages, of equal questions (the first 12 words) with equal answers (the source), and of near vectors."""
    w = T.words(F.col("text"))
    d = items(spark, sf).select("id", T.passage_hash(F.col("text")).alias("p"), T.qa_hash(F.array_join(F.slice(w, 1, 12), " "), F.col("source")).alias("q"))
    near = similarity.cosine_pairs(vecs(spark, sf), 0.92).select("a", "b")
    known = near.join(d.select(F.col("id").alias("a")), "a").join(d.select(F.col("id").alias("b")), "b").select("a", "b")
    return grouping.star_links(d, "p").union(grouping.star_links(d, "q")).union(known)


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.assign_splits(grouping.groups(items(spark, sf).select("id", "split"), edges(spark, sf)))


_EDGES = """d AS (SELECT doc_id AS id, CASE WHEN trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[^a-z0-9 ]+', ' ', 'g'), '[ ]+', ' ', 'g')) <> '' THEN md5(trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[^a-z0-9 ]+', ' ', 'g'), '[ ]+', ' ', 'g'))) END AS p, md5(array_to_string((regexp_extract_all(lower(text), '[a-z0-9]+'))[1:12], ' ') || '||' || lower(source)) AS q FROM documents),
e AS (SELECT id AS a, min(id) OVER (PARTITION BY p) AS b FROM d WHERE p IS NOT NULL UNION SELECT id, min(id) OVER (PARTITION BY q) FROM d UNION SELECT x.vec_id, y.vec_id FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id JOIN documents ON doc_id = y.vec_id WHERE list_dot_product(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) > 0.92),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
walk AS (SELECT id AS node, id AS seen FROM d UNION SELECT walk.node, u.b FROM walk JOIN u ON u.a = walk.seen),
g AS (SELECT node AS id, min(seen) AS grp FROM walk GROUP BY node)"""
_SPLIT = f"s AS (SELECT id, split FROM items), f AS (SELECT g.id, g.grp, s.split, min(CASE split WHEN 'test' THEN 1 WHEN 'valid' THEN 2 ELSE 3 END) OVER (PARTITION BY g.grp) AS r FROM g JOIN s ON s.id = g.id)"


def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.groups(items(spark, sf).select("id"), edges(spark, sf)).select("id", F.col("group").alias("grp"))


def split_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return grouped(spark, sf).select("id", "split", "final_split")


def split_moves(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.moves(grouped(spark, sf))


def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.leaks(grouped(spark, sf)).agg(F.count("*").alias("leaks"))


def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return grouped(spark, sf).groupBy("group").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_groups"), F.max("n").alias("largest"))


def shingle_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.shingles(F.col("text"))).cast("long").alias("n"))


def _grams(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return leakage.grams(table(spark, sf, "benchmark"), "item_id", "text"), leakage.grams(table(spark, sf, "documents"), "doc_id", "text")


def containment_best(spark: SparkSession, sf: str) -> DataFrame:
    probe, index = _grams(spark, sf)
    return leakage.best_containment(probe, index).select("id", "best", F.round("ratio", 6).alias("ratio"))


def containment_both_ways(spark: SparkSession, sf: str) -> DataFrame:
    index, probe = _grams(spark, sf)
    return leakage.best_containment(probe, index, both_ways=True).select("id", "best", F.round("ratio", 6).alias("ratio"))


def containment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.containment_pairs(leakage.grams(table(spark, sf, "documents"), "doc_id", "text"))


_SH = f"SELECT id, len(g) AS size, unnest(g) AS gram FROM (SELECT id, list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM (SELECT ID AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM TABLE_))"
_GRAMS = "bg AS (" + _SH.replace("ID AS id", "item_id AS id").replace("TABLE_", "benchmark") + "), dg AS (" + _SH.replace("ID AS id", "doc_id AS id").replace("TABLE_", "documents") + ")"


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("subject"))


def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.cosine_pairs(vecs(spark, sf), 0.35).select("a", "b", F.round("cos", 6).alias("cos"))


def _gates(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    c = similarity.centroids(v)
    scores = v.select("id", "vec").crossJoin(F.broadcast(c)).select("id", "subject", F.round(similarity.dot("vec", "centroid"), 9).alias("score"))
    return similarity.gate(scores)


def centroid_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _gates(spark, sf).select("id", "subject", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def topk_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    entries = v.select(F.col("id").alias("entry"), F.col("vec").alias("evec"), "subject")
    found = similarity.top_k(v.select("id", "vec"), entries, 3, _gates(spark, sf).select("id", "subject"), but_self=True)
    return found.select("id", "entry", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def aligned_target(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    own = v.join(similarity.centroids(v), "subject").select("id", "subject", similarity.dot("vec", "centroid").alias("score"))
    gates = _gates(spark, sf).select("id", F.col("subject").alias("g")).groupBy("id").agg(F.collect_set("g").alias("g"))
    return own.join(gates, "id").select("id", F.round("score", 6).alias("score"), (F.array_contains("g", F.col("subject")) & (F.col("score") >= 0.2)).alias("aligned"))


def tau_calibration_cv(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf)
    own = curation.halves(v.join(similarity.centroids(v), "subject").select("id", similarity.dot("vec", "centroid").alias("score")), "fold")
    tau = own.groupBy((1 - F.col("fold")).alias("fold")).agg(F.percentile("score", F.lit(0.2)).alias("tau"))
    return own.join(tau, "fold").groupBy("fold").agg(F.round(F.first("tau"), 6).alias("tau"), F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("tau")).alias("aligned"))


def novelty_max_cos(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf).withColumnRenamed("subject", "group")
    return similarity.novelty(v, v, 0.4).select("id", F.round("max_cos", 6).alias("max_cos"), "novel")


def neighbour_graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    pairs, (over_02, over_03), median = similarity.pair_stats(vecs(spark, sf), [0.2, 0.3])
    return spark.createDataFrame([(pairs, over_02, over_03, median)], "pairs long, over_02 long, over_03 long, median double").withColumn("median", F.round("median", 6))


def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    e = similarity.hashed_embedding(table(spark, sf, "documents"), "doc_id", T.words(F.col("text")))
    return e.groupBy("id").agg(F.count("*").alias("nonzero"), F.round(F.max("w"), 6).alias("most"), F.round(F.sum(F.col("w") * F.col("bucket")), 4).alias("moment"))


def same_answer_leaks(spark: SparkSession, sf: str) -> DataFrame:
    v = vecs(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("the "), "source").alias("answer")), "id")
    return leakage.same_answer(v, v, 0.3).select("id", "other", F.round("cos", 6).alias("cos"))


def difficulty_tertiles(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.log1p(F.size(T.words(F.col("text")))).alias("x"), F.col("text").rlike("(?i) (if|in|the) ").cast("double").alias("y"))
    m = d.agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"))
    z = d.crossJoin(F.broadcast(m)).select("id", (0.75 * (F.col("x") - F.col("mx")) / F.when(F.col("sx") > 0, F.col("sx")).otherwise(1) + 0.25 * (F.col("y") - F.col("my")) / F.when(F.col("sy") > 0, F.col("sy")).otherwise(1)).alias("score"))
    cuts = z.agg(F.percentile("score", F.lit(1 / 3)).alias("lo"), F.percentile("score", F.lit(2 / 3)).alias("hi"))
    label = F.when(F.col("score") < F.col("lo"), "easy").when(F.col("score") < F.col("hi"), "medium").otherwise("hard")
    return z.crossJoin(F.broadcast(cuts)).groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def balanced_letters_fixed(spark: SparkSession, sf: str) -> DataFrame:
    i = items(spark, sf).select("id")
    fixed = i.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("letter"))
    return quota.balanced_letters_fixed(i.where("id % 3 <> 0"), fixed)


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return j.select(F.col("doc_id").alias("id"), "quality", "toxic")


def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    d = _arms(spark, sf).select("id", (F.col("quality") - (1 - F.col("toxic"))).alias("d"))
    return stats.interval(stats.bootstrap(d, "d", DRAWS, "pair", ["id"])).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def independent_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    d = _arms(spark, sf)
    a = stats.bootstrap(d.where("id % 2 = 0"), "quality", DRAWS, "a", ["id"]).withColumnRenamed("mean", "ma")
    b = stats.bootstrap(d.where("id % 2 = 1"), "quality", DRAWS, "b", ["id"]).withColumnRenamed("mean", "mb")
    diff = a.join(b, "draw").select((F.col("ma") - F.col("mb")).alias("mean"))
    return stats.interval(diff).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def _boot(select: str, seed: str, name: str) -> str:
    h = D.hex8(f"md5('{seed}:' || CAST(r.i AS VARCHAR) || ':' || CAST(k.i AS VARCHAR))")
    return f"""{name}0 AS ({select}), {name}p AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, x FROM {name}0), {name}k AS (SELECT r.i AS draw, {h} % n AS pos FROM (SELECT count(*) AS n FROM {name}0) c, range({DRAWS}) r(i), (SELECT unnest(range(count(*))) AS i FROM {name}0) k), {name} AS (SELECT draw, avg(x) AS mean FROM {name}k JOIN {name}p USING (pos) GROUP BY draw)"""


def fisher(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "labels").agg(*(F.count_if((F.col("quality") == q) & (F.col("toxic") == t)).cast("int").alias(n) for n, q, t in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("d", 0, 0))))
    return stats.fisher(c).select(*(F.col(x).cast("long").alias(x) for x in "abcd"), F.round("p", 6).alias("p"))


def wilson(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    return g.withColumn("w", stats.wilson(F.col("k"), F.col("n"))).select("toxic", F.col("n"), F.round("w.lo", 6).alias("lo"), F.round("w.hi", 6).alias("hi"))


def eap_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return tracing.trajectory(responses(spark, sf)).select("session", "seq", F.round("theta", 5).alias("theta"), F.round("sd", 5).alias("sd"))


_EAP = f"""{shared.responses(D)}, grid AS (SELECT i / 16.0::DOUBLE - 5 AS theta FROM range(161) t(i)),
l AS (SELECT session, seq, theta, -theta * theta / 2 + sum(ln(CASE WHEN correct THEN 0.25 + 0.75 / (1 + exp(-(theta - b))) ELSE 1 - (0.25 + 0.75 / (1 + exp(-(theta - b)))) END)) OVER (PARTITION BY session, theta ORDER BY seq ROWS UNBOUNDED PRECEDING) AS lw FROM responses, grid),
w AS (SELECT session, seq, theta, exp(lw - max(lw) OVER (PARTITION BY session, seq)) AS w FROM l),
m AS (SELECT session, seq, sum(w * theta) / sum(w) AS theta, sqrt(greatest(0, sum(w * theta * theta) / sum(w) - pow(sum(w * theta) / sum(w), 2))) AS sd FROM w GROUP BY session, seq)"""


def eap_stop(spark: SparkSession, sf: str) -> DataFrame:
    t = tracing.trajectory(responses(spark, sf))
    return t.where(R.should_stop(F.col("seq"), F.round("sd", 7), F.lit(60), F.lit(0.5))).groupBy("session").agg(F.min("seq").alias("stop"))


def bkt_mastery(spark: SparkSession, sf: str) -> DataFrame:
    return tracing.mastery(responses(spark, sf)).select("session", "lo", "n", F.round("mastery", 6).alias("mastery"))


_BKT = f"""WITH RECURSIVE {shared.responses(D)}, o AS (SELECT session, lo, b, correct, row_number() OVER (PARTITION BY session, lo ORDER BY seq) AS i FROM responses),
f AS (SELECT session, lo, 0::BIGINT AS i, 0.2::DOUBLE AS m FROM o GROUP BY session, lo UNION ALL
SELECT p.session, p.lo, p.i, post + (1 - post) * 0.12 FROM (SELECT f.session, f.lo, o.i, CASE WHEN correct THEN m * (1 - s) / greatest(m * (1 - s) + (1 - m) * g, 1e-6) ELSE m * s / greatest(m * s + (1 - m) * (1 - g), 1e-6) END AS post
 FROM (SELECT session, lo, i, b, correct, least(greatest(0.25 - 0.08 * b, 0.05), 0.45) AS g, least(greatest(0.10 + 0.08 * b, 0.02), 0.40) AS s FROM o) o JOIN f ON f.session = o.session AND f.lo = o.lo AND o.i = f.i + 1) p)"""


def elo_calibration(spark: SparkSession, sf: str) -> DataFrame:
    r = responses(spark, sf)
    return tracing.calibrate(r, tracing.theta_before(tracing.trajectory(r), r)).select("item", "n", F.round("b", 5).alias("b"), F.round("b_used", 5).alias("b_used"))


def unit_mastery(spark: SparkSession, sf: str) -> DataFrame:
    state = tracing.mastery(responses(spark, sf))
    objectives = spark.createDataFrame([("click", "u1"), ("view", "u1"), ("purchase", "u2"), ("signup", "u2"), ("error", "u3"), ("never", "u4")], "lo string, unit string")
    return tracing.unit_mastery(state, objectives).select("session", "unit", F.round("mastery", 6).alias("mastery"), "observed", "objectives", "answered")


# Rows only: offsets, recursion in text, state.
def balanced_json(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").select("event_id", F.concat("event_type", F.lit(' {x "}" {"a": '), "props", F.lit("} tail }")).alias("t"))
    block = jsonval.extract_json(F.col("t"))
    return t.select("event_id", block.alias("block")).withColumn("reason", jsonval.parse_reason(F.col("block")))


def indel_ratio(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("a"))
    return n.crossJoin(n.select(F.col("a").alias("b"))).where("a < b").select("a", "b", F.round(T.indel_ratio(F.col("a"), F.col("b")), 3).alias("ratio"))


def move_key(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("B is correct. Vitamin A is not (C). "), "text").alias("t"))
    return t.select("conv_id", "turn", jsonval.move_explanation("t", F.lit("B"), F.lit("D")).alias("moved"))


def xml_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.length(textbook.plain_text("html")).alias("n"))


def _recorded(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    from ..streaming import sessions

    return sessions.record(sessions.responses(sessions.stream(spark, sf, pattern="events.parquet"))), grouping.shared_path(spark, "stream")


def session_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's final state of each session, over the files there are now."""
    from ..streaming import sessions

    rows = sessions.write_once(*_recorded(spark, sf))
    last = rows.groupBy("session").agg(F.max_by(F.struct("seq", "right", "theta", "sd"), "seq").alias("s")).select("session", "s.*")
    return last.select("session", F.col("seq").alias("n"), F.col("right").alias("correct"), F.round("theta", 5).alias("theta"), F.round("sd", 5).alias("sd"))


def elo_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Item difficulties after the stream of answers."""
    from ..streaming import sessions

    return sessions.calibrated(*_recorded(spark, sf)).select("item", "n", F.round("b", 5).alias("b"), F.round("b_used", 5).alias("b_used"))


def bkt_em(spark: SparkSession, sf: str) -> DataFrame:
    seqs = responses(spark, sf).groupBy("session", "lo").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "correct"))), lambda s: s["correct"].cast("int")).alias("seq"))
    par, trace = tracing.fit_em(grouping.cut(seqs.select("seq")))
    return spark.createDataFrame([(i, x, par["init"], par["learn"], par["guess"], par["slip"]) for i, x in enumerate(trace)], "iter int, log_lik double, init double, learn double, guess double, slip double")


def shared_mastery(spark: SparkSession, sf: str) -> DataFrame:
    near = spark.createDataFrame([("click", "view", 0.9), ("view", "click", 0.9)], "src string, dst string, sim double")
    return tracing.shared_mastery(responses(spark, sf), near)


DATAFRAME = [
    connected_components, split_assignment, split_moves, split_leakage, group_sizes, shingle_counts, containment_best, containment_both_ways, containment_pairs, cosine_pairs,
    centroid_gate, topk_retrieval, aligned_target, tau_calibration_cv, novelty_max_cos, neighbour_graph_stats, hash_embedding, same_answer_leaks, difficulty_tertiles, balanced_letters_fixed,
    paired_bootstrap, independent_bootstrap, fisher, wilson, eap_trajectory, eap_stop, bkt_mastery, elo_calibration, unit_mastery,
    balanced_json, indel_ratio, move_key, xml_text, session_stream, elo_stream, bkt_em, shared_mastery,
]

_GATE = f"""v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS BIGINT) AS subject FROM embeddings), x AS (SELECT subject, generate_subscripts(vec, 1) AS pos, unnest(vec) AS e FROM v),
m AS (SELECT subject, pos, avg(e) AS m FROM x GROUP BY subject, pos), c0 AS (SELECT subject, list(m ORDER BY pos) AS c FROM m GROUP BY subject), c AS (SELECT subject, list_transform(c, lambda y: y / sqrt(list_dot_product(c, c))) AS c FROM c0),
sc AS (SELECT id, c.subject, round(list_dot_product(vec, c), 9) AS score FROM v, c), rk AS (SELECT id, subject, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, subject) AS rank FROM sc), gate AS (SELECT id, subject, score, rank FROM (SELECT *, max(score) OVER (PARTITION BY id) AS best FROM rk WHERE rank <= 2) WHERE score >= best - 0.03),
own AS (SELECT v.id, v.subject, list_dot_product(vec, c) AS score FROM v JOIN c ON c.subject = v.subject)"""

ORACLES = {
    "connected_components": f"WITH RECURSIVE {_EDGES} SELECT id, grp FROM g",
    "split_assignment": f"WITH RECURSIVE {shared.items(D)}, {_EDGES}, {_SPLIT} SELECT id, split, CASE r WHEN 1 THEN 'test' WHEN 2 THEN 'valid' ELSE 'train' END AS final_split FROM f",
    "split_moves": f"WITH RECURSIVE {shared.items(D)}, {_EDGES}, {_SPLIT}, o AS (SELECT split, CASE r WHEN 1 THEN 'test' WHEN 2 THEN 'valid' ELSE 'train' END AS final FROM f) SELECT split || '->' || final AS move, count(*) AS n FROM o WHERE split <> final GROUP BY 1",
    "split_leakage": f"WITH RECURSIVE {shared.items(D)}, {_EDGES}, {_SPLIT} SELECT count(*) AS leaks FROM (SELECT grp FROM f GROUP BY grp HAVING count(DISTINCT r) > 1)",
    "group_sizes": f"WITH RECURSIVE {_EDGES} SELECT count(*) AS n_groups, max(n) AS largest FROM (SELECT grp, count(*) AS n FROM g GROUP BY grp)",
    "shingle_counts": "SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) AS BIGINT) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)",
    "containment_best": f"WITH {_GRAMS}, o AS (SELECT b.id, d.id AS o, count(*) / any_value(b.size) AS r FROM bg b JOIN dg d ON d.gram = b.gram GROUP BY b.id, d.id) SELECT id, arg_min(o, o) FILTER (WHERE r = m) AS best, round(max(r), 6) AS ratio FROM (SELECT *, max(r) OVER (PARTITION BY id) AS m FROM o) GROUP BY id",
    "containment_both_ways": f"WITH {_GRAMS}, o AS (SELECT d.id, b.id AS o, greatest(count(*) / any_value(b.size), count(*) / any_value(d.size)) AS r FROM bg b JOIN dg d ON d.gram = b.gram GROUP BY b.id, d.id) SELECT id, max(o) FILTER (WHERE r = m) AS best, round(max(r), 6) AS ratio FROM (SELECT *, max(r) OVER (PARTITION BY id) AS m FROM o) GROUP BY id",
    "containment_pairs": f"WITH {_GRAMS} SELECT a.id AS a, b.id AS b FROM dg a JOIN dg b ON b.gram = a.gram AND a.id < b.id GROUP BY a.id, b.id HAVING count(*) / least(any_value(a.size), any_value(b.size)) >= 0.5",
    "cosine_pairs": f"WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 6) AS cos FROM v a JOIN v b ON a.id < b.id WHERE list_dot_product(a.v, b.v) > 0.35",
    "centroid_gate": f"WITH {_GATE} SELECT id, subject, round(score, 6) AS score, rank FROM gate",
    "topk_retrieval": f"WITH {_GATE}, s AS (SELECT q.id, e.id AS entry, list_dot_product(q.vec, e.vec) AS score FROM v q JOIN gate ON gate.id = q.id JOIN v e ON e.subject = gate.subject AND e.id <> q.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, entry) AS rank FROM s) SELECT id, entry, round(score, 6) AS score, rank FROM r WHERE rank <= 3",
    "aligned_target": f"WITH {_GATE} SELECT own.id, round(own.score, 6) AS score, own.score >= 0.2 AND EXISTS (SELECT 1 FROM gate WHERE gate.id = own.id AND gate.subject = own.subject) AS aligned FROM own",
    "tau_calibration_cv": f"WITH {_GATE}, f AS (SELECT id, score, CASE WHEN row_number() OVER (ORDER BY md5('fold:' || id), id) <= (SELECT count(*) // 2 FROM own) THEN 0 ELSE 1 END AS fold FROM own), t AS (SELECT 1 - fold AS fold, quantile_cont(score, 0.2) AS tau FROM f GROUP BY 1 - fold) SELECT f.fold, round(any_value(tau), 6) AS tau, count(*) AS n, count_if(score >= tau) AS aligned FROM f JOIN t ON t.fold = f.fold GROUP BY f.fold",
    "novelty_max_cos": "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS g FROM embeddings), m AS (SELECT a.id, max(list_dot_product(a.v, b.v)) AS c FROM v a JOIN v b ON a.g <> b.g GROUP BY a.id) SELECT id, round(c, 6) AS max_cos, c < 0.4 AS novel FROM m",
    "neighbour_graph_stats": "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label AS g FROM embeddings), p AS (SELECT list_dot_product(a.v, b.v) AS c FROM v a JOIN v b ON a.g = b.g AND a.id < b.id) SELECT count(*) AS pairs, count_if(c > 0.2) AS over_02, count_if(c > 0.3) AS over_03, round(quantile_cont(c, 0.5), 6) AS median FROM p",
    "hash_embedding": f"WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]))) AS t FROM w), h AS (SELECT id, {D.hex8('md5(t)')} % 64 AS bucket, CASE WHEN substring(md5(t), 9, 1) < '8' THEN 1.0 ELSE -1.0 END AS s FROM t), s AS (SELECT id, bucket, sum(s)::DOUBLE AS s FROM h GROUP BY id, bucket HAVING sum(s) <> 0), e AS (SELECT id, bucket, s / sqrt(sum(s * s) OVER (PARTITION BY id)) AS w FROM s) SELECT id, count(*) AS nonzero, round(max(w), 6) AS most, round(sum(w * bucket), 4) AS moment FROM e GROUP BY id",
    "same_answer_leaks": "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, source AS s FROM embeddings JOIN documents ON doc_id = vec_id) SELECT a.id, b.id AS other, round(list_dot_product(a.v, b.v), 6) AS cos FROM v a JOIN v b ON a.s = b.s AND a.id <> b.id WHERE list_dot_product(a.v, b.v) >= 0.3",
    "difficulty_tertiles": f"WITH d AS (SELECT doc_id AS id, ln(1 + len(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS x, CASE WHEN regexp_matches(text, '(?i) (if|in|the) ') THEN 1.0 ELSE 0.0 END AS y FROM documents), m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM d), z AS (SELECT id, 0.75 * (x - mx) / CASE WHEN sx > 0 THEN sx ELSE 1 END + 0.25 * (y - my) / CASE WHEN sy > 0 THEN sy ELSE 1 END AS score FROM d, m), c AS (SELECT quantile_cont(score, 1/3) AS lo, quantile_cont(score, 2/3) AS hi FROM z) SELECT CASE WHEN score < lo THEN 'easy' WHEN score < hi THEN 'medium' ELSE 'hard' END AS label, count(*) AS n, round(avg(score), 6) AS mean FROM z, c GROUP BY 1",
    "balanced_letters_fixed": f"WITH {shared.items(D)}, i AS (SELECT id FROM items), fx AS (SELECT CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END AS letter FROM i WHERE id % 3 = 0), l AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D')) t(letter)), c AS (SELECT l.letter, count(fx.letter) AS c FROM l LEFT JOIN fx ON fx.letter = l.letter GROUP BY l.letter), sl AS (SELECT letter, row_number() OVER (ORDER BY c + k, letter) AS n FROM c, range(20000) r(k)), o AS (SELECT id, row_number() OVER (ORDER BY sha1(CAST(id AS VARCHAR)), id) AS n FROM i WHERE id % 3 <> 0) SELECT id, letter FROM o JOIN sl ON sl.n = o.n",
    "paired_bootstrap": "WITH " + _boot("SELECT l.doc_id AS id, quality - (1 - toxic) AS x FROM labels l JOIN documents d ON d.doc_id = l.doc_id", "pair", "b") + " SELECT round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM b",
    "independent_bootstrap": "WITH " + _boot("SELECT l.doc_id AS id, quality AS x FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.doc_id % 2 = 0", "a", "a") + ", " + _boot("SELECT l.doc_id AS id, quality AS x FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.doc_id % 2 = 1", "b", "b") + " SELECT round(quantile_cont(a.mean - b.mean, 0.025), 6) AS lo, round(quantile_cont(a.mean - b.mean, 0.975), 6) AS hi FROM a JOIN b ON b.draw = a.draw",
    "fisher": "WITH t AS (SELECT count_if(quality = 1 AND toxic = 1) AS a, count_if(quality = 1 AND toxic = 0) AS b, count_if(quality = 0 AND toxic = 1) AS c, count_if(quality = 0 AND toxic = 0) AS d FROM labels), x AS (SELECT *, unnest(range(greatest(0, a - d)::BIGINT, (least(a + b, a + c) + 1)::BIGINT)) AS x FROM t), p AS (SELECT *, lgamma(a + b + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) + lgamma(c + d + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS l, lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + lgamma(c + d + 1) - lgamma(c + 1) - lgamma(d + 1) AS lo, lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1) AS n FROM x) SELECT a, b, c, d, round(least(1.0, sum(CASE WHEN l <= lo + 1e-7 THEN exp(l - n) ELSE 0 END)), 6) AS p FROM p GROUP BY a, b, c, d",
    "wilson": "WITH g AS (SELECT toxic, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k, 1.959964 * 1.959964 AS z2 FROM labels GROUP BY toxic) SELECT toxic, n::BIGINT AS n, round(greatest(0.0, (k / n + z2 / (2 * n) - 1.959964 * sqrt(k / n * (1 - k / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS lo, round(least(1.0, (k / n + z2 / (2 * n) + 1.959964 * sqrt(k / n * (1 - k / n) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS hi FROM g",
    "eap_trajectory": f"WITH {_EAP} SELECT session, seq, round(theta, 5) AS theta, round(sd, 5) AS sd FROM m",
    "eap_stop": f"WITH {_EAP} SELECT session, min(seq) AS stop FROM m WHERE seq >= 60 OR (seq >= 3 AND round(sd, 7) < 0.5) GROUP BY session",
    "session_stream": f"WITH {_EAP}, ends AS (SELECT session, max(seq) AS n, count_if(correct) AS correct FROM responses GROUP BY session) SELECT ends.session, n, correct, round(theta, 5) AS theta, round(sd, 5) AS sd FROM ends JOIN m ON m.session = ends.session AND m.seq = ends.n",
    "bkt_mastery": f"{_BKT} SELECT session, lo, max(i) AS n, round(arg_max(m, i), 6) AS mastery FROM f GROUP BY session, lo",
    "elo_calibration": f"WITH RECURSIVE {_EAP}, r AS (SELECT a.item, a.b, a.correct, coalesce(m.theta, 0) AS t, row_number() OVER (PARTITION BY a.item ORDER BY a.ts, a.event_id) AS i FROM responses a LEFT JOIN m ON m.session = a.session AND m.seq = a.seq - 1), f AS (SELECT item, 0::BIGINT AS i, any_value(b) AS label, any_value(b) AS x FROM r GROUP BY item UNION ALL SELECT f.item, r.i, f.label, x - 0.15 / (1 + 0.02 * f.i) * (CASE WHEN correct THEN 1.0 ELSE 0.0 END - (0.25 + 0.75 / (1 + exp(-(t - x))))) FROM f JOIN r ON r.item = f.item AND r.i = f.i + 1), z AS (SELECT item, max(i) AS n, arg_max(x, i) AS x, any_value(label) AS label FROM f GROUP BY item) SELECT item, n, round(x, 5) AS b, round(CASE WHEN n < 5 THEN label ELSE x END, 5) AS b_used FROM z",
    "unit_mastery": f"{_BKT}, s AS (SELECT session, lo, max(i) AS n, arg_max(m, i) AS mastery FROM f GROUP BY session, lo), ob AS (SELECT * FROM (VALUES ('click', 'u1'), ('view', 'u1'), ('purchase', 'u2'), ('signup', 'u2'), ('error', 'u3'), ('never', 'u4')) t(lo, unit)), al AS (SELECT session, lo, unit FROM (SELECT DISTINCT session FROM s), ob) SELECT al.session, unit, round(avg(mastery), 6) AS mastery, count(mastery) AS observed, count(*) AS objectives, CAST(coalesce(sum(n), 0) AS BIGINT) AS answered FROM al LEFT JOIN s ON s.session = al.session AND s.lo = al.lo GROUP BY al.session, unit",
}


ORACLES["elo_stream"] = ORACLES["elo_calibration"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import applied

    return {name: _from_sql(make) for name, make in shared.QUERIES.items()} | {f.__name__: f for f in DATAFRAME} | applied.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import applied

    return {name: make(D) for name, make in shared.QUERIES.items()} | ORACLES | applied.ORACLES
