"""Queries stated once in SQL: run by Spark, checked in DuckDB through the dialect's spellings."""

from __future__ import annotations

from collections.abc import Callable

from ..functions.dialect import Duck, Spark
from ..functions.text import HIGHER, RECALL, STOP


def items(D: Spark) -> str:
    h = D.hex8("md5('split:' || CAST(doc_id AS STRING))") if D.name == "spark" else D.hex8("md5('split:' || CAST(doc_id AS VARCHAR))")
    return f"""items AS (SELECT doc_id AS id, text AS support, lang AS subject, source, CASE {h} % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split FROM documents)"""


def responses(D: Spark) -> str:
    return f"""responses AS (SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, event_id, ts, event_type AS lo, CAST({D.field('props', 'k')} AS BIGINT) AS item, (CAST({D.field('props', 'k')} AS DOUBLE) - 50) / 25 AS b, value < 35 AS correct, value FROM events)"""


def arms(D: Spark) -> str:
    return f"""arms AS (SELECT d.doc_id AS id, 'arm' || CAST({D.hex8('md5(d.source)')} % 3 AS VARCHAR(5)) AS arm, d.lang AS subject, d.source, l.quality = 1 AS usable, l.toxic = 0 AS key_ok, {D.hex8("md5('p:' || CAST(d.doc_id AS VARCHAR(20)))")} / 4294967295.0 AS p_key, length(d.text) AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def sents(D: Spark) -> str:
    """Each document as an item: the question is its first 12 words, the answer its first word."""
    return f"""s0 AS (SELECT doc_id, text, {D.sentences('text')} AS ss FROM documents WHERE {D.size(D.words('text'))} > 0),
s1 AS (SELECT doc_id, ss, {D.size('ss')} AS n, {D.positions(D.size('ss'))} AS pos FROM s0),
q AS (SELECT doc_id, {D.at(D.words('text'), '1')} AS answer, {D.without(D.slice(D.words('text'), '1', '12'), STOP, 2)} AS qw, {D.without(D.slice(D.words('text'), '1', '1'), STOP, 2)} AS aw FROM documents WHERE {D.size(D.words('text'))} > 0),
s2 AS (SELECT s1.doc_id, pos, n, {D.at('ss', 'pos')} AS s, answer, qw, aw FROM s1 JOIN q ON q.doc_id = s1.doc_id),
s3 AS (SELECT doc_id, pos, n, s, answer, qw, aw, {D.without(D.words('s'), STOP, 2)} AS w FROM s2),
s4 AS (SELECT doc_id, pos, n, s, answer, 1.5e0 * (CASE WHEN instr(lower(s), answer) > 0 THEN 1e0 ELSE 0.6e0 * {D.common('w', 'aw')} / CAST(greatest({D.size('aw')}, 1) AS DOUBLE) END) + {D.common('w', 'qw')} / CAST(greatest({D.size('qw')}, 1) AS DOUBLE) AS score FROM s3),
ranked AS (SELECT doc_id, pos, n, s, answer, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rk FROM s4)"""


def text_normalize_hash(D: Spark) -> str:
    norm = f"trim({D.sub(D.sub('lower(' + D.clean('text') + ')', '[^a-z0-9 ]+', ' '), '[ ]+', ' ')})"
    return f"""WITH t AS (SELECT doc_id, text, {norm} AS norm, {D.clean('text')} AS c FROM documents)
SELECT doc_id, length(c) AS clean_len, length(norm) AS norm_len, CASE WHEN norm <> '' THEN substring(sha1(norm), 1, 16) END AS passage_hash, substring(sha1(norm || '||' || norm), 1, 16) AS qa_hash, substring(sha1(text), 1, 16) AS text_sha FROM t"""


def eligibility_counts(D: Spark) -> str:
    return f"""WITH {items(D)} SELECT split, count(*) AS total, count_if(trim(support) <> '') AS grounded, count_if(trim(support) = '') AS blank FROM items GROUP BY split"""


def exclusion_waterfall(D: Spark) -> str:
    return f"""WITH {items(D)}, r AS (SELECT split, CASE WHEN trim(support) = '' THEN 'blank' WHEN {D.size(D.sentences('support'))} = 0 THEN 'no_sentence' WHEN coalesce(quality, 1) = 0 THEN 'unaligned' ELSE 'eligible' END AS reason FROM items LEFT JOIN labels ON labels.doc_id = items.id)
SELECT split, reason, count(*) AS n FROM r GROUP BY split, reason"""


def sentence_split(D: Spark) -> str:
    return f"""WITH t AS (SELECT doc_id, {D.sentences('text')} AS ss FROM documents) SELECT doc_id, {D.size('ss')} AS n, md5({D.join('ss', '~')}) AS all_md5 FROM t"""


def best_sentences(D: Spark) -> str:
    return f"""WITH {sents(D)} SELECT doc_id, CAST(pos AS BIGINT) AS pos, round(score, 6) AS score FROM ranked WHERE rk <= 2"""


def explanation_pick(D: Spark) -> str:
    return f"""WITH {sents(D)}, two AS (SELECT doc_id, pos, s, score, answer, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS o FROM ranked WHERE rk <= 2),
kept AS (SELECT doc_id, answer, max(CASE WHEN o = 1 THEN s END) AS a, max(CASE WHEN o = 2 AND score > 0.3 THEN s END) AS z FROM two GROUP BY doc_id, answer)
SELECT doc_id, md5(answer || ' is correct. ' || a || coalesce(' ' || z, '')) AS explanation_md5, z IS NOT NULL AS two FROM kept"""


def stimulus_excerpt(D: Spark) -> str:
    return f"""WITH {sents(D)}, c AS (SELECT ranked.doc_id, greatest(pos - 1, 1) AS a, ss FROM ranked JOIN s0 ON s0.doc_id = ranked.doc_id WHERE rk = 1)
SELECT s0.doc_id, md5(substring({D.join(D.slice('c.ss', 'a', '3'))}, 1, 1200)) AS excerpt_md5 FROM s0 LEFT JOIN c ON c.doc_id = s0.doc_id"""


def passage_trim(D: Spark) -> str:
    return f"""WITH {sents(D)}, best AS (SELECT doc_id, greatest(pos - 2, 1) AS a FROM ranked WHERE rk = 1),
run AS (SELECT s1.doc_id, pos, sum(length({D.at('ss', 'pos')}) + 1) OVER (PARTITION BY s1.doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS upto FROM s1 JOIN best ON best.doc_id = s1.doc_id WHERE pos >= a),
fits AS (SELECT doc_id, CAST(max(upto) AS BIGINT) AS chars FROM run WHERE upto <= 1200 GROUP BY doc_id)
SELECT s0.doc_id, CAST(CASE WHEN length(text) <= 1200 THEN length(text) ELSE coalesce(chars, 1200) END AS BIGINT) AS chars FROM s0 LEFT JOIN fits ON fits.doc_id = s0.doc_id"""


def fit_length(D: Spark) -> str:
    return f"""WITH {sents(D)}, run AS (SELECT doc_id, pos, length({D.at('ss', 'pos')}) AS len, coalesce(sum(length({D.at('ss', 'pos')}) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s1),
stop AS (SELECT doc_id, min(CASE WHEN pos > 1 AND before >= 150 AND before + len > 400 THEN pos END) AS cutpos FROM run GROUP BY doc_id),
f AS (SELECT run.doc_id, CAST(sum(len + 1) - 1 AS BIGINT) AS chars FROM run JOIN stop ON stop.doc_id = run.doc_id WHERE cutpos IS NULL OR pos < cutpos GROUP BY run.doc_id)
SELECT s0.doc_id, CAST(CASE WHEN chars BETWEEN 150 AND 1200 THEN chars ELSE length(text) END AS BIGINT) AS chars FROM s0 LEFT JOIN f ON f.doc_id = s0.doc_id"""


def exact_dup_groups(D: Spark) -> str:
    return """WITH g AS (SELECT md5(text) AS h, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY md5(text)) SELECT n AS size, count(*) AS n_groups, min(first_id) AS least_id FROM g GROUP BY n"""


def quota_report(D: Spark) -> str:
    return f"""WITH {items(D)}, m AS (SELECT subject, source, {D.hex8("md5('q:' || CAST(id AS VARCHAR(20)))")} % 3 AS d FROM items WHERE split = 'train')
SELECT coalesce(subject, '-') AS subject, CAST(coalesce(d, -1) AS BIGINT) AS difficulty, count(*) AS n, count_if(source = 'src0') AS first_source FROM m GROUP BY GROUPING SETS ((subject), (d), ())"""


def stratified_sample(D: Spark) -> str:
    return f"""WITH {items(D)}, k AS (SELECT subject, count(*) AS k FROM items GROUP BY subject), t AS (SELECT sum(k) AS total FROM k),
e AS (SELECT subject, k, CAST(100 AS DOUBLE) * k / total AS exact FROM k, t), a AS (SELECT subject, floor(exact) AS f, row_number() OVER (ORDER BY exact - floor(exact) DESC, subject) AS r, 100 - sum(floor(exact)) OVER () AS spare FROM e),
r AS (SELECT id, subject, row_number() OVER (PARTITION BY subject ORDER BY md5('sft:' || CAST(id AS VARCHAR(20))), id) AS rk FROM items)
SELECT r.id, r.subject FROM r JOIN a ON a.subject = r.subject WHERE rk <= f + CASE WHEN r <= spare THEN 1 ELSE 0 END"""


def subset_quotas(D: Spark) -> str:
    return f"""WITH {items(D)}, p AS (SELECT id, length(support) > 1000 AS can FROM items), r AS (SELECT id, can, row_number() OVER (ORDER BY CASE WHEN can THEN 0 ELSE 1 END, md5('stim:' || CAST(id AS VARCHAR(20))), id) AS rk, count(*) OVER () AS n FROM p)
SELECT id FROM r WHERE can AND rk <= {D.even('0.3 * n')}"""


def balanced_letters(D: Spark) -> str:
    return f"""WITH {items(D)} SELECT id, substring('ABCD', CAST((row_number() OVER (ORDER BY md5('letters:' || CAST(id AS VARCHAR(20))), id) - 1) % 4 + 1 AS INT), 1) AS letter FROM items"""


def holdout_hash(D: Spark) -> str:
    return f"""SELECT doc_id FROM documents WHERE {D.hex8("sha1(CAST(doc_id AS VARCHAR(20)))")} / 4294967295.0 < 0.05"""


def blinded_draw(D: Spark) -> str:
    n = "lpad(CAST(row_number() OVER (ORDER BY md5('audit/order:' || CAST(id AS VARCHAR(20))), arm, id) - 1 AS VARCHAR(5)), 3, '0')"
    return f"""WITH {arms(D)}, r AS (SELECT id, arm, row_number() OVER (PARTITION BY arm ORDER BY md5('audit:' || CAST(id AS VARCHAR(20))), id) AS rk FROM arms)
SELECT 'a' || {n} AS audit_id, arm, id FROM r WHERE rk <= 20"""


def per_key_sample(D: Spark) -> str:
    return f"""WITH {items(D)}, a AS (SELECT id, subject, 0 AS src, row_number() OVER (PARTITION BY subject ORDER BY id) AS rk FROM items WHERE split = 'train'), b AS (SELECT id, subject, 1 AS src, row_number() OVER (ORDER BY id) AS rk FROM items WHERE length(support) < 500),
u AS (SELECT id, subject, src FROM a WHERE rk <= 5 UNION ALL SELECT id, subject, src FROM b WHERE rk <= 20), f AS (SELECT id, subject, src, row_number() OVER (PARTITION BY id ORDER BY src) AS k FROM u) SELECT id, subject, src FROM f WHERE k = 1"""


def avoid_lists(D: Spark) -> str:
    return f"""WITH {items(D)}, r AS (SELECT id, subject, md5('avoid:' || CAST(id AS VARCHAR(20))) AS h FROM items),
x AS (SELECT id, lead(id, 1) OVER w AS a, lead(id, 2) OVER w AS b, first_value(id) OVER w AS f1, nth_value(id, 2) OVER (PARTITION BY subject ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f2 FROM r WINDOW w AS (PARTITION BY subject ORDER BY h, id)),
p AS (SELECT id, coalesce(a, f1) AS one, CASE WHEN a IS NULL THEN f2 WHEN b IS NULL THEN f1 ELSE b END AS two FROM x)
SELECT id, CASE WHEN one <> id THEN one END AS one, CASE WHEN two <> id AND two <> one THEN two END AS two FROM p"""


def best_sample_per_prompt(D: Spark) -> str:
    return """WITH r AS (SELECT user_id AS id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 0), length(event_type) DESC, event_id) AS rk FROM events) SELECT id, event_id, value FROM r WHERE rk = 1"""


def json_fields(D: Spark) -> str:
    return f"""WITH x AS (SELECT event_type, CAST({D.field('props', 'k')} AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS most FROM x GROUP BY event_type"""


def json_reason(D: Spark) -> str:
    bad = "try_parse_json(x) IS NULL" if D.name == "spark" else "NOT json_valid(x)"
    return f"""WITH t AS (SELECT event_id % 4 AS kind, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN substring(props, 1, length(props) - 1) WHEN 2 THEN event_type ELSE props END AS x FROM events),
r AS (SELECT CASE WHEN instr(x, '{{') = 0 THEN 'no_json' WHEN {bad} THEN 'bad_json' ELSE 'ok' END AS reason FROM t) SELECT reason, count(*) AS n FROM r GROUP BY reason"""


def option_rotation(D: Spark) -> str:
    return """WITH o AS (SELECT l_orderkey AS item, l_linenumber AS letter, l_discount * 10 - l_tax * 5 AS lp FROM lineitem WHERE l_linenumber <= 4),
k AS (SELECT k FROM (VALUES (0), (1), (2), (3)) v(k)), r AS (SELECT item, letter, avg(lp + 0.01 * ((letter + k) % 4)) AS lp FROM o CROSS JOIN k GROUP BY item, letter),
m AS (SELECT item, letter, lp, exp(lp - max(lp) OVER (PARTITION BY item)) AS e, row_number() OVER (PARTITION BY item ORDER BY round(lp, 9) DESC, letter) AS rk FROM r), p AS (SELECT item, letter, e / sum(e) OVER (PARTITION BY item) AS p, rk FROM m)
SELECT item, letter, round(p, 6) AS p_key FROM p WHERE rk = 1"""


def rates_by_arm(D: Spark) -> str:
    return f"""WITH {arms(D)}, p AS (SELECT a.arm, i.id FROM (SELECT DISTINCT arm FROM arms) a CROSS JOIN (SELECT id FROM arms) i),
j AS (SELECT p.arm, usable, key_ok FROM p LEFT JOIN arms ON arms.arm = p.arm AND arms.id = p.id)
SELECT arm, count(*) AS n, round(avg(CASE WHEN usable THEN 1e0 ELSE 0e0 END), 6) AS usable_rate, round(avg(CASE WHEN key_ok THEN 1e0 ELSE 0e0 END), 6) AS key_rate, round(avg(CASE WHEN usable THEN CASE WHEN key_ok THEN 1e0 ELSE 0e0 END END), 6) AS key_on_usable FROM j GROUP BY arm"""


def rejection_histogram(D: Spark) -> str:
    return f"""WITH {arms(D)}, f AS (SELECT arm, CASE WHEN n < 200 THEN 'schema' WHEN NOT usable THEN 'structure' WHEN NOT key_ok THEN 'key' WHEN p_key < 0.2 THEN 'aligned' ELSE 'passed' END AS reason FROM arms) SELECT arm, reason, count(*) AS n FROM f GROUP BY arm, reason"""


def rollup_by_subject(D: Spark) -> str:
    return f"""WITH {arms(D)} SELECT arm, coalesce(subject, 'pooled') AS subject, count(*) AS n, round(avg(CASE WHEN usable THEN 1e0 ELSE 0e0 END), 6) AS usable_rate FROM arms GROUP BY GROUPING SETS ((arm, subject), (arm))"""


def audit_cells(D: Spark) -> str:
    z = "1.959964"
    return f"""WITH {arms(D)}, c AS (SELECT coalesce(arm, 'all') AS arm, CASE WHEN usable IS NULL THEN 'all' WHEN usable THEN 'pass' ELSE 'fail' END AS verdict, CAST(count(*) AS DOUBLE) AS n, CAST(count_if(key_ok) AS DOUBLE) AS k FROM arms GROUP BY GROUPING SETS ((usable), (arm, usable), ()))
SELECT arm, verdict, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 6) AS rate,
round(greatest(0.0, (k / n + {z} * {z} / (2 * n) - {z} * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)), 6) AS lo,
round(least(1.0, (k / n + {z} * {z} / (2 * n) + {z} * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)), 6) AS hi FROM c"""


def kappa(D: Spark) -> str:
    return """WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality) AS DOUBLE) AS a, CAST(sum(1 - toxic) AS DOUBLE) AS b, CAST(count_if(quality = 1 - toxic) AS DOUBLE) AS agree FROM labels),
e AS (SELECT n, a, b, agree / n AS seen, (a * b + (n - a) * (n - b)) / (n * n) AS chance FROM c) SELECT CAST(n AS BIGINT) AS n, CASE WHEN n > 0 AND a > 0 AND a < n AND b > 0 AND b < n THEN round((seen - chance) / (1 - chance), 6) END AS kappa FROM e"""


def promotion_gate(D: Spark) -> str:
    return f"""WITH {arms(D)} SELECT arm, count(*) AS n, count_if(usable) AS usable, count_if(usable AND key_ok AND p_key > 0.5) AS promoted, round(count_if(usable AND key_ok AND p_key > 0.5) / CAST(nullif(count_if(usable), 0) AS DOUBLE), 6) AS survival FROM arms GROUP BY arm"""


def resume_anti_join(D: Spark) -> str:
    return """SELECT o_orderpriority AS priority, count(*) AS pending FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority"""


def stale_check(D: Spark) -> str:
    return """WITH checked AS (SELECT o_orderkey AS id, o_orderstatus AS sha FROM orders), judged AS (SELECT l_orderkey AS id, l_linenumber AS idx, l_linestatus AS sha FROM lineitem) SELECT j.sha AS judged_sha, c.sha AS now_sha, count(*) AS n FROM judged j JOIN checked c ON c.id = j.id WHERE j.sha <> c.sha GROUP BY j.sha, c.sha"""


def irt_curves(D: Spark) -> str:
    return f"""WITH g AS (SELECT CAST(i AS DOUBLE) / 10 - 4 AS theta FROM {D.series(81)}), p AS (SELECT theta, 0.25 + 0.75 / (1 + exp(-theta)) AS p, 0.75 / (1 + exp(-theta)) * (1 - 1 / (1 + exp(-theta))) AS d FROM g)
SELECT round(theta, 6) AS theta, round(p, 6) AS p, round(d, 6) AS slope, round(d * d / (p * (1 - p)), 6) AS information, round(0.3 * exp(-(p - 0.7) * (p - 0.7) / 0.045), 6) AS learning FROM p"""


def fisher_argmax(D: Spark) -> str:
    return """WITH t AS (SELECT c_custkey AS id, c_acctbal / 2500 - 2 AS theta, c_nationkey AS n FROM customer), i AS (SELECT p_partkey AS item, p_size AS lo, p_retailprice / 500 - 3 AS b FROM part WHERE p_size <= 25),
x AS (SELECT id, item, theta, b, 0.25 + 0.75 / (1 + exp(-(theta - b))) AS p, 1 / (1 + exp(-(theta - b))) AS s FROM t JOIN i ON i.lo = t.n), f AS (SELECT id, item, abs(p - 0.7) AS gap, pow(0.75 * s * (1 - s), 2) / (p * (1 - p)) AS info FROM x),
r AS (SELECT id, item, info, row_number() OVER (PARTITION BY id ORDER BY round(info, 9) DESC, item) AS rk FROM f) SELECT id, item, round(info, 6) AS info FROM r WHERE rk = 1"""


def practice_argmin(D: Spark) -> str:
    return fisher_argmax(D).replace("ORDER BY round(info, 9) DESC, item", "ORDER BY round(gap, 9), item").replace("SELECT id, item, info, row_number", "SELECT id, item, gap, row_number").replace("round(info, 6) AS info FROM r", "round(gap, 6) AS gap FROM r")


def run_ledger(D: Spark) -> str:
    return f"""SELECT {D.date_part('ts')} AS day, count_if(event_type = 'click') AS started, count_if(event_type = 'purchase') AS finished, count_if(event_type = 'click') - count_if(event_type = 'purchase') AS unfinished FROM events GROUP BY {D.date_part('ts')}"""


def session_summary(D: Spark) -> str:
    return f"""WITH {responses(D)} SELECT session, count(*) AS answered, count_if(correct) AS right_answers, CASE WHEN count(*) >= 60 THEN 'cap' ELSE 'open' END AS state, max_by(lo, seq) AS last_lo, round(avg(b), 6) AS mean_b FROM responses GROUP BY session"""


def wrong_answers(D: Spark) -> str:
    return f"""WITH {responses(D)}, w AS (SELECT session, lo, item, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS rk FROM responses WHERE NOT correct) SELECT session, CAST(rk AS BIGINT) AS rk, lo, item FROM w WHERE rk <= 3"""


def misconception_last(D: Spark) -> str:
    return f"""WITH {responses(D)} SELECT session, lo, max_by(item, seq) AS last_wrong FROM responses WHERE NOT correct GROUP BY session, lo"""


def lo_policy(D: Spark) -> str:
    return f"""WITH {responses(D)}, s AS (SELECT session, lo, count(*) AS n, avg(CASE WHEN correct THEN 1e0 ELSE 0e0 END) AS m FROM responses GROUP BY session, lo), t AS (SELECT session, sum(n) AS t FROM s GROUP BY session),
c AS (SELECT s.session, lo, n, 0.2e0 * (1 - m) + 0.3e0 * sqrt(ln(CAST(t + 1 AS DOUBLE)) / (n + 1)) AS need, 0.2 * (t + 1) - n - 0.01 * n AS deficit, greatest(1, ceil(0.2 * 100)) AS cap FROM s JOIN t ON t.session = s.session),
r AS (SELECT session, lo, need, deficit, row_number() OVER (PARTITION BY session ORDER BY round(need, 9) DESC, lo) AS rk FROM c WHERE n < cap) SELECT session, lo, round(need, 5) AS need, round(deficit, 6) AS deficit FROM r WHERE rk = 1"""


def claim_once(D: Spark) -> str:
    return f"""WITH {responses(D)}, c AS (SELECT session, item, seq, row_number() OVER (PARTITION BY session, item ORDER BY seq) AS rk FROM responses) SELECT session, count(*) AS kept, CAST(sum(seq) AS BIGINT) AS seqs FROM c WHERE rk = 1 GROUP BY session"""


def bank_subjects(D: Spark) -> str:
    return """SELECT c_mktsegment AS subject, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment"""


def bank_objectives(D: Spark) -> str:
    return """SELECT DISTINCT c_nationkey AS lo, c_mktsegment AS subject FROM customer WHERE c_acctbal > 0"""


def bank_items(D: Spark) -> str:
    return """SELECT o_orderkey AS item, c_mktsegment AS subject, round(CASE WHEN count(*) < 5 THEN 0.0 ELSE avg(l_discount) END, 6) AS b, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey, c_mktsegment"""


def chat_rows(D: Spark) -> str:
    return """SELECT conv_id, count(*) AS turns, count_if(role = 'user') AS asked, count_if(role = 'assistant') AS answered, max_by(role, turn) AS last_role, md5(min_by(text, turn)) AS first_md5 FROM conversations GROUP BY conv_id"""


def conversation_roundtrip(D: Spark) -> str:
    return """WITH m AS (SELECT conv_id, turn, 'role=' || role || '|text=' || text AS line FROM conversations), p AS (SELECT conv_id, turn, substring(line, 6, instr(line, '|text=') - 6) AS role, substring(line, instr(line, '|text=') + 6, 2000000000) AS text FROM m)
SELECT p.conv_id, p.turn, p.role, p.text = c.text AS same, length(p.text) AS n FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn AND c.role = p.role"""


def letter_parse(D: Spark) -> str:
    return f"""WITH t AS (SELECT doc_id, upper(trim(text)) AS u FROM documents), x AS (SELECT doc_id, {D.extract('substring(u, 1, 20)', r'(^|[^A-Z0-9_\x{00AA}-\x{024F}])([ABCD])([^A-Z0-9_\x{00AA}-\x{024F}]|$)', 2)} AS letter FROM t) SELECT nullif(letter, '') AS letter, count(*) AS n FROM x GROUP BY letter"""


def bloom(D: Spark) -> str:
    if D.name == "duckdb":  # its word border knows ASCII only
        edge = "[^0-9A-Za-z_\\x{00AA}-\\x{024F}]"
        hit = lambda p: f"regexp_matches(text, '(?i)(^|{edge})({p})({edge}|$)')"
    else:
        hit = lambda p: f"text rlike '(?iU)\\\\b({p})\\\\b'"
    return f"""SELECT doc_id, (CASE WHEN {hit(HIGHER)} THEN 1e0 ELSE 0e0 END) - (CASE WHEN {hit(RECALL)} THEN 1e0 ELSE 0e0 END) AS bloom FROM documents"""


def answer_norm(D: Spark) -> str:
    w = D.words("p_name")
    return f"""WITH t AS (SELECT p_partkey, {w} AS w FROM part) SELECT p_partkey, {D.join('w')} AS answer, {D.size('w')} AS n FROM t"""


def index_quartiles(D: Spark) -> str:
    return """WITH r AS (SELECT p_size AS x, p_brand AS g, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT g, max(CASE WHEN i = floor(n / 4) + 1 THEN x END) AS q1, max(CASE WHEN i = floor(n / 2) + 1 THEN x END) AS q2, max(CASE WHEN i = floor(3 * n / 4) + 1 THEN x END) AS q3 FROM r GROUP BY g"""


def thinking_stats(D: Spark) -> str:
    return f"""SELECT o_orderpriority AS judge, round({D.percentile('o_totalprice', '0.5')}, 4) AS p50, round({D.percentile('o_totalprice', '0.9')}, 4) AS p90, max(o_totalprice) AS most, CAST(greatest(1024, ceil({D.percentile('o_totalprice', '0.9')} / 256) * 256) AS BIGINT) AS cap FROM orders GROUP BY o_orderpriority"""


def judge_agreement(D: Spark) -> str:
    return f"""WITH {arms(D)}, v AS (SELECT id, source AS judge, key_ok FROM arms), p AS (SELECT a.judge AS a, b.judge AS b, count(*) AS n FROM (SELECT DISTINCT judge FROM v) a JOIN (SELECT judge, id FROM v WHERE key_ok) b ON a.judge < b.judge GROUP BY a.judge, b.judge) SELECT a, b, n FROM p"""


def sim_response_model(D: Spark) -> str:
    u = D.hex8("md5('u:' || CAST(c_custkey AS VARCHAR(20)))")
    return f"""WITH s AS (SELECT c_custkey AS student, c_acctbal / 4000 - 1 + CASE WHEN c_nationkey % 2 = 0 THEN 1.5e0 ELSE 0e0 END AS ability, {u} / 4294967295.0 AS u FROM customer), a AS (SELECT student, ability, u < 0.25 + 0.75 / (1 + exp(-ability)) AS correct FROM s) SELECT student, round(ability, 9) AS ability, correct FROM a"""


def tag_stems(D: Spark) -> str:
    stem = "CASE WHEN doc_id % 2 = 0 THEN 'Based on the excerpt, ' ELSE '' END || lower(text)"
    return f"""WITH t AS (SELECT doc_id, source, {stem} AS stem FROM documents) SELECT doc_id, md5(CASE WHEN stem LIKE 'Based on the excerpt, %' THEN upper(substring(stem, 23, 1)) || substring(stem, 24, 2000000000) ELSE stem END || ' Answer: ' || source) AS tag_md5 FROM t"""


QUERIES: dict[str, Callable[[Spark], str]] = {
    k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k not in ("items", "responses", "arms", "sents")
}
