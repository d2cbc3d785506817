"""Single operators on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from quizforge.functions import response as R
from quizforge.functions import text as T
from quizforge.operators import evaluation, grouping, jsonval, quota, stats, textbook, tracing


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_text(spark):
    r = one(spark, T.clean(F.lit("  a  b\n")), T.passage_hash(F.lit(" !! ")), T.norm_answer(F.lit("The Cell"), True), T.parse_letter(F.lit("  (b) x")), T.indel_ratio(F.lit("mitochondrion"), F.lit("mitochondrions")))
    assert r[0] == "a b" and r[1] is None and r[2] == "cell" and r[3] == "B" and round(r[4], 3) == 96.296
    assert one(spark, T.sentences(F.lit("This is the first one. Second is here now! no")))[0] == ["This is the first one.", "Second is here now! no"]
    assert one(spark, T.shingles(F.lit("a b c d"), 3))[0] == ["a b c", "b c d"]
    assert one(spark, T.strip_reasoning(F.lit("x</think>y</think> z")))[0] == "z"


def test_groups_and_splits(spark):
    items = spark.createDataFrame([(1, "train", "x"), (2, "test", "x"), (3, "valid", "y"), (4, "train", "y"), (5, "train", None), (6, "train", None)], "id long, split string, key string")
    links = grouping.star_links(items, "key").union(spark.createDataFrame([(4, 2)], "a long, b long"))
    out = grouping.assign_splits(grouping.groups(items, links))
    assert {r["id"]: (r["group"], r["final_split"]) for r in out.collect()} == {1: (1, "test"), 2: (1, "test"), 3: (1, "test"), 4: (1, "test"), 5: (5, "train"), 6: (6, "train")}
    assert grouping.leaks(out).isEmpty()
    assert grouping.link_counts(items, [("key", grouping.star_links(items, "key")), ("more", spark.createDataFrame([(4, 2), (1, 2)], "a long, b long"))]) == [("key", 2), ("more", 1)]


def test_quotas(spark):
    pool = spark.createDataFrame([(i, "a" if i < 70 else "b") for i in range(100)], "id long, s string")
    assert {r["s"]: r["count"] for r in quota.stratified(pool, "s", 10, "x").groupBy("s").count().collect()} == {"a": 7, "b": 3}
    letters = sorted(r["count"] for r in quota.balanced_letters(pool.limit(10), "x").groupBy("letter").count().collect())
    assert letters == [2, 2, 3, 3]
    fixed = spark.createDataFrame([(900 + i, "A") for i in range(4)], "id long, letter string")
    free = quota.balanced_letters_fixed(pool.select("id").limit(6), fixed)
    assert {r["letter"]: r["count"] for r in free.groupBy("letter").count().collect()} == {"B": 2, "C": 2, "D": 2}


def test_stats(spark):
    p = stats.fisher(spark.createDataFrame([(28, 7, 2, 2)], "a int, b int, c int, d int")).first()["p"]
    assert round(p, 3) == 0.223
    w = one(spark, stats.wilson(F.lit(28), F.lit(35)), stats.wilson(F.lit(0), F.lit(0)), stats.kappa(F.lit(3), F.lit(4), F.lit(4), F.lit(4)))
    assert round(w[0]["lo"], 3) == 0.641 and w[1] is None and w[2] is None


def test_response_model(spark):
    assert math.isclose(R.optimal_p(), 0.6830127, rel_tol=1e-6)
    r = one(spark, R.should_stop(F.lit(2), F.lit(0.1), F.lit(9), F.lit(0.3)), R.should_stop(F.lit(3), F.lit(0.1), F.lit(9), F.lit(0.3)), R.effective_b(F.lit(0.3), F.lit(4), F.lit(1.0)))
    assert list(r) == [False, True, 1.0]
    rows = spark.createDataFrame([(1, 1, 0.0, True), (1, 2, 1.0, False), (1, 3, -1.0, True)], "session long, seq long, b double, correct boolean")
    path = {x["seq"]: x for x in tracing.trajectory(rows).collect()}
    assert path[1]["theta"] > 0 > path[2]["theta"] - path[1]["theta"] and path[3]["sd"] < 1


def test_waterfall(spark):
    r = one(spark, evaluation.first_failure({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False)}), evaluation.first_failure({"a": F.lit(True)}))
    assert list(r) == ["unchecked:b", None]
    i = spark.createDataFrame([(1, True, False)], "id long, all_checks boolean, source_copy boolean")
    with pytest.raises(ValueError):
        evaluation.promote(i, spark.createDataFrame([], "id long, verified boolean"), ["id"])


def test_json_and_letters(spark):
    assert jsonval.balanced('x {"a": "}", "b": {}} y') == '{"a": "}", "b": {}}' and jsonval.balanced("{") is None and jsonval.balanced('{ "a {"b": 1}') == '{"b": 1}'
    assert jsonval.rewritten("B is correct. A cell, unlike (D) or vitamin B.", "B", "D") == "D is correct. A cell, unlike (B) or vitamin B."
    assert jsonval.rewritten("Unlike B, it grows.", "B", "C") is None
    for text, want in {"Options A, B and C fail.": "Options D, B and C fail.", "The correct answer is A.": "The correct answer is D.", "A: yes": "D: yes", "It ends. A) so": "It ends. D) so", "Type A is fine, D is incorrect.": "Type A is fine, A is incorrect.", "A cell": "A cell", "Answer: A": None}.items():
        assert jsonval.rewritten(text, "A", "D") == want, text
    assert jsonval.balanced('{"a": "unclosed } {"b": 1}') == '{"b": 1}' and jsonval.balanced('say {"x": "\\"}"} {}') == '{"x": "\\"}"}'
    block = F.lit('{"stem": "What is it that is asked?", "choices": {"A": "a", "B": "b", "C": "c", "D": "d"}, "answer": "E", "explanation": "x", "lo_id": "l", "difficulty": "easy", "more": 1}')
    assert one(spark, jsonval.schema_errors(block))[0] == ["extra", "answer"]
    assert one(spark, jsonval.parse_reason(F.lit("[1]")), jsonval.parse_reason(F.lit('{"a": 1}')))[0] == "bad_json"


def test_textbook(spark):
    xml = '<document><title>Cells</title><content><section id="s1"><para>Cells are <emphasis>small</emphasis> <math><msup><mi>x</mi><mn>2</mn></msup></math> units ( <link target-id="f1"/> ).</para><para>As <link target-id="f"/> shows.</para><para>Before.</para><equation/></section></content></document>'
    r = spark.createDataFrame([(xml,)], "x string").select(textbook.parse_module("x").alias("m")).first()["m"]
    assert r["title"] == "Cells" and [p["text"] for p in r["paragraphs"]] == ["Cells are small x^2 units.", None, None, None]
    long = "A sentence that is long enough to count here. " * 4
    assert textbook.chunks([("a", "Short one."), ("a", long.strip()), ("a", None), ("a", "This relation " + long)]) == ["Short one. " + long.strip()]
    ask = '<exercise id="e1"><problem><para>Which?</para><list number-style="lower-alpha"><item>a1</item><item>b1</item><item>c1</item><item>d1</item></list></problem><solution><para>(c)</para></solution></exercise>'
    more = [
        ask, ask.replace("(c)", "(e)"), ask.replace("d1", "A1"), ask.replace("<para>Which?</para>", '<para>Which [ ] of <math><msubsup><mi>x</mi><mn>1</mn><mn>2</mn></msubsup><mover><mi>v</mi><mo>-</mo></mover><annotation>no</annotation></math> ?</para>'),
        ask.replace("<para>Which?</para>", '<para>See</para><list number-style="upper-roman"><item>one</item><item>two</item></list>'), ask.replace("<para>Which?</para>", "<list><item>z</item></list>"),
        ask.replace("<para>Which?</para>", '<para>As <link target-id="f"/></para>'), ask.replace('<list number-style="lower-alpha"><item>a1</item><item>b1</item><item>c1</item><item>d1</item></list>', "".join(f"<para>({x}) is {x}</para>" for x in "abcd")),
    ]
    doc = "<document><title>T</title><content>" + "".join(more) + '<section class="chapter-review"><para>Not read here.</para></section><para>where v is small.</para><note><para>No.</para></note><para></para></content></document>'
    m = spark.createDataFrame([(doc,), ("<broken",), (None,)], "x string").select(textbook.parse_module("x").alias("m")).collect()
    assert [(q["stem"], q["key"]) for q in m[0]["m"]["questions"]] == [("Which?", "C"), ("Which of x_1^2v ?", "C"), ("See I. one II. two", "C"), ("Which?", "C")]
    assert m[0]["m"]["questions"][3]["options"] == ["is a", "is b", "is c", "is d"]
    assert [p["text"] for p in m[0]["m"]["paragraphs"]] == [None] * 10
    assert m[1]["m"]["paragraphs"] == [] and m[2]["m"]["questions"] == []
    book = "<collection><title>B</title><content><subcollection><title>Unit</title><content><subcollection><title>One</title><content><module document='m1'/><module document='m2'/></content></subcollection><subcollection><title>Two</title><content><module document='m3'/></content></subcollection></content></subcollection></content></collection>"
    order = spark.createDataFrame([(book,)], "x string").select(F.inline(textbook.collection_modules("x")))
    assert [tuple(r) for r in order.collect()] == [("m1", "One", 1, "1.0"), ("m2", "One", 1, "1.1"), ("m3", "Two", 2, "2.0")]
    body = "<document><title>{}</title><content><para>Cells are small units of life.</para></content></document>"
    modules = spark.createDataFrame([("m1", body.format("Intro")), ("m2", body.format("Cells")), ("m3", body.format("Introduction"))], "module string, xml string")
    assert {r["module"]: len(r["paragraphs"]) for r in textbook.load_book(modules, order).collect()} == {"m1": 0, "m2": 1, "m3": 0}
    text = " ".join(f"This is sentence number {i} of the passage." for i in range(40))
    fitted = one(spark, textbook.fit_length(F.lit(text), 300), textbook.fit_length(F.lit("Too short to fit."), 300))
    assert 150 <= len(fitted[0]) <= 300 and text.startswith(fitted[0]) and fitted[1] == "Too short to fit."


def test_readers_and_sinks(spark, tmp_path):
    from quizforge.sources import readers, sinks

    (tmp_path / "valid.json").write_text('[{"question": " What  is it? ", "correct_answer": "x", "distractor1": "a", "distractor2": "b", "distractor3": "c", "support": " "}]')
    r = readers.split_file(spark, str(tmp_path / "valid.json"), "valid").first()
    assert r["id"] == "valid-00000" and r["question"] == "What is it?" and not r["grounded"]
    (tmp_path / "torn.jsonl").write_text('{"a": 1}\n{"a": ')
    assert [x["a"] for x in readers.jsonl(spark, str(tmp_path / "torn.jsonl"), "a int", torn=True).collect()] == [1]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    assert sinks.append_new(rows, str(tmp_path / "t"), ["id"], "id long, v string") == 2
    assert sinks.append_new(rows, str(tmp_path / "t"), ["id"], "id long, v string") == 0
    log = spark.createDataFrame([("Iter 10: Val loss 1.5, Val took 2s",), ("Iter 10: Train loss 2.5, Tokens/sec 50.5, Peak mem 7.1 GB",), ("noise",)], "value string")
    assert readers.training_log(log).first()["train_loss"] == 2.5
