import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import control, groups, islands, selection, serial
from quire.streaming.packing import fold


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_scalars(spark):
    assert one(spark, X.normalize_text(F.col("a")), a=" x\n\t y z ") == " x y z "
    assert one(spark, X.normalize_text(F.col("a")), a=" \n") is None
    path, fragment = X.split_href(F.col("a"))
    assert one(spark, path, a="x#y#z") == "x" and one(spark, fragment, a="x#y#z") == "y#z" and one(spark, path, a="#f") is None
    assert one(spark, X.unwrap_quotes(F.col("a")), a="«a ‹b› 《c〈d〉》»") == "a «b» c《d》"
    assert one(spark, X.unclose_void(F.col("a")), a='<br/><img src="x" /><colgroup/>') == '<br><img src="x"><colgroup/>'
    assert one(spark, X.parse_id(F.col("a")), a=" 1_0 ") == 10 and one(spark, X.parse_id(F.col("a")), a="x") is None
    assert one(spark, X.is_inline(F.col("a")), a="SPAN") and not one(spark, X.is_inline(F.col("a")), a="p")
    assert one(spark, X.is_inline(F.col("a"), F.col("b")), a="math", b="block") is False
    assert one(spark, X.n_tokens(F.col("a")), a="<b>ab 你好</b>") == 6
    assert one(spark, X.token_hint(F.col("a")), a="a b c d e") == "a b c ..."
    assert one(spark, X.fences(F.col("a"), "xml"), a="```XML\n<a/>\n``` x ```xml <b/>```") == ["<a/>", "<b/>"]
    assert one(spark, X.fingerprint(F.lit("p"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))), a=1) == '<p a="1" b="2"/>'
    assert one(spark, X.sampling_value(0.2, 0.8, F.col("a")), a=1) == pytest.approx(0.5)
    found, error = X.single_answer(F.col("a"))
    assert one(spark, found, a="t <xml>1</xml>") == "<xml>1</xml>" and "2" in one(spark, error, a="<xml></xml><xml></xml>")


def test_message_payload_is_what_json_writes(spark):
    import json

    text = 'say "hi"\n\\ tab\t é'
    got = one(spark, X.message_payload(F.lit("v:French"), F.array(F.struct(F.col("a").alias("message"), F.lit(1).alias("role")))), a=text)
    assert got == json.dumps({"cache_seed": "v:French", "messages": [{"message": text, "role": 1}]}, ensure_ascii=False, sort_keys=True)


def test_groups_keep_order_and_budget(spark):
    items = spark.createDataFrame([("k", i, s) for i, s in enumerate([5, 4, 3, 20, 1, 9])], "key string, no int, score long")
    got = groups.budget_groups(items, ["key"], ["no"], "score", 10).orderBy("group_no").collect()
    assert [(r.n_items, r.score) for r in got] == [(2, 9), (1, 3), (1, 20), (2, 10)]
    assert fold((0, 0, 0), [5, 4, 3, 20, 1, 9, None], 10)[1] == [(0, 2, 9), (1, 1, 3), (2, 1, 20), (3, 2, 10)]


def test_context(spark):
    items = spark.createDataFrame([("k", i, s) for i, s in enumerate([4, 4, 4])], "key string, no int, score long")
    kept = lambda n, side: [(r.no, r.kept) for r in groups.context(items, ["key"], ["no"], "score", n, side).orderBy("no").collect()]
    assert kept(6, "tail") == [(0, 4), (1, 2)] and kept(6, "head") == [(1, 2), (2, 4)] and kept(8, "tail") == [(0, 4), (1, 4)]
    assert kept(0, "tail") == [(0, 4)]


def test_coalescing_keeps_first_head_and_last_tail(spark):
    g = spark.createDataFrame([("b", 0, 1, 10, 2), ("b", 1, 3, 10, 4), ("b", 2, 5, 50, 6)], "book string, no int, head int, body int, tail int")
    got = groups.coalesce_groups(g, ["book"], "no", 30).orderBy("merged_no").collect()
    assert [(r.n_groups, r["head"], r.body, r.tail) for r in got] == [(2, 1, 20, 4), (1, 5, 50, 6)]
    near = groups.with_neighbours(g, ["book"], "no", "body").orderBy("no").collect()
    assert [(r.head_context, r.tail_context) for r in near] == [(None, 10), (10, 50), (10, None)]
    again = groups.regroup(spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("d", 3, None)], "doc string, seq int, v string"), "doc", "seq", "v")
    assert again.first().v == ["a", "b"]


def test_islands(spark):
    rows = spark.createDataFrame([(0, "a", [1, 2]), (1, "a", [1, 2, 3]), (2, "b", [1, 4]), (3, "a", [5])], "no int, v string, stack array<int>").withColumn("k", F.lit(1))
    assert [r.run_id for r in islands.runs(rows, ["k"], ["no"], "v").orderBy("no").collect()] == [1, 1, 2, 3]
    assert [(r.left_common, r.right_common) for r in islands.common_depths(rows, ["k"], ["no"], "stack").orderBy("no").collect()] == [(0, 2), (2, 1), (1, 0), (0, 0)]
    marks = rows.withColumn("m", F.when(F.col("no") == 1, "x").otherwise("y"))
    assert [r.child_id for r in islands.sparse_ids(marks, ["k"], "v", ["no"], "m").orderBy("no").collect()] == [1, 2, None, 3]
    assert [r.unique_id for r in islands.rename_duplicates(rows, ["k"], "v", ["no"]).orderBy("no").collect()] == ["a", "a__translated", "b", "a__translated_2"]
    assert one(spark, islands.block_depth(F.array(F.lit("body"), F.lit("p"), F.lit("b")), ["b"]), a=1) == 2


def test_validation_and_selection(spark):
    e = spark.createDataFrame([("t", 1, "p"), ("t", 2, "p"), ("t", 3, "h1")], "g string, id long, tag string")
    f = spark.createDataFrame([("t", 1, "p", 0), ("t", 3, "p", 1), ("t", 9, "p", 2), ("t", None, "p", 3)], "g string, id long, tag string, position int")
    got = {r.kind: (r.block_id, r.weight) for r in selection.validate_blocks(e, f, ["g"]).collect()}
    assert got == {"block_expected_ids": (None, 729), "block_wrong_tag": (3, 243), "block_unexpected_id": (9, 27), "block_invalid_id": (None, 81)}
    a = spark.createDataFrame([("b", 0, 9), ("b", 1, 3), ("b", 2, 3), ("c", 0, None)], "block string, attempt int, weight long")
    assert sorted((r.block, r.attempt) for r in selection.best_attempts(a, ["block"]).collect()) == [("b", 1), ("c", 0)]
    shown = selection.demoted(a.withColumn("level", F.lit(6)), ["block"]).where("block = 'b'").orderBy("attempt").collect()
    assert [r.shown_level for r in shown] == [6, -1, 6]
    counts = selection.validate_tag_counts(e.withColumnRenamed("g", "p"), f.where("id <> 9").withColumnRenamed("g", "p"), ["p"])
    assert counts.collect() == [] and selection.validate_tag_counts(e, f.where("id = 1"), ["g"], strict=True).count() == 2
    m = selection.match_children(spark.createDataFrame([("g", "b", 5, 0), ("g", "b", None, 1)], "g string, tag string, id long, child_no int"), spark.createDataFrame([("g", "b", None, 0), ("g", "b", 5, 1), ("g", "b", 5, 2)], "g string, tag string, id long, position int"), ["g"])
    assert sorted((r.child_no, r.position) for r in m.collect()) == [(0, 1), (1, 0)]


def test_control(spark):
    req = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", "old")], "key string, answer string")
    full, new = control.cached(req, cache, "key", lambda miss: miss.withColumn("answer", F.upper("key")))
    assert sorted((r.key, r.answer) for r in full.collect()) == [("a", "old"), ("b", "B"), ("b", "B")] and new.count() == 1
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return "ok"

    assert control.with_retries(flaky, 5, sleep=lambda s: None) == "ok"
    with pytest.raises(KeyError):
        control.with_retries(lambda: {}["x"], 5, sleep=lambda s: None)
    assert control.rendered("to {{ lang }}", lang="French") == "to French"
    g = spark.createDataFrame([(0, "s")], "group_no long, source string")
    assert [r.answer for r in control.model_stage(g.select("group_no", F.col("source").alias("text")), str.upper).collect()] == ["S"]
    t = spark.createDataFrame([(1, i, k) for i, k in enumerate(["toc", "metadata", "chapter", "chapter"])], "b int, no int, kind string")
    assert [round(r.progress, 2) for r in control.progress(t, ["b"], "no").orderBy("no").collect()] == [0.05, 0.1, 0.55, 1.0]


def test_progress_has_no_error_of_sums(spark):
    """Shares that end on a half per mille are rounded as the share of each chapter alone would be."""
    import duckdb

    rows = [(n, k, "metadata" if k == 0 else "chapter") for n in range(1, 101) for k in range(n + 1)]
    got = control.progress(spark.createDataFrame(rows, "b int, no int, kind string"), ["b"], "no")
    got = got.select("b", "no", F.round(F.col("progress") * 1000).cast("int").alias("permille")).collect()
    want = duckdb.execute("SELECT n, k, cast(round(1000 * (0.05 + 0.95 * k / n)) AS int) FROM (SELECT n, unnest(range(0, n + 1)) AS k FROM range(1, 101) t(n))").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert control.downgraded("append_block", "toc") == "append_text"


def test_serial_covers_each_item_once():
    scores = [3, 30, 4, 5, 60, 1, 2, 200, 3]
    got = list(serial.mapped(list(range(9)), scores, 100, lambda xs: [x * 10 for x in xs]))
    assert got == [x * 10 for x in range(9)]
    for head, first, end, tail in serial.split(scores, 100):
        assert head <= first < end <= tail


def test_memberships_cover_bodies_once_and_bring_context(spark):
    scores = [3, 30, 4, 5, 60, 1, 2, 200, 3]
    rows = spark.createDataFrame([("b", i, x) for i, x in enumerate(scores)], "book string, seq int, score int")
    got = serial.memberships(rows, ["book"], "seq", "score", 100).collect()
    want = [("b", i, g, first <= i < end) for g, (head, first, end, tail) in enumerate(serial.split(scores, 100)) for i in range(head, tail)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sorted(r.seq for r in got if r.body) == list(range(len(scores)))


def test_scorecard_and_audit(spark):
    cases = spark.createDataFrame([(0, True), (0, True), (2, True), (5, False)], "retries int, success boolean")
    assert sorted(map(tuple, selection.scorecard(cases).collect())) == [(0, 2, 0.5), (2, 1, 0.25)]
    assert selection.scorecard(cases.where("false")).count() == 0
    block = '```xml\n<xml id="1"><p id="1">a<b id="2"/></p><i id="2"/></xml>\n```'
    logs = spark.createDataFrame([("one", f"x\n{block}\ny\n{block}"), ("two", '```xml\n<xml><p id="1"/></xml>\n```'), ("three", None)], "log string, text string")
    assert [tuple(r) for r in islands.duplicate_ids(logs, "log", "text").collect()] == [("one", "2", 2)]


def test_incisions_of_neighbours(spark):
    """A border that leaves inline elements only costs one for each, one that leaves blocks three for each of those too."""
    rows = spark.createDataFrame([(3, 2, 3), (3, 2, 2), (3, 2, 1), (5, 3, 0), (2, 2, 2)], "depth int, block int, common int")
    got = [r.c for r in rows.select(islands.incision_of(F.col("depth"), F.col("block"), F.col("common")).alias("c")).collect()]
    assert got == [0, 1, 4, 11, 0]


def test_series_by_groups(spark):
    rows = spark.createDataFrame([(d, i, 3 + i % 4, str(i)) for d in range(3) for i in range(30)], "doc int, at int, score int, value string")
    got = serial.transformed(rows, ["doc"], "at", "score", "value", 40, lambda xs: [f"{xs[0]}-{x}" for x in xs], bound=2).collect()
    assert sorted((r.doc, r["at"], r.value.split("-")[1]) for r in got) == [(d, i, str(i)) for d in range(3) for i in range(30)]
    firsts = {(r.doc, r.value.split("-")[0]) for r in got}
    assert 6 < len(firsts) < 45
    numbers = serial.transformed(rows, ["doc"], "at", "score", "score", 40, lambda xs: [x * 2 for x in xs], "int").collect()
    assert sorted(r.score for r in numbers) == sorted(2 * r.score for r in rows.collect())
    with pytest.raises(Exception, match="an item for each"):
        serial.transformed(rows, ["doc"], "at", "score", "value", 40, lambda xs: xs[1:]).collect()
    assert serial.transformed(rows.limit(0), ["doc"], "at", "score", "value", 40, lambda xs: xs).count() == 0


def test_nested_and_all_same(spark):
    rows = spark.createDataFrame([("k", 0, "b", 1), ("k", 1, "a", 2), ("k", 2, "b", 3), ("l", 5, None, None), ("l", 6, None, None), ("m", 7, "x", 1), ("m", 8, "x", None)], "key string, at int, by string, value int")
    got = sorted(((r.key, r.no, r.by, list(r["values"])) for r in groups.nested(rows, ["key"], "at", "by", "value").collect()), key=str)
    assert got == [("k", 0, "b", [1, 3]), ("k", 1, "a", [2]), ("l", 0, None, [None, None]), ("m", 0, "x", [1, None])]
    assert {r.key: r.same for r in groups.all_same(rows, ["key"], "value").collect()} == {"k": False, "l": True, "m": False}


def test_series_are_read_once(spark):
    """what items are made of was read twice, and joined to itself."""
    from quire.operators import serial

    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.range(60).select((F.col("id") % 3).alias("doc"), F.col("id").alias("at"), F.lit(10).alias("score"), F.col("id").cast("string").alias("value"))
    got = serial.transformed(rows.mapInPandas(counted, rows.schema), ["doc"], "at", "score", "value", 40, lambda xs: [f"{x}/{len(xs)}" for x in xs], bound=3).collect()
    assert seen.value == 60
    assert sorted((r.doc, r["at"], r.value.split("/")[0]) for r in got) == sorted((i % 3, i, str(i)) for i in range(60))


def test_tokens_are_counted_as_they_are_listed(spark):
    texts = ["", "a", "ab c", "<b>ab 你好</b>", "a < b > c", "<<x>>", "x<y", "<\n>\r\n", "é𝄞ab12", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    listed = F.size(F.regexp_extract_all("t", F.lit(X.TOKEN), 0)).cast("long")
    assert [(r.a, r.b) for r in df.select(X.n_tokens(F.col("t")).alias("a"), F.when(F.col("t").isNotNull(), listed).alias("b")).collect() if r.a != r.b] == []
