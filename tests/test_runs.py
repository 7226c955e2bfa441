"""Runs that stand when a stage isn't repeatable: requests counted, stages kept, answers committed, requests logged."""

import itertools
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import control, groups, templates
from quire.operators.memo import MemoTable, RequestLog
from quire.operators.runs import Run
from quire.operators.translate import Hooks, Model, Settings, Translation, translate_books
from quire.plans import standin
from quire.sources import package
from quire.sources.markup import Node

from .test_package import CHAPTER, CONTAINER, NCX, OPF, RICH, rich_book

PAGE = '<html xmlns="http://www.w3.org/1999/xhtml"><body>{}</body></html>'


def counting(folder, once=None):
    """A model that says something else at each call and writes down that it was asked."""

    def note(kind):
        n = random.randrange(10**12)
        (folder / f"{kind}-{time.time_ns()}-{n}").write_text("")
        return n

    def translate(messages):
        return f"{messages[-1][1].upper()} {note('translate')}"

    def fill(messages):
        n, answer = note("fill"), standin.fill(messages)
        return answer.text.replace("</p>", f" {n}</p>") if n % 3 else "nothing this time"

    return Model(translate, fill, retries=0)


def asked(folder, kind):
    return len(list(folder.glob(f"{kind}-*")))


def test_each_member_once_and_each_request_once(spark, tmp_path):
    members = rich_book(spark, {"OPS/c1.xhtml": RICH})
    done = Translation(members, counting(tmp_path), Settings(budget=400, attempts=4), log=RequestLog(spark, f"{tmp_path}/log"))
    first = {r.path: bytes(r.content) for r in done.result().collect()}
    assert done.result().count() == members.count() == len(first)
    n_groups, n_tries = done.requests.count(), done.attempts().count()
    assert n_groups > 1 and asked(tmp_path, "translate") == n_groups == done.remembered.count() and asked(tmp_path, "fill") == n_tries
    # Whatever else is asked of the run, it describes the same one.
    assert {r.path: bytes(r.content) for r in done.result().collect()} == first
    assert done.failures().where("not over_maximum_retries").count() == done.attempts().where("error is not null").count()
    assert asked(tmp_path, "translate") == n_groups and asked(tmp_path, "fill") == n_tries
    rows = RequestLog(spark, f"{tmp_path}/log").read()
    assert {(r.kind, r["count"]) for r in rows.groupBy("kind").count().collect()} == {("translate", n_groups), ("fill", n_tries)}
    assert rows.select("kind", "key", "book_id", "group_no", "attempt").distinct().count() == n_groups + n_tries and rows.where("tries != 1").isEmpty()


def test_translate_books_needs_no_option(spark, tmp_path):
    members = rich_book(spark, {"OPS/c1.xhtml": CHAPTER})
    got = translate_books(members, counting(tmp_path)).collect()
    assert sorted(r.path for r in got) == sorted(r.path for r in members.collect())
    assert asked(tmp_path, "translate") == 1


def test_a_run_goes_on_where_it_ended(spark, tmp_path):
    members, name = rich_book(spark, {"OPS/c1.xhtml": RICH}), f"named-{time.time_ns()}"

    def down(messages):
        raise ValueError("down")

    model = counting(tmp_path)
    with pytest.raises(Exception, match="down"):
        Translation(members, Model(model.translate, down, retries=0), Settings(budget=400), run_id=name).filled.count()
    n = asked(tmp_path, "translate")
    folder = tmp_path / "shared"
    runs = [Run(spark, name, f"file://{folder}") for _ in range(2)]
    first = runs[0].keep(spark.range(3).select(F.rand().alias("x")), "stage").collect()
    assert sorted(runs[1].keep(spark.range(9).select(F.rand().alias("x")), "stage").collect()) == sorted(first)
    runs[1].drop()
    assert n > 1 and not (folder / f"run-{name}").exists()


def test_members_replaced_once(spark):
    rows = spark.createDataFrame([("b", i, f"m{i}", 0, bytearray(b"old")) for i in range(4)], package.MEMBERS)
    new = spark.createDataFrame([("b", "m1", bytearray(b"new")), ("b", "m1", bytearray(b"new")), ("b", "none", bytearray(b"x")), ("c", "m2", bytearray(b"x"))], "book_id string, path string, content binary")
    assert sorted((r.path, bytes(r.content)) for r in package.with_replaced(rows, new).collect()) == [("m0", b"old"), ("m1", b"new"), ("m2", b"old"), ("m3", b"old")]


def test_package_file_of_any_name(spark):
    files = {"META-INF/container.xml": CONTAINER.replace("book.opf", "package.xml"), "mimetype": "application/epub+zip", "OPS/package.xml": OPF, "OPS/toc.ncx": NCX, "OPS/c1.xhtml": CHAPTER}
    rows = [("b", i, path, 0, bytearray(text.encode())) for i, (path, text) in enumerate(files.items())]
    rows += [("no package", 0, "META-INF/container.xml", 0, bytearray(CONTAINER.encode())), ("no container", 0, "x.opf", 0, bytearray(OPF.encode())), ("broken", 0, "META-INF/container.xml", 0, bytearray(b"<a"))]
    members = spark.createDataFrame(rows, package.MEMBERS)
    found = {r.book_id: r for r in package.packages(members).collect()}
    assert found["b"].opf_path == "OPS/package.xml" and found["b"].error is None and len(found) == 4
    assert found["no package"].error.startswith("KeyError") and found["no container"].error.startswith("KeyError") and found["broken"].error.startswith("ValueError")
    got = {(r.book_id, r.path): bytes(r.content).decode() for r in translate_books(members, standin.MODEL).collect()}
    assert "HELLO" in got["b", "OPS/c1.xhtml"] and "A BOOK" in got["b", "OPS/package.xml"] and len(got) == len(rows)


# -- calls in flight


def test_calls_overlap_up_to_the_bound():
    lock, now, most = threading.Lock(), 0, 0
    taken = []

    def call(x):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.01 * ((x * 7) % 4))
        with lock:
            now -= 1
        return x * x

    def items():
        for i in range(40):
            taken.append(i)
            yield i

    results = control.in_flight(items(), call, 4)
    assert next(results) == 0 and len(taken) <= 5  # nothing is taken before there is room for it
    assert [0, *results] == [i * i for i in range(40)] and most == 4
    assert list(control.in_flight(range(5), call, 1)) == [0, 1, 4, 9, 16]
    with pytest.raises(ValueError):
        next(control.in_flight([1], call, 0))


def test_the_first_error_ends_it():
    begun = []

    def call(x):
        begun.append(x)
        time.sleep(0.02 if x else 0.3)
        if x == 2:
            raise RuntimeError("two")
        return x

    with pytest.raises(RuntimeError, match="two"):
        list(control.in_flight(range(100), call, 4))
    assert len(begun) < 12


def test_stage_in_flight_keeps_rows_in_order(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i}") for i in range(50)], "i int, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        got = control.model_stage(rows, lambda t: control.Answer(t.upper(), {"total": len(t)}), bound=3, told="call").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.i, r.answer) for r in got] == [(i, None if i % 7 == 0 else f"T{i}") for i in range(50)]
    assert all((r.call is None) == (r.i % 7 == 0) for r in got) and got[10].call.total == 3


# -- answers


def test_chunks_counters_and_sampling():
    assert control.collected(iter(["a", {"input": 3, "output": None}, "", "b", {"input": 5}])).usage == {"input": 5}
    assert control.collected(iter(["a", {"x": 1}, "b"])).text == "ab"
    broken = itertools.count()

    def stream(messages, sampling):
        yield "half"
        if next(broken) < 2:
            raise ConnectionError
        yield f" {sampling['temperature']} {sampling['top_p']}"

    model = Model(stream, stream, retries=3, pause=0, temperature=(0.0, 1.0), top_p=0.5)
    got = model.ask(stream, [], 0)  # a stream that breaks off begins anew, with the next value
    assert got.text == "half 0.75 0.5" and got.tries == 3
    assert [model.sampling(i)["temperature"] for i in range(4)] == [0, 0.5, 0.75, 0.875] and Model(stream, stream).sampling(3) == {}


# -- the memo table


def answers(spark, **pairs):
    return spark.createDataFrame([(k, v) for k, v in pairs.items()], MemoTable.SCHEMA)


def stored(memo):
    return sorted(tuple(r) for r in memo.read().collect())


def test_first_answer_of_a_key_stays(spark, tmp_path):
    memo = MemoTable(spark, f"file://{tmp_path}/memo")
    assert memo.read().count() == 0 and memo.append(answers(spark, a="1", b="2")) == 2
    old = memo.read()
    assert memo.append(answers(spark, b="3", c="4")) == 1 and memo.append(answers(spark, a="5")) == 0
    assert stored(memo) == [("a", "1"), ("b", "2"), ("c", "4")] and old.count() == 2


def test_two_runs_at_once(spark, tmp_path, monkeypatch):
    """The second run commits between the first one's staging and its entry."""
    one, two = (MemoTable(spark, f"file://{tmp_path}/memo") for _ in range(2))
    put, between = one._put, [True]

    def late(path, text):
        if between:
            between.pop()
            two.append(answers(spark, b="second", c="second"))
        return put(path, text)

    monkeypatch.setattr(one, "_put", late)
    assert one.append(answers(spark, a="first", b="first")) == 1
    assert stored(one) == [("a", "first"), ("b", "second"), ("c", "second")]
    assert one.vacuum() == 1 and stored(one) == [("a", "first"), ("b", "second"), ("c", "second")]


def test_many_threads(spark, tmp_path):
    memos = [MemoTable(spark, f"file://{tmp_path}/memo") for _ in range(4)]
    threads = [threading.Thread(target=m.append, args=(answers(spark, k=str(i), **{f"own{i}": "x"}),)) for i, m in enumerate(memos)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    keys = [k for k, _ in stored(memos[0])]
    assert sorted(keys) == ["k", "own0", "own1", "own2", "own3"]


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    memo = MemoTable(spark, f"file://{tmp_path}/memo")
    members = rich_book(spark, {"OPS/c1.xhtml": CHAPTER})

    def down(messages):
        raise ValueError("down")

    with pytest.raises(Exception, match="down"):
        translate_books(members, Model(standin.translate, down, retries=0), memo=memo).count()
    assert memo.read().count() == 0
    assert translate_books(members, standin.MODEL, memo=memo).count() == members.count()
    n = memo.read().count()
    assert n == 1
    got = translate_books(members, Model(down, standin.fill, retries=0), memo=memo)  # known now, so not asked
    assert got.count() == members.count() and memo.read().count() == n


# -- hooks


def test_hooks(spark):
    members = rich_book(spark, {"OPS/c1.xhtml": PAGE.format("<p>one</p><p>two</p>")})
    hooks = Hooks(
        tasks=lambda t: t.where("kind = 'chapter'"), sources=lambda b: b.withColumn("text", F.regexp_replace("text", "one", "uno")),
        answers=lambda a: a.withColumn("answer", F.concat("answer", F.lit("!"))), filled=lambda f: f.withColumn("best", F.slice("best", 1, 1)),
    )
    done = Translation(members, standin.MODEL, Settings(action="replace"), hooks=hooks)
    got = {r.path: bytes(r.content).decode() for r in done.result().collect()}
    assert [r.source for r in done.requests.collect()] == ["uno\n\ntwo"] and [r.answer for r in done.answers.collect()] == ["UNO\n\nTWO!"]
    assert "<p>ONE</p><p>two</p>" in got["OPS/c1.xhtml"] and got["OPS/toc.ncx"] == NCX
    with pytest.raises(ValueError, match="hook sources"):
        Translation(members, standin.MODEL, hooks=Hooks(sources=lambda b: b.drop("text"))).blocks


# -- groups


def cost(found, incisions):
    return sum(c for a, b, c in zip(found, found[1:], incisions) if a != b), found[-1] + 1 if found else 0


def test_best_split_is_the_best():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(0, 8)
        scores, incisions, budget = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 3) for _ in range(n)], rng.randint(1, 20)
        every = []
        for cuts in itertools.product([0, 1], repeat=max(0, n - 1)):
            found = list(itertools.accumulate([0, *cuts])) if n else []
            sums = [[s for s, g in zip(scores, found) if g == k] for k in set(found)]
            if all(len(x) == 1 or sum(x) <= budget for x in sums):
                every.append(cost(found, incisions))
        got = groups.best_split(scores, incisions, budget)
        assert cost(got, incisions) == min(every, default=(0, 0))
        greedy = groups.greedy(scores, budget)
        if all(s <= budget for s in scores) and 0 not in scores:
            assert cost(got, incisions) <= cost(greedy, incisions)


def test_plan_of_groups(spark):
    """Two documents share a group, a long one is cut at its cheap border, context comes from the group's own documents."""
    rows = [(1, 0, 10, 1), (1, 1, 10, 0), (2, 2, 15, 0), (3, 3, 40, 2), (3, 4, 40, 1), (3, 5, 40, 2), (3, 6, 30, 0)]
    items = spark.createDataFrame([("b", *r) for r in rows], "book string, task int, seq int, score int, incision int")
    got = sorted((r.group_no, r.seq, r.side, r.kept) for r in groups.planned(items, ["book"], "task", "seq", "score", "incision", 100).collect())
    body = [x for x in got if x[2] == 0]
    assert body == [(0, 0, 0, 10), (0, 1, 0, 10), (0, 2, 0, 15), (1, 3, 0, 40), (1, 4, 0, 40), (2, 5, 0, 40), (2, 6, 0, 30)]
    assert [x for x in got if x[2]] == [(1, 5, 1, 3), (2, 4, -1, 4)]
    assert groups.planned(items.limit(0), ["book"], "task", "seq", "score", "incision", 100).count() == 0


def test_context_in_part():
    b = Node("b", {}, "two three", " four")
    p = Node("p", {"id": "1"}, "one ", "", [b, Node("i", {}, "five", "")])
    whole = templates.pieces(p)
    size = sum(x.score for x in whole)
    assert templates.trimmed(p, size, True).plain() == "one two three fourfive"
    end = templates.trimmed(p, whole[-1].score, True)
    assert end.plain() == "five" and [c.tag for c in end.children] == ["i"]
    start = templates.trimmed(p, whole[0].score, False)
    assert start.plain() == "one " and not start.children and start.attrs == {"id": "1"}
    cut = templates.trimmed(p, whole[0].score + whole[1].fixed + 1, False)
    assert cut.plain() == "one two ..." and [c.tag for c in cut.children] == ["b"]
    assert templates.trimmed(p, 1, True) is None


# -- answers in chunks


def chunk_rows(seed):
    """Requests whose chunks come in any order, some twice, some never, some without an end."""
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        n = rng.randint(1, 6)
        for no in range(n):
            if rng.random() < 0.9:
                for _ in range(rng.choice([1, 1, 2])):
                    rows.append((f"r{i}", no, rng.choice(["ab", "", None]) if no else "x", no == n - 1, 1000 + no, 10 + i if no == n - 1 else None, None))
    texts = {}
    rows = [(r, no, texts.setdefault((r, no), t), *rest) for r, no, t, *rest in rows]  # a chunk that comes again is the same
    rng.shuffle(rows)
    return rows


def test_answers_in_a_stream_equal_those_in_a_batch(spark, tmp_path):
    from quire.streaming import answers

    schema = "request string, no int, text string, last boolean, at int, input long, output long"
    rows = chunk_rows(3)
    shaped = lambda df: df.select("request", "no", "text", "last", F.timestamp_seconds("at").alias("ts"), "input", "output")
    batch = {r.request: r for r in answers.folded(shaped(spark.createDataFrame(rows, schema))).collect()}
    for i in range(0, len(rows), 40):
        shaped(spark.createDataFrame(rows[i : i + 40], schema)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    # News of another request long after: what was not complete is given up.
    for at in (10_000, 20_000, 30_000):
        shaped(spark.createDataFrame([("late", 0, "z", False, at, None, None)], schema)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    feed = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/feed").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    answers.answers(feed).writeStream.format("memory").queryName("folded").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("folded").where("request != 'late'").collect()
    assert len({r.request for r in got}) == len(got) == len(batch)
    assert {r.request: r for r in got} == batch
    assert {r.complete for r in got} == {True, False}


def test_a_request_with_news_waits_on(spark, tmp_path):
    """a request's one timer goes off and is set anew where there was news since; what was given up comes out once."""
    from quire.streaming import answers

    schema = "request string, no int, text string, last boolean, at int, input long, output long"
    feed = [("r", 0, "a", False, 1000), ("r", 1, "b", False, 1500), ("x", 0, "", False, 2250), ("x", 0, "", False, 2300), ("r", 2, "c", True, 2050), ("x", 1, "", False, 5000), ("x", 1, "", False, 9000), ("x", 1, "", False, 9001)]
    feed = [("q", 1, "never", True, 1000), *feed]
    for i, (r, no, t, last, at) in enumerate(feed):
        one = spark.createDataFrame([(r, no, t, last, at, 7 if last else None, 8 if last else None)], schema)
        one.select("output", "input", F.timestamp_seconds("at").alias("ts"), "last", "text", "no", "request").coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        time.sleep(0.02)
    rows = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/feed").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    answers.answers(rows).writeStream.format("memory").queryName("waiting").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.table("waiting").where("request != 'x'").collect()))
    assert got == [("q", "", 0, False, 7, 8), ("r", "abc", 3, True, 7, 8)]


def shuffled(spark):
    """Names of the files of shuffles that this session still has."""
    from pathlib import Path

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {p.name for d in manager.localDirsString() for p in Path(d).rglob("shuffle_*")}


def test_a_stage_leaves_no_shuffles_and_is_compressed(spark, tmp_path):
    import pyarrow.parquet as pq

    run = Run(spark, "lean", f"file://{tmp_path}")
    before, setting = shuffled(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    rows = run.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids")), "stage")
    assert rows.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    for _ in range(50):  # the files go in the background
        left = {x.split("_")[1] for x in shuffled(spark) - before}
        if len(left) <= 1:  # that of the count
            break
        time.sleep(0.2)
    assert len(left) <= 1
    found = [pq.ParquetFile(f).metadata for f in (tmp_path / "run-lean" / "stage").glob("*.parquet")]
    assert {m.row_group(0).column(0).compression for m in found if m.num_row_groups} == {"ZSTD"}


def test_stages_go_once_the_next_ones_hold_them(spark, tmp_path):
    from pathlib import Path

    members = rich_book(spark, {"OPS/c1.xhtml": RICH})
    stages = lambda t: {p.parent.name for p in Path(t.run.folder.removeprefix("file://")).glob("*/_SUCCESS")}
    done = Translation(members, counting(tmp_path), Settings(budget=400, attempts=4))
    first = sorted((r.book_id, r.path, bytes(r.content)) for r in done.result().collect())
    assert stages(done) == {"members", "tasks", "bodies", "answers", "filled", "changed"}
    n = asked(tmp_path, "translate"), asked(tmp_path, "fill")
    again = sorted((r.group_no, r.source) for r in done.requests.collect())  # made again, no model asked
    assert again and n == (asked(tmp_path, "translate"), asked(tmp_path, "fill"))
    assert {r.key for r in done.requests.select("key").collect()} == {r.key for r in done.answers.select("key").collect()}
    assert done.mappings().count() == done.requests.select(F.inline("blocks")).where("body").count()
    assert sorted((r.book_id, r.path, bytes(r.content)) for r in done.result().collect()) == first

    kept = Translation(members, counting(tmp_path), Settings(budget=400, attempts=4))
    blocks, wanted = kept.blocks, kept.requests  # what was asked for as a table stays
    kept.result().count()
    assert blocks.count() == kept.mappings().count() and sorted((r.group_no, r.source) for r in wanted.collect()) == again


def test_a_run_goes_on_without_stages_that_are_over(spark, tmp_path):
    members, name = rich_book(spark, {"OPS/c1.xhtml": RICH}), f"over-{time.time_ns()}"
    seen = spark.sparkContext.accumulator(0)
    hooks = Hooks(sources=lambda b: b.mapInPandas(lambda fs: (seen.add(len(f)) or f for f in fs), b.schema))
    runs = [Translation(members, counting(tmp_path), Settings(budget=400, attempts=4), hooks=hooks, run_id=name) for _ in range(2)]
    first, n = sorted(map(tuple, runs[0].mappings().collect())), asked(tmp_path, "translate")
    parsed = seen.value
    assert sorted(map(tuple, runs[1].mappings().collect())) == first and asked(tmp_path, "translate") == n and seen.value == parsed
    runs[1].run.drop()
