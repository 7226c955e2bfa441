"""Names of the queries over the test tables, with their oracles.

The test tables stand in for the engine's own: documents are chapters whose lines are paragraphs,
conversations are request histories, events are attempts, pages are raw chapters. A volume is a run of
500 chapters of one source, the unit that sequential packing runs in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import control, groups, islands, reassembly, runs, selection, serial, templates, translate, trees
from quire.plans import standin
from quire.sources import archive, markup, package
from quire.streaming import answers

FLAGSHIP = "budget_groups"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, source, line, text: non-blank lines of chapters with normal white space."""
    return lines(docs.select("doc_id", "source", "text"))


def lines(docs: DataFrame, also: str = "") -> DataFrame:
    """Texts are normalised whole, before they are cut: a condition on lines would do it for each line again."""
    named = [c for c in docs.columns if c != "text"]
    return docs.select(*named, F.posexplode(F.split(X.normalize_lines(F.col("text"), also), "\n")).alias("line", "text")).where("trim(text) <> ''")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines: the same lines, without characters of markup, in an array for each document with any.

    Whether it has any is seen at its first character of that kind, so plans that need ids only don't normalise texts.
    """
    docs = read(spark, sf_dir, "documents").where(F.rlike("text", F.lit(r"(?U)[^\s<>&]")))
    cut = F.transform(F.split(X.normalize_lines(F.col("text"), "<>&"), "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    return docs.select("doc_id", F.filter(cut, lambda x: F.trim(x["text"]) != "").alias("lines"))


def scored(docs: DataFrame) -> DataFrame:
    return paragraphs(docs).select("doc_id", "source", "line", X.n_tokens(F.col("text")).alias("score"))


LINES = r"""lines AS (SELECT doc_id, source, i - 1 AS line, regexp_replace(l[i], '\s+', ' ', 'g') AS text
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
    WHERE trim(regexp_replace(l[i], '\s+', ' ', 'g')) <> '')"""
TOKENS = "len(regexp_extract_all(text, '<[^>]*>|[A-Za-z]+|[\\s\\S]'))"
#: Paragraphs without characters of markup, as they go into chapters.
PLAIN = f"""{LINES}, plain AS (SELECT doc_id, line, regexp_replace(translate(text, '<>&', '   '), '\\s+', ' ', 'g') AS text FROM lines WHERE trim(translate(text, '<>&', '   ')) <> '')"""
SCORED = f"{LINES}, scored AS (SELECT doc_id, source, line, {TOKENS} AS score FROM lines)"


@query(r"SELECT doc_id, length(n) AS n_chars, md5(n) AS digest FROM (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS n FROM documents)")
def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.normalize_whitespace(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(n).alias("n_chars"), F.md5(n).alias("digest"))


@query(f"WITH {LINES} SELECT doc_id, line, length(text) AS n_chars, md5(text) AS digest FROM lines")
def paragraph_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(read(spark, sf_dir, "documents")).select("doc_id", "line", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"WITH {SCORED} SELECT doc_id, sum(score) AS score, count(*) AS n_lines FROM scored GROUP BY 1")
def token_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n_lines"))


@query(f"""WITH RECURSIVE {SCORED},
    nums AS (SELECT source, doc_id // 500 AS volume, score, row_number() OVER (PARTITION BY source, doc_id // 500 ORDER BY doc_id, line) AS k FROM scored),
    fold AS (SELECT source, volume, k, score AS s, 0 AS group_no, score FROM nums WHERE k = 1
        UNION ALL SELECT n.source, n.volume, n.k, CASE WHEN f.s > 0 AND f.s + n.score > 2600 THEN n.score ELSE f.s + n.score END,
            CASE WHEN f.s > 0 AND f.s + n.score > 2600 THEN f.group_no + 1 ELSE f.group_no END, n.score
        FROM fold f JOIN nums n ON n.source = f.source AND n.volume = f.volume AND n.k = f.k + 1)
    SELECT source, volume, group_no, count(*) AS n_items, sum(score) AS score FROM fold GROUP BY 1, 2, 3""")  # fmt: skip
def budget_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = scored(read(spark, sf_dir, "documents")).withColumn("volume", F.expr("doc_id div 500"))
    return groups.budget_groups(items, ["source", "volume"], ["doc_id", "line"], "score", 2600)


@query(f"""WITH {SCORED}, b AS (SELECT *, coalesce(sum(score) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nearer FROM scored)
    SELECT doc_id, line, score, least(score, 300 - nearer) AS kept FROM b WHERE nearer < 300""")
def context_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.context(scored(read(spark, sf_dir, "documents")), ["doc_id"], ["line"], "score", 300).select("doc_id", "line", "score", "kept")


@query(f"""WITH {SCORED}, b AS (SELECT *, coalesce(sum(score) OVER (PARTITION BY doc_id ORDER BY line DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nearer FROM scored)
    SELECT doc_id, line, score, least(score, 300 - nearer) AS kept FROM b WHERE nearer < 300""")
def context_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.context(scored(read(spark, sf_dir, "documents")), ["doc_id"], ["line"], "score", 300, "head").select("doc_id", "line", "score", "kept")


@query(f"""WITH {SCORED} SELECT doc_id, line, CASE WHEN lag(1) OVER w IS NULL THEN 0 ELSE 1 END AS start_incision,
    CASE WHEN lead(1) OVER w IS NULL THEN 0 ELSE 1 END AS end_incision FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY line)""")
def block_incisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.incisions(scored(read(spark, sf_dir, "documents")), ["doc_id"], ["line"]).select("doc_id", "line", "start_incision", "end_incision")


@query(f"""WITH RECURSIVE {SCORED}, c AS (SELECT doc_id, line, score, 1 + length(text) % 3 AS inc FROM scored JOIN lines USING (doc_id, source, line)),
    d AS (SELECT doc_id, list(score ORDER BY line) AS s, list(inc ORDER BY line) AS c, list(upto ORDER BY line) AS p FROM (SELECT *, sum(score) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM c) GROUP BY 1),
    best AS (SELECT doc_id, s, c, list_prepend(0, p) AS p, 0 AS j, [0::BIGINT] AS v, []::BIGINT[] AS f FROM d
        UNION ALL SELECT doc_id, s, c, p, j + 1, list_append(v, m // 1000000 + 1 + CASE WHEN j + 1 < len(s) THEN 1000000 * c[j + 1] ELSE 0 END), list_append(f, m % 1000000)
        FROM (SELECT *, list_min([v[i + 1] * 1000000 + i for i in range(0, j + 1) if i = j or p[j + 2] - p[i + 1] <= 600]) AS m FROM best WHERE j < len(s))),
    back AS (SELECT doc_id, s, f, len(s) AS hi, f[len(s)] AS lo FROM best WHERE j = len(s) UNION ALL SELECT doc_id, s, f, lo, f[lo] FROM back WHERE lo > 0)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS segment_no, hi - lo AS n_items, cast(list_sum(s[lo + 1 : hi]) AS bigint) AS score FROM back""")  # fmt: skip
def border_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in segments of 600 tokens at most, cut where that costs least; what a border costs follows from the text before it."""
    lines = paragraphs(read(spark, sf_dir, "documents")).select("doc_id", "line", X.n_tokens(F.col("text")).alias("score"), (1 + F.length("text") % 3).alias("incision"))
    cut = groups.border_split(lines, ["doc_id"], ["line"], "score", "incision", 600)
    return cut.join(lines, ["doc_id", "line"]).groupBy("doc_id", F.col("segment_no").cast("long").alias("segment_no")).agg(F.count(F.lit(1)).alias("n_items"), F.sum("score").alias("score"))


VOLUMES = f"""{SCORED}, g AS (SELECT source, doc_id // 500 AS volume, doc_id, least(sum(score), 40) AS head, sum(score) AS body, least(sum(score), 60) AS tail FROM scored GROUP BY 1, 2, 3),
    nums AS (SELECT *, row_number() OVER (PARTITION BY source, volume ORDER BY doc_id) AS k FROM g)"""


@query(f"""WITH RECURSIVE {VOLUMES},
    fold AS (SELECT source, volume, k, 0 AS merged_no, head + body AS s, head, body, tail FROM nums WHERE k = 1
        UNION ALL SELECT n.source, n.volume, n.k, CASE WHEN f.s + n.body + n.tail > 5000 THEN f.merged_no + 1 ELSE f.merged_no END,
            CASE WHEN f.s + n.body + n.tail > 5000 THEN n.head + n.body ELSE f.s + n.body END, n.head, n.body, n.tail
        FROM fold f JOIN nums n ON n.source = f.source AND n.volume = f.volume AND n.k = f.k + 1)
    SELECT source, volume, merged_no, count(*) AS n_groups, arg_min(head, k) AS head, sum(body) AS body, arg_max(tail, k) AS tail FROM fold GROUP BY 1, 2, 3""")  # fmt: skip
def coalesced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scored(read(spark, sf_dir, "documents")).withColumn("volume", F.expr("doc_id div 500")).groupBy("source", "volume", "doc_id").agg(F.sum("score").alias("body"))
    g = g.withColumns({"head": F.least("body", F.lit(40)), "tail": F.least("body", F.lit(60))})
    return groups.coalesce_groups(g, ["source", "volume"], "doc_id", 5000)


@query("""SELECT conv_id, run_id, any_value(role) AS role, count(*) AS n_turns, min(turn) AS first_turn FROM (
    SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run_id FROM (
        SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) GROUP BY 1, 2""")
def block_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.runs(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role").groupBy("conv_id", "run_id").agg(F.first("role").alias("role"), F.count(F.lit(1)).alias("n_turns"), F.min("turn").alias("first_turn"))


COMMON = "CASE WHEN {0} IS NULL THEN 0 ELSE coalesce(nullif(list_position(list_transform(range(1, least(len(a), len({0})) + 1), lambda i: a[i] = {0}[i]), false), 0) - 1, least(len(a), len({0}))) END"


@query(f"""WITH {LINES}, s AS (SELECT doc_id, line, string_split(text, ' ') AS a FROM lines),
    n AS (SELECT *, lag(a) OVER w AS p, lead(a) OVER w AS q FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line))
    SELECT doc_id, line, {COMMON.format("p")} AS left_common, {COMMON.format("q")} AS right_common FROM n""")
def neighbour_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a line as its stack."""
    rows = paragraphs(read(spark, sf_dir, "documents")).select("doc_id", "line", F.split("text", " ").alias("stack"))
    return islands.common_depths(rows, ["doc_id"], ["line"], "stack").select("doc_id", "line", "left_common", "right_common")


@query("""SELECT doc_id, tag_name, trim(text) AS text FROM (SELECT doc_id, 'language' AS tag_name, lang AS text FROM documents UNION ALL SELECT doc_id, 'publisher', source FROM documents
    UNION ALL SELECT doc_id, 'title', string_split(text, chr(10))[1] FROM documents) WHERE tag_name NOT IN ('language', 'identifier', 'date', 'meta', 'contributor') AND trim(text) <> ''""")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.struct(F.lit(t).alias("tag_name"), c.alias("text")) for t, c in (("language", F.col("lang")), ("publisher", F.col("source")), ("title", F.get(F.split("text", "\n"), F.lit(0))))])).alias("f"))
    return package.translatable(fields.select("doc_id", "f.*"))


@query("""WITH o AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents),
    n AS (SELECT source, lang, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    SELECT o.source, o.lang, o.doc_id, coalesce(cast(n.n_chars AS varchar), 'kept') AS text FROM o LEFT JOIN n USING (source, lang, k)""")
def kth_field_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as fields of a source; those with labels bring new texts."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("lang").alias("tag_name"), F.col("doc_id").alias("field_no"), "n_chars")
    new = docs.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("field_no")).distinct(), "field_no").select("book_id", "tag_name", "field_no", F.col("n_chars").cast("string").alias("text"))
    rows = package.updated_fields(docs.select("book_id", "tag_name", "field_no", F.lit("kept").alias("text")), new)
    return rows.select(F.col("book_id").alias("source"), F.col("tag_name").alias("lang"), F.col("field_no").alias("doc_id"), "text")


@query("""WITH m AS (SELECT cast(p_size AS varchar) AS id, arg_max(p_name, p_partkey) AS href, arg_max(p_type, p_partkey) AS media FROM part GROUP BY 1)
    SELECT l_orderkey AS book_id, l_linenumber AS spine_pos, count(*) AS n, 'OPS/' || any_value(href) AS path FROM lineitem JOIN m ON m.id = cast(cast(l_quantity AS int) AS varchar) WHERE media IN ('ECONOMY', 'STANDARD') GROUP BY 1, 2, href""")
def spine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = read(spark, sf_dir, "part").select(F.lit("all").alias("shelf"), F.col("p_size").cast("string").alias("id"), F.col("p_name").alias("href"), F.col("p_type").alias("media_type"), F.col("p_partkey").alias("pos"))
    refs = read(spark, sf_dir, "lineitem").select(F.lit("all").alias("shelf"), F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("spine_pos"), F.col("l_quantity").cast("int").cast("string").alias("idref"))
    rows = package.spine(manifest, refs, ["shelf"], F.lit("OPS"), ("ECONOMY", "STANDARD"))
    return rows.groupBy("book_id", "spine_pos", "path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'new' ELSE cast(n_chars AS varchar) END AS content FROM documents")
def members_copy_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members without new content keep what they had; those with labels get one."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("entry_no"), F.col("doc_id").cast("string").alias("path"), F.lit(8).alias("compress_type"), F.col("n_chars").cast("string").alias("content"))
    marked = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("entry_no")).distinct()
    new = docs.join(marked, "entry_no").select("book_id", "path", F.lit("new").alias("content"))
    return package.with_replaced(docs, new).select(F.col("entry_no").alias("doc_id"), "content")


@query(f"WITH {PLAIN} SELECT doc_id // 25 AS book, 'OPS/c' || cast(doc_id AS varchar) || '.xhtml' AS path, md5('<html xmlns=\"http://www.w3.org/1999/xhtml\"><body>' || string_agg('<p>' || text || '</p>', '' ORDER BY line) || '</body></html>') AS digest FROM plain GROUP BY doc_id")
def archive_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written as files in one commit, then their chapters read without inflating the rest."""
    folder = f"{runs.Run(spark).folder}/books"
    archive.written(standin.books(plain(spark, sf_dir)), folder)
    book = F.regexp_extract("book_id", "([0-9]+)[.]epub$", 1).cast("long").alias("book")
    return archive.members(spark, folder, "OPS/c", ".xhtml").select(book, "path", F.md5("content").alias("digest"))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN NULL ELSE (turn - 1) // 2 END AS parent, (turn + 1) % 2 AS child_no, length(text) % 7 = 0 AS blank FROM conversations),
    p AS (SELECT conv_id, turn, [child_no] AS path, [turn] AS above FROM t WHERE parent IS NULL AND NOT blank
        UNION ALL SELECT t.conv_id, t.turn, list_append(p.path, t.child_no), list_append(p.above, t.turn) FROM p JOIN t ON t.conv_id = p.conv_id AND t.parent = p.turn WHERE NOT t.blank),
    n AS (SELECT conv_id, a, count(*) - 1 AS below FROM (SELECT conv_id, unnest(above) AS a FROM p) GROUP BY 1, 2)
    SELECT p.conv_id, turn, len(path) - 1 AS depth, row_number() OVER (PARTITION BY p.conv_id ORDER BY path) - 1 AS lo, row_number() OVER (PARTITION BY p.conv_id ORDER BY path) - 1 + below AS hi, array_to_string(path, '.') AS path
    FROM p JOIN n ON n.conv_id = p.conv_id AND n.a = turn""")
def tree_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as trees, two answers to each, in preorder intervals; a turn that counts as blank goes with all below it."""
    turns = read(spark, sf_dir, "conversations").where("length(text) % 7 != 0")
    nodes = turns.select("conv_id", "turn", F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2")).alias("parent"), ((F.col("turn") + 1) % 2).alias("child_no"))
    rows = trees.placed(nodes, ["conv_id"], "turn")
    return rows.select("conv_id", "turn", F.col("depth").cast("long").alias("depth"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.array_join("path", ".").alias("path"))


#: Turns as entries of contents: some have ids, some repeat, and the new ones stand in another order.
ENTRIES = """old AS (SELECT conv_id, turn AS pos, CASE WHEN turn % 3 > 0 THEN role END AS id, CASE WHEN turn % 4 > 0 THEN length(text) % 5 END AS href FROM conversations),
    new AS (SELECT conv_id, length(text) * 1000 + turn AS pos, CASE WHEN turn % 2 = 0 THEN role END AS id, CASE WHEN turn % 5 > 0 THEN length(text) % 5 END AS href FROM conversations WHERE turn % 7 <> 3)"""


@query(f"""WITH {ENTRIES},
    i AS (SELECT a.conv_id, a.pos, b.pos AS old_pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY pos) AS k FROM new WHERE id IS NOT NULL) a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY pos) AS k FROM old WHERE id IS NOT NULL) b USING (conv_id, id, k)),
    n1 AS (SELECT * FROM new WHERE NOT EXISTS (FROM i WHERE i.conv_id = new.conv_id AND i.pos = new.pos)), o1 AS (SELECT * FROM old WHERE NOT EXISTS (FROM i WHERE i.conv_id = old.conv_id AND i.old_pos = old.pos)),
    h AS (SELECT a.conv_id, a.pos, b.pos AS old_pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, href ORDER BY pos) AS k FROM n1 WHERE href IS NOT NULL) a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id, href ORDER BY pos) AS k FROM o1 WHERE href IS NOT NULL) b USING (conv_id, href, k)),
    n2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM n1 WHERE NOT EXISTS (FROM h WHERE h.conv_id = n1.conv_id AND h.pos = n1.pos)), o2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM o1 WHERE NOT EXISTS (FROM h WHERE h.conv_id = o1.conv_id AND h.old_pos = o1.pos))
    SELECT conv_id, pos, old_pos FROM i UNION ALL SELECT conv_id, pos, old_pos FROM h UNION ALL SELECT n2.conv_id, n2.pos, o2.pos FROM n2 LEFT JOIN o2 USING (conv_id, k)""")  # fmt: skip
def contents_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which old entry each new one goes on, by id, then by href, then by place, each old one once."""
    turns = read(spark, sf_dir, "conversations")
    old = turns.select("conv_id", F.col("turn").alias("at"), F.when(F.col("turn") % 3 > 0, F.col("role")).alias("id"), F.when(F.col("turn") % 4 > 0, F.length("text") % 5).alias("href"))
    new = turns.where("turn % 7 <> 3").select("conv_id", (F.length("text") * 1000 + F.col("turn")).alias("at"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("id"), F.when(F.col("turn") % 5 > 0, F.length("text") % 5).alias("href"))
    return trees.matched(old, new, ["conv_id"], ("id", "href")).select("conv_id", F.col("at").alias("pos"), F.col("old_at").alias("old_pos"))


@query(f"WITH {PLAIN} SELECT DISTINCT cast(doc_id // 25 AS varchar) AS book_id, 'OPS/c' || cast(doc_id AS varchar) || '.xhtml' AS path FROM plain")
def list_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters by the start of their names, of archives that were put together and opened again."""
    archives = package.zipped(standin.books(plain(spark, sf_dir)))
    return package.names(archives, "OPS/c").where("path <> 'OPS/cover.png'").select("book_id", "path")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS n FROM events) WHERE n = 1""")
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_attempts(read(spark, sf_dir, "events"), ["user_id", "event_type"], "value", ["event_id"]).select("user_id", "event_type", "event_id", "value")


KINDS = "['block_expected_ids','block_wrong_tag','block_invalid_id','block_unexpected_id','inline_expected_ids','inline_lost_id','inline_invalid_id','inline_wrong_tag_count','inline_unexpected_id']"
ERRORS = f"""errs AS (SELECT user_id, event_id % 7 AS block_id, event_id AS index1, 0 AS index2, {KINDS}[(event_id % 9) + 1] AS kind, event_id % 3 + 1 AS n_ids, [6, 5, 4, 3, 3, 2, 1, 0, 0][(event_id % 9) + 1] AS level FROM events),
    weighed AS (SELECT *, cast(3 ** level * CASE WHEN kind LIKE '%expected_ids' AND kind NOT LIKE '%unexpected%' THEN n_ids ELSE 1 END AS bigint) AS weight FROM errs)"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in selection.LEVELS])
    e = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("block_id"), F.col("event_id").alias("index1"), F.lit(0).alias("index2"), F.get(kinds, (F.col("event_id") % 9).cast("int")).alias("kind"), (F.col("event_id") % 3 + 1).alias("n_ids"))
    return e.withColumns({"level": selection.level(F.col("kind")), "weight": selection.weight(F.col("kind"), F.col("n_ids"))})


@query(f"WITH {ERRORS} SELECT user_id, block_id, sum(weight) AS weight, count(*) AS n_errors FROM weighed GROUP BY 1, 2")
def error_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.group_errors(_errors(spark, sf_dir), ["user_id"])


@query(f"""WITH {ERRORS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY level DESC, index1, index2) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM weighed)
    SELECT user_id, rank, index1, level, greatest(n - 10, 0) AS omitted FROM r WHERE rank <= 10""")
def error_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.top_errors(_errors(spark, sf_dir), ["user_id"], 10).select("user_id", "rank", "index1", "level", "omitted")


@query(f"""WITH {ERRORS}, b AS (SELECT *, min(weight) OVER (PARTITION BY user_id, block_id ORDER BY index1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM weighed)
    SELECT user_id, block_id, index1 AS attempt, CASE WHEN weight < before THEN level - 7 ELSE level END AS shown_level FROM b""")
def priority_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _errors(spark, sf_dir).withColumnRenamed("index1", "attempt")
    return selection.demoted(rows, ["user_id", "block_id"]).select("user_id", "block_id", "attempt", "shown_level")


@query("""WITH e AS (SELECT o_custkey AS answer, o_orderkey AS id, o_orderpriority AS tag FROM orders WHERE o_orderstatus <> 'P'),
    f AS (SELECT o_custkey AS answer, o_orderkey AS id, CASE WHEN o_totalprice > 250000 THEN 'other' ELSE o_orderpriority END AS tag FROM orders WHERE o_orderpriority <> '5-LOW'),
    j AS (SELECT coalesce(e.answer, f.answer) AS answer, coalesce(e.id, f.id) AS id, e.tag AS et, f.tag AS ft FROM e FULL JOIN f ON e.answer = f.answer AND e.id = f.id)
    SELECT answer, 'block_unexpected_id' AS kind, id AS block_id, cast(1 AS bigint) AS n_ids, cast(27 AS bigint) AS weight FROM j WHERE et IS NULL
    UNION ALL SELECT answer, 'block_wrong_tag', id, 1, 243 FROM j WHERE et <> ft
    UNION ALL SELECT answer, 'block_expected_ids', NULL, count(DISTINCT id), 729 * count(DISTINCT id) FROM j WHERE ft IS NULL GROUP BY 1""")
def block_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as blocks: those in progress aren't asked for, those of low priority aren't answered."""
    o = read(spark, sf_dir, "orders")
    ids = [F.col("o_custkey").alias("answer"), F.col("o_orderkey").alias("id")]
    found = o.where("o_orderpriority <> '5-LOW'").select(*ids, F.when(F.col("o_totalprice") > 250000, "other").otherwise(F.col("o_orderpriority")).alias("tag"), F.lit(0).alias("position"))
    expected = o.where("o_orderstatus <> 'P'").select(*ids, F.col("o_orderpriority").alias("tag"))
    return selection.validate_blocks(expected, found, ["answer"]).select("answer", "kind", "block_id", "n_ids", "weight")


@query("""WITH w AS (SELECT o_custkey AS parent, o_orderpriority AS tag, count(*) AS expected FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2), h AS (SELECT o_custkey AS parent, o_orderpriority AS tag, count(*) AS found FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2)
    SELECT h.parent, h.tag, coalesce(expected, 0) AS expected, found FROM h LEFT JOIN w ON h.parent = w.parent AND h.tag = w.tag WHERE coalesce(expected, 0) <> found""")
def tag_count_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderpriority").alias("tag"), "o_orderstatus")
    return selection.validate_tag_counts(o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus <> 'O'"), ["parent"])


COLLIDING = "CASE WHEN length(text) % 3 = 0 THEN role || '__translated' ELSE role END"


@query(f"""WITH RECURSIVE n AS (SELECT conv_id, turn, {COLLIDING} AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    f AS (SELECT conv_id, turn, k, id AS unique_id, [id] AS given, [id] AS ids FROM n WHERE k = 1
        UNION ALL SELECT conv_id, turn, k, unique_id, list_append(given, unique_id), list_append(ids, id) FROM (
            SELECT n.conv_id, n.turn, n.k, n.id, f.given, f.ids, CASE WHEN NOT list_contains(f.given, n.id) THEN n.id ELSE list_filter(list_transform(
                range(greatest(1, len(list_filter(f.ids, lambda x: x = n.id))), 60), lambda j: n.id || '__translated' || (CASE WHEN j = 1 THEN '' ELSE '_' || cast(j AS varchar) END)), lambda x: NOT list_contains(f.given, x))[1] END AS unique_id
            FROM f JOIN n ON n.conv_id = f.conv_id AND n.k = f.k + 1))
    SELECT conv_id, turn, unique_id FROM f""")
def dup_id_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as elements; some have an id that looks like a renamed one."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(COLLIDING).alias("id"))
    return islands.rename_duplicates(rows, ["conv_id"], "id", ["turn"]).select("conv_id", "turn", "unique_id")


@query("""SELECT conv_id, role AS id, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) > 1""")
def dup_id_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with a fenced block that is logged twice: the turns of a conversation as elements, roles as ids."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    elements = F.array_join(F.transform("t", lambda x: F.concat(F.lit('<p id="'), x["role"], F.lit('">x</p>'))), "")
    block = F.concat(F.lit('```XML\n<xml id="user">'), elements, F.lit("</xml>\n```"))
    log = turns.select("conv_id", F.concat(F.lit("asked\n"), block, F.lit("\nagain\n"), block, F.lit("\n```json\n{}\n```")).alias("log"))
    return islands.duplicate_ids(log, "conv_id", "log")


@query("""SELECT conv_id, turn, CASE WHEN d THEN sum(cast(d AS int)) OVER (PARTITION BY conv_id ORDER BY turn) END AS child_id
    FROM (SELECT *, count(DISTINCT length(text) % 2) OVER (PARTITION BY conv_id, role) > 1 AS d FROM conversations)""")
def sparse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").withColumn("mark", F.length("text") % 2)
    return islands.sparse_ids(rows, ["conv_id"], "role", ["turn"], "mark").select("conv_id", "turn", "child_id")


@query("""SELECT conv_id, turn, CASE WHEN role <> 'system' THEN sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) END AS new_id FROM conversations""")
def renumber_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.renumber(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") != "system").select("conv_id", "turn", "new_id")


@query(r"""SELECT conv_id, sha256('{"cache_seed": "1.0:French", "messages": [' || string_agg('{"message": "' || replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '", "role": '
    || CASE role WHEN 'system' THEN '1' WHEN 'user' THEN '2' ELSE '3' END || '}', ', ' ORDER BY turn) || ']}') AS key FROM conversations GROUP BY 1""")
def message_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    m = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("message"), role.alias("role")))).alias("messages"))
    return m.select("conv_id", X.message_key(F.lit("1.0:French"), F.col("messages"), 256).alias("key"))


@query(f"""SELECT conv_id, sum({TOKENS}) AS total_tokens, sum(CASE WHEN role <> 'assistant' THEN {TOKENS} ELSE 0 END) AS input_tokens,
    sum(CASE WHEN role = 'system' THEN {TOKENS} ELSE 0 END) AS cached_tokens, sum(CASE WHEN role = 'assistant' THEN {TOKENS} ELSE 0 END) AS output_tokens FROM conversations GROUP BY 1""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = read(spark, sf_dir, "conversations").withColumn("n", X.n_tokens(F.col("text"))).withColumns({
        "total_tokens": n, "input_tokens": F.when(F.col("role") != "assistant", n), "cached_tokens": F.when(F.col("role") == "system", n), "output_tokens": F.when(F.col("role") == "assistant", n),
    })
    return control.usage_totals(rows, ["conv_id"], ["total_tokens", "input_tokens", "cached_tokens", "output_tokens"])


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'toc' WHEN turn = 1 THEN 'metadata' ELSE 'chapter' END AS kind FROM conversations),
    p AS (SELECT *, CASE WHEN kind <> 'chapter' THEN 0.05 ELSE 0.9 / sum(CASE WHEN kind = 'chapter' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) END AS part FROM t)
    SELECT conv_id, turn, cast(round(1000 * sum(cast(part AS double)) OVER (PARTITION BY conv_id ORDER BY turn)) AS bigint) AS permille FROM p""")
def progress_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("turn") == 0, "toc").when(F.col("turn") == 1, "metadata").otherwise("chapter")
    p = control.progress(read(spark, sf_dir, "conversations").withColumn("kind", kind), ["conv_id"], "turn")
    return p.select("conv_id", "turn", F.round(F.col("progress") * 1000).cast("long").alias("permille"))


@query("SELECT conv_id, turn, 0.8 - 0.6 * power(0.5, turn) AS temperature FROM conversations".replace("0.8 - 0.6 *", "cast(0.8 AS double) - cast(0.6000000000000001 AS double) *"))
def sampling_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", X.sampling_value(0.2, 0.8, F.col("turn")).alias("temperature"))


@query("SELECT key, min(doc_id) AS doc_id FROM (SELECT doc_id, sha256(text) AS key FROM documents) WHERE key NOT IN (SELECT sha256(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY 1")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of labelled documents are known already."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    known = docs.join(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id")
    return control.cache_misses(docs.groupBy("key").agg(F.min("doc_id").alias("doc_id")), known, "key")


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '<br>', '<br/>', 'g'), '<(area|base|br|col|embed|hr|img|input|link|param|source|track|wbr)([^>A-Za-z0-9_:.-][^>]*?)??\s*/>', '<\1\2>', 'g')) AS digest FROM pages""")
def void_unclose(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.replace(F.col("html"), F.lit("<br>"), F.lit("<br/>"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(X.unclose_void(html)).alias("digest"))


@query("SELECT doc_id, md5(translate('«' || text || '‹x›〈y〉»', '‹›〈〉«»《》', '«»《》')) AS digest FROM documents")
def quote_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.unwrap_quotes(F.concat(F.lit("«"), "text", F.lit("‹x›〈y〉»")))).alias("digest"))


@query("""SELECT page_id, nullif(split_part(url, '#', 1), '') AS path, CASE WHEN strpos(url, '#') > 0 THEN nullif(substring(url, strpos(url, '#') + 1), '') END AS fragment FROM pages""")
def href_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, fragment = X.split_href(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"), fragment.alias("fragment"))


@query(f"""SELECT page_id, lower(tag) AS tag, lower(tag) IN ({", ".join(f"'{t}'" for t in X.INLINE_TAGS)}) AS inline, count(*) AS n
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1, 2, 3""")
def inline_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), 1)).alias("tag"))
    return tags.groupBy("page_id", F.lower("tag").alias("tag"), X.is_inline(F.col("tag")).alias("inline")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN length(text) > 30 THEN substring(text, 1, 30) || '...' ELSE text END AS preview FROM documents")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(r"""SELECT doc_id, CASE WHEN len(t) > 6 THEN trim(array_to_string(t[1:6], '')) || ' ...' ELSE trim(text) END AS hint FROM (SELECT doc_id, text, regexp_extract_all(trim(text), '<[^>]*>|[A-Za-z]+|[\s\S]') AS t FROM documents)""")
def text_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.token_hint(F.col("text")).alias("hint"))


@query(f"WITH {PLAIN} SELECT DISTINCT cast(doc_id // 25 AS varchar) AS book_id, CASE WHEN (doc_id // 25) % 4 < 2 THEN 3 ELSE 2 END AS version FROM plain")
def toc_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as the package files of archives state them."""
    return package.packages(standin.books(plain(spark, sf_dir))).select("book_id", "version")


@query("SELECT page_id, regexp_extract(html, '^((?s:.*?))<[A-Za-z]', 1) AS header FROM pages")
def page_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", X.header_of(F.col("html")).alias("header"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS play_order FROM conversations")
def play_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with an entry for each turn, all with one play order, read and written again."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    point = lambda t: F.concat(F.lit('<navPoint id="t'), t.cast("string"), F.lit('" playOrder="7"><navLabel><text>Turn</text></navLabel><content src="c.xhtml#t'), t.cast("string"), F.lit('"/></navPoint>'))
    ncx = F.concat(F.lit('<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>'), F.array_join(F.transform("turns", point), ""), F.lit("</navMap></ncx>"))
    rows = package.renumbered(turns.select(F.col("conv_id").cast("string").alias("book_id"), F.lit(2).alias("version"), F.encode(ncx, "utf-8").alias("content")))
    points = F.regexp_extract_all(F.decode("content", "utf-8"), F.lit("<navPoint [^>]*>"), 0)
    each = rows.select(F.col("book_id").cast("long").alias("conv_id"), F.explode(points).alias("p"))
    return each.select("conv_id", F.regexp_extract("p", ' id="t([0-9]+)"', 1).cast("long").alias("turn"), F.regexp_extract("p", 'playOrder="([0-9]+)"', 1).cast("long").alias("play_order"))


@query("""SELECT a.user_id, a.event_id AS lo, count(*) AS n FROM events a JOIN events e ON e.user_id = a.user_id AND e.event_id BETWEEN a.event_id AND a.event_id + 200 GROUP BY 1, 2""")
def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pre"))
    spans = e.select("user_id", F.col("pre").alias("lo"), (F.col("pre") + 200).alias("hi"))
    return reassembly.contained(e, spans, ["user_id"]).groupBy("user_id", "lo").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT retries, count(*) AS n, count(*) / (SELECT count(*) FROM events)::double AS share FROM (SELECT event_id % 6 AS retries, event_type <> 'error' AS success FROM events) WHERE success GROUP BY 1""")
def attempt_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.scorecard(read(spark, sf_dir, "events").select((F.col("event_id") % 6).alias("retries"), (F.col("event_type") != "error").alias("success")))


@query()
def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of pages as the tolerant parser closes them. No SQL: a tree parser."""
    return markup.elements(read(spark, sf_dir, "pages"), "page_id", "html")


@query()
def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text segments of pages with their ancestors. No SQL: a tree parser."""
    segments = markup.text_segments(read(spark, sf_dir, "pages"), "page_id", "html")
    return islands.common_depths(segments, ["page_id"], ["seg_no"], "stack").drop("stack")


@query()
def page_inline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline runs of pages: consecutive segments of one block. No SQL: a tree parser stands before it."""
    segments = markup.text_segments(read(spark, sf_dir, "pages"), "page_id", "html")
    rows = islands.runs(segments, ["page_id"], ["seg_no"], "block_node")
    return rows.groupBy("page_id", "run_id").agg(F.min("seg_no").alias("first_seg"), F.count(F.lit(1)).alias("n"), F.sum(X.n_tokens(F.col("text"))).alias("score"))


@query()
def page_strict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages are well-formed once void elements and entities are mended; an error column for the rest."""
    return markup.strict_parse(read(spark, sf_dir, "pages"), "page_id", "html")


@query()
def page_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model stage over page segments (upper case), put back into the pages in the append_block way."""
    return reassembly.translate_pages(read(spark, sf_dir, "pages"), "page_id", "html", str.upper, "append_block")


@query(f"""WITH RECURSIVE {SCORED}, nums AS (SELECT doc_id, line, score, row_number() OVER w AS k, sum(score) OVER w AS upto FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    fold AS (SELECT doc_id, k, score AS s, 0 AS group_no FROM nums WHERE k = 1
        UNION ALL SELECT n.doc_id, n.k, CASE WHEN f.s + n.score > 465 THEN n.score ELSE f.s + n.score END, CASE WHEN f.s + n.score > 465 THEN f.group_no + 1 ELSE f.group_no END
        FROM fold f JOIN nums n ON n.doc_id = f.doc_id AND n.k = f.k + 1),
    g AS (SELECT doc_id, group_no, min(k) AS lo, max(k) AS hi FROM fold GROUP BY 1, 2),
    c AS (SELECT g.*, a.upto - a.score AS before, b.upto AS upto FROM g JOIN nums a ON a.doc_id = g.doc_id AND a.k = g.lo JOIN nums b ON b.doc_id = g.doc_id AND b.k = g.hi),
    x AS (SELECT c.doc_id, c.group_no, c.lo, c.hi, cast(count(*) FILTER (n.k < c.lo AND c.before - (n.upto - n.score) <= 18) AS int) AS n_head, cast(count(*) FILTER (n.k > c.hi AND n.upto - c.upto <= 17) AS int) AS n_tail FROM c JOIN nums n ON n.doc_id = c.doc_id GROUP BY ALL)
    SELECT n.doc_id, n.line, x.group_no, x.n_head, x.n_tail FROM x JOIN nums n ON n.doc_id = x.doc_id AND n.k BETWEEN x.lo AND x.hi""")
def serial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of paragraphs with overlapping context: 500 tokens, of them 18 before and 17 after the body."""
    return serial.transform(scored(read(spark, sf_dir, "documents")), ["doc_id"], "line", "score", 500)


@query(f"""WITH RECURSIVE {SCORED}, nums AS (SELECT doc_id, line, score, row_number() OVER w AS k, sum(score) OVER w AS upto FROM scored WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    fold AS (SELECT doc_id, k, score AS s, 0 AS group_no FROM nums WHERE k = 1
        UNION ALL SELECT n.doc_id, n.k, CASE WHEN f.s + n.score > 465 THEN n.score ELSE f.s + n.score END, CASE WHEN f.s + n.score > 465 THEN f.group_no + 1 ELSE f.group_no END
        FROM fold f JOIN nums n ON n.doc_id = f.doc_id AND n.k = f.k + 1),
    g AS (SELECT doc_id, group_no, min(k) AS lo, max(k) AS hi FROM fold GROUP BY 1, 2),
    c AS (SELECT g.*, a.upto - a.score AS before, b.upto AS upto FROM g JOIN nums a ON a.doc_id = g.doc_id AND a.k = g.lo JOIN nums b ON b.doc_id = g.doc_id AND b.k = g.hi),
    x AS (SELECT c.doc_id, c.lo, c.hi, sum(n.score) AS total FROM c JOIN nums n ON n.doc_id = c.doc_id AND (n.k BETWEEN c.lo AND c.hi OR n.k < c.lo AND c.before - (n.upto - n.score) <= 18 OR n.k > c.hi AND n.upto - c.upto <= 17) GROUP BY ALL)
    SELECT n.doc_id, n.line, cast(n.score AS varchar) || '/' || cast(x.total AS varchar) AS share FROM x JOIN nums n ON n.doc_id = x.doc_id AND n.k BETWEEN x.lo AND x.hi""")
def serial_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of whole groups over paragraphs: each one's tokens, and those of its group with context."""
    rows = scored(read(spark, sf_dir, "documents")).withColumn("share", F.col("score").cast("string"))
    return serial.transformed(rows, ["doc_id"], "line", "score", "share", 500, lambda xs: [f"{x}/{sum(map(int, xs))}" for x in xs])


@query("SELECT conv_id, role, cast(row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS int) AS no, string_agg(cast(turn AS varchar), ',' ORDER BY turn) AS turns, count(DISTINCT length(text)) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) <= 1 AS same FROM conversations GROUP BY 1, 2")
def turns_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation by role, roles in the order in which they come first, and whether all are of one length."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("turn").cast("string").alias("said"), F.length("text").alias("size"))
    same = groups.all_same(turns, ["conv_id", "role"], "size")
    return groups.nested(turns, ["conv_id"], "turn", "role", "said").join(same, ["conv_id", "role"]).select("conv_id", "role", "no", F.array_join("values", ",").alias("turns"), "same")


@query()
def page_block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of the blocks of pages with their ids and scores. No SQL: a tree parser stands before it."""
    return templates.block_scores(read(spark, sf_dir, "pages"), "page_id", "html")


# -- whole books -----------------------------------------------------------------------------------

#: Blocks of the archives that standin.bound makes, with what their templates cost: a title for each book, then the lines of its
#: chapters; segments of chapters (all cuts cost the same, so the best split fills from the end), groups of segments that fit, and
#: what a group's request says: its body and the context on both sides, in part where the budget ends.
BLOCKS = f"""{PLAIN}, blocks AS (SELECT doc_id // 25 AS book, doc_id, line, text, '<p id="99" data-orig-len="9999">' || text || '</p>' AS shown FROM plain
        UNION ALL SELECT DISTINCT doc_id // 25, -1, 0, 'Volume ' || cast(doc_id // 25 AS varchar), '<field id="99" data-orig-len="9999">Volume ' || cast(doc_id // 25 AS varchar) || '</field>' FROM plain),
    scores AS (SELECT book, doc_id, line, text, 80 + {TOKENS.replace("text", "shown")} AS score, {TOKENS.replace("len(", "", 1)[:-1]} AS tokens FROM blocks),
    nums AS (SELECT *, row_number() OVER (PARTITION BY book, doc_id ORDER BY line DESC) AS k, sum(score) OVER (PARTITION BY book, doc_id ORDER BY line) AS upto, sum(score) OVER (PARTITION BY book, doc_id) AS total FROM scores),
    fold AS (SELECT book, doc_id, k, score AS s, 0 AS seg FROM nums WHERE k = 1
        UNION ALL SELECT n.book, n.doc_id, n.k, CASE WHEN f.s + n.score > 5580 THEN n.score ELSE f.s + n.score END, CASE WHEN f.s + n.score > 5580 THEN f.seg + 1 ELSE f.seg END
        FROM fold f JOIN nums n ON n.book = f.book AND n.doc_id = f.doc_id AND n.k = f.k + 1),
    segs AS (SELECT book, doc_id, seg, sum(score) AS body, min(upto - score) AS before, max(upto) AS upto, least(min(upto - score), 210) AS head, least(max(total) - max(upto), 210) AS tail,
        row_number() OVER (PARTITION BY book ORDER BY doc_id, seg DESC) AS k FROM nums JOIN fold USING (book, doc_id, k) GROUP BY 1, 2, 3),
    folded AS (SELECT book, k, head + body AS s, 0 AS group_no FROM segs WHERE k = 1
        UNION ALL SELECT n.book, n.k, CASE WHEN f.s + n.body + n.tail > 6000 THEN n.head + n.body ELSE f.s + n.body END, CASE WHEN f.s + n.body + n.tail > 6000 THEN f.group_no + 1 ELSE f.group_no END
        FROM folded f JOIN segs n ON n.book = f.book AND n.k = f.k + 1),
    g AS (SELECT book, group_no, arg_min(doc_id, k) AS doc_a, min_by(before, k) AS before, arg_max(doc_id, k) AS doc_b, max_by(upto, k) AS upto FROM folded JOIN segs USING (book, k) GROUP BY 1, 2),
    near AS (SELECT g.book, group_no, n.doc_id, line, text, tokens, score, -1 AS side, least(score, 210 - (before - n.upto)) AS kept FROM g JOIN nums n ON n.book = g.book AND n.doc_id = doc_a AND n.upto <= before AND before - n.upto < 210
        UNION ALL SELECT g.book, group_no, n.doc_id, line, text, tokens, score, 1, least(score, 210 - (n.upto - score - g.upto)) FROM g JOIN nums n ON n.book = g.book AND n.doc_id = doc_b AND n.upto - score >= g.upto AND n.upto - score - g.upto < 210),
    cut AS (SELECT *, kept - (score - len(tokens)) AS n FROM near),
    context AS (SELECT book, group_no, doc_id, line, CASE WHEN kept = score THEN text WHEN n <= 0 THEN '' WHEN side < 0 THEN trim(array_to_string(tokens[len(tokens) - n + 1 :], '')) ELSE trim(array_to_string(tokens[1 : n], '')) END AS said, kept < score AS part, side FROM cut),
    parts AS (SELECT f.book, group_no, n.doc_id, line, text AS said FROM folded f JOIN segs s USING (book, k) JOIN fold l ON l.book = s.book AND l.doc_id = s.doc_id AND l.seg = s.seg JOIN nums n ON n.book = l.book AND n.doc_id = l.doc_id AND n.k = l.k
        UNION ALL SELECT book, group_no, doc_id, line, CASE WHEN NOT part THEN said WHEN side < 0 THEN '... ' || said ELSE said || ' ...' END FROM context WHERE said <> ''),
    sized AS (SELECT book, group_no, cast(count(*) AS int) AS n_blocks, string_agg(said, chr(10) || chr(10) ORDER BY doc_id, line) AS source FROM parts GROUP BY 1, 2)"""
UPPERED = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def translation(spark: SparkSession, sf_dir: str) -> translate.Translation:
    """Documents bound as books, translated by a model that fails as planned, in groups of 6,000 tokens."""
    return translate.Translation(standin.books(plain(spark, sf_dir)), standin.MODEL, translate.Settings(budget=6000))


@query(f"""WITH RECURSIVE {BLOCKS}, tries AS (SELECT *, unnest(range(0, n_blocks % 3 + 1)) AS attempt FROM sized)
    SELECT cast(book AS varchar) AS book_id, group_no, n_blocks, cast(attempt AS int) AS attempt, cast(CASE WHEN attempt = n_blocks % 3 THEN 0 WHEN attempt = 0 THEN 729 ELSE 243 END AS bigint) AS weight,
        cast(CASE WHEN attempt = n_blocks % 3 THEN 0 ELSE 1 END AS int) AS n_errors FROM tries""")
def book_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts that each group of a book took: packing, templates, fill loop, checks."""
    return translation(spark, sf_dir).attempts().select("book_id", "group_no", "n_blocks", "attempt", "weight", "n_errors")


@query(f"""WITH RECURSIVE {BLOCKS} SELECT cast(book AS varchar) AS book_id, group_no, cast(attempt + 1 AS int) AS retried_count, false AS over_maximum_retries, CASE attempt WHEN 0 THEN 'Missing block' ELSE 'Wrong tag' END AS what
    FROM (SELECT *, unnest(range(0, n_blocks % 3)) AS attempt FROM sized)""")
def book_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of attempts that failed, by the first words of what was told."""
    what = F.regexp_extract("error_message", "(Missing block|Wrong tag)", 1)
    return translation(spark, sf_dir).failures().select("book_id", "group_no", "retried_count", "over_maximum_retries", what.alias("what"))


@query(f"""WITH {PLAIN} SELECT cast(doc_id // 25 AS varchar) AS book_id, 'OPS/c' || cast(doc_id AS varchar) || '.xhtml' AS path, 2 * count(*) AS n_paragraphs, md5(string_agg(text || '|' || {UPPERED}, '|' ORDER BY line)) AS digest FROM plain GROUP BY doc_id
    UNION ALL SELECT DISTINCT cast(doc_id // 25 AS varchar), 'OPS/book.opf', 1, md5('Volume ' || cast(doc_id // 25 AS varchar) || ' VOLUME ' || cast(doc_id // 25 AS varchar)) FROM plain
    UNION ALL SELECT DISTINCT cast(doc_id // 25 AS varchar), 'OPS/cover.png', 0, md5('picture ' || cast(doc_id // 25 AS varchar)) FROM plain""")
def book_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the translated books: paragraphs of chapters with their translations, the title, a picture as it was."""
    rows = translation(spark, sf_dir).result().where("path not in ('mimetype', 'META-INF/container.xml')").withColumn("content", F.decode("content", "utf-8"))
    title = F.regexp_extract("content", "<dc:title>(.*?)</dc:title>", 1)
    parts = F.regexp_extract_all("content", F.lit("(?s)<p[^>]*>(.*?)</p>"), 1)
    said = F.when(F.col("path") == "OPS/book.opf", title).when(F.col("path") == "OPS/cover.png", F.col("content")).otherwise(F.array_join(parts, "|"))
    n = F.when(F.col("path") == "OPS/book.opf", 1).when(F.col("path") == "OPS/cover.png", 0).otherwise(F.size(parts))
    return rows.select("book_id", "path", n.cast("long").alias("n_paragraphs"), F.md5(said).alias("digest"))


@query(f"""WITH {PLAIN}, m AS (SELECT doc_id, line, regexp_replace({UPPERED}, '^ ?([^ ]+) (.+) ([^ ]+) ?$', '<b class="a">\\1</b> \\2 <b class="z">\\3</b>') AS text FROM plain)
    SELECT cast(doc_id // 25 AS varchar) AS book_id, 'OPS/c' || cast(doc_id AS varchar) || '.xhtml' AS path, count(*) AS n_paragraphs,
        md5(string_agg(regexp_replace('<p id="n' || cast(line AS varchar) || '">' || text || ' <math display="inline"><mi>u</mi></math></p>', '\\s*(<[^>]*>)\\s*', '\\1', 'g'), '|' ORDER BY line)) AS digest FROM m GROUP BY doc_id""")
def book_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters replaced: inline elements with ids keep their attributes, formulas their places, paragraphs their ids."""
    members = standin.books(plain(spark, sf_dir), block=standin.rich_block)
    rows = translate.Translation(members, standin.MODEL, translate.Settings(budget=6000, action="replace")).result().where("path like '%.xhtml'")
    close = F.regexp_replace(F.decode("content", "utf-8"), r"\s*(<[^>]*>)\s*", "$1")  # a template is laid out, so white space beside tags may be new
    parts = F.regexp_extract_all(close, F.lit("(?s)<p[^>]*>.*?</p>"), 0)
    return rows.select("book_id", "path", F.size(parts).cast("long").alias("n_paragraphs"), F.md5(F.array_join(parts, "|")).alias("digest"))


@query(f"""WITH {PLAIN}, t AS (SELECT DISTINCT doc_id // 25 AS book, doc_id FROM plain), u AS (SELECT book, doc_id, row_number() OVER (PARTITION BY book ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY book) AS n FROM t)
    SELECT cast(book AS varchar) AS book_id, cast(k + 1 AS int) AS task_no, cast(round(1000 * (0.05 + 0.95 * k / n)) AS bigint) AS permille FROM u UNION ALL SELECT DISTINCT cast(book AS varchar), 1, 50 FROM u""")
def book_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of work done with each task of a book."""
    return translation(spark, sf_dir).progress().select("book_id", "task_no", F.round(F.col("progress") * 1000).cast("long").alias("permille"))


@query(f"""WITH RECURSIVE {BLOCKS} SELECT cast(book AS varchar) AS book_id, group_no, n_blocks, length(source) AS n_chars, md5(source) AS digest FROM sized""")
def book_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request of a book says: chapters cut at their borders, short ones together, context cut to its budget."""
    return translation(spark, sf_dir).requests.select("book_id", "group_no", F.size("blocks").alias("n_blocks"), F.length("source").cast("long").alias("n_chars"), F.md5("source").alias("digest"))


@query(f"""WITH {PLAIN} SELECT cast(doc_id // 25 AS varchar) AS book_id, cast(1 + dense_rank() OVER (PARTITION BY doc_id // 25 ORDER BY doc_id) AS int) AS task_no, cast(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS int) AS block_no,
    (doc_id // 25) % 2 = 0 AS answered FROM plain UNION ALL SELECT DISTINCT cast(doc_id // 25 AS varchar), 1, 0, (doc_id // 25) % 2 = 0 FROM plain""")
def book_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block of every book in its place; a hook takes the answers of odd books away, whose blocks are null then."""
    keep_even = translate.Hooks(filled=lambda f: f.withColumn("best", F.when(F.col("book_id").cast("long") % 2 == 0, F.col("best")).otherwise(F.slice("best", 1, 0))))
    t = translate.Translation(standin.books(plain(spark, sf_dir)), standin.MODEL, translate.Settings(budget=6000), hooks=keep_even)
    return t.mappings().select("book_id", "task_no", "block_no", F.col("answer").isNotNull().alias("answered"))


@query(f"""WITH RECURSIVE {BLOCKS}, asked AS (SELECT DISTINCT source FROM sized)
    SELECT 'translate' AS kind, count(*) AS requests, cast(sum(length(source)) AS bigint) AS input, cast(sum(length(source)) AS bigint) AS output, cast(sum(2 * length(source)) AS bigint) AS total FROM asked
    UNION ALL SELECT 'fill', cast(sum(n_blocks % 3 + 1) AS bigint), 0, 0, cast(sum(n_blocks * (n_blocks % 3 + 1)) AS bigint) FROM sized""")
def book_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made and tokens counted for all books: each request once, however many tables are made of the run."""
    t = translation(spark, sf_dir)
    return t.usage().select("kind", "requests", "input", "output", "total")


@query("""SELECT conv_id, turn, cast(ceil(length(text) / 16.0) AS int) AS n_chunks, true AS complete, length(text) AS input, 2 * length(text) AS output, md5(text) AS digest FROM conversations WHERE length(text) > 0""")
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers in chunks of 16 characters that come out of order and some of them twice, put together in a stream."""
    turns = read(spark, sf_dir, "conversations").where("length(text) > 0")
    request = F.concat_ws(":", "conv_id", "turn")
    chunks = turns.select(request.alias("request"), "text", F.explode(F.expr("sequence(0, cast(ceil(length(text) / 16.0) as int) - 1)")).alias("no"))
    chunks = chunks.select("request", "no", F.expr("substr(text, 16 * no + 1, 16)").alias("text"), F.expr("16 * (no + 1) >= length(text)").alias("last"), F.expr("timestamp_seconds(1700000000 + no)").alias("ts"),
        F.length("text").cast("long").alias("input"), (2 * F.length("text")).cast("long").alias("output"), F.expr("explode(if(no % 3 = 1, array(0, 1), array(0)))").alias("again"))
    run = runs.Run(spark)
    chunks.repartition(8, F.xxhash64("request", "no", "again") % 8).drop("again").write.parquet(f"{run.folder}/chunks")
    feed = spark.readStream.schema(spark.read.parquet(f"{run.folder}/chunks").schema).option("maxFilesPerTrigger", 3).parquet(f"{run.folder}/chunks")
    sink = answers.answers(feed).writeStream.format("parquet").option("path", f"{run.folder}/answers").option("checkpointLocation", f"{run.folder}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(answers.ANSWER).parquet(f"{run.folder}/answers")
    part = lambda i: F.split("request", ":")[i].cast("long")
    return done.select(part(0).alias("conv_id"), part(1).alias("turn"), "n_chunks", "complete", "input", "output", F.md5("answer").alias("digest"))


# -- markup that SQL can read ----------------------------------------------------------------------


def marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, html: lines as paragraphs with their first word in bold, a rule after each and the last paragraph left open."""
    one = lambda x: F.concat(F.lit("<p><b>"), F.regexp_replace(F.trim(x["text"]), "^[^ ]*", "$0</b>"))
    lines = plain(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("lines"))).alias("l"))
    return lines.select("doc_id", F.concat(F.lit("<body>"), F.array_join(F.transform("l", one), "</p><hr>"), F.lit("</body>")).alias("html"))


#: Paragraphs of marked_up: number from 0, how many there are, first word, what follows it.
MARKED = f"""{PLAIN}, marked AS (SELECT doc_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, split_part(trim(text), ' ', 1) AS word, substring(trim(text), length(split_part(trim(text), ' ', 1)) + 1) AS rest FROM plain WINDOW w AS (PARTITION BY doc_id ORDER BY line))"""
#: Their segments. Node numbers in preorder: the root 0, body 1, then paragraph, bold and rule of each.
PIECES = f"""{MARKED}, pieces AS (SELECT doc_id, i, 0 AS part, word AS text, [1, 3 * i + 2, 3 * i + 3] AS stack FROM marked UNION ALL SELECT doc_id, i, 1, rest, [1, 3 * i + 2] FROM marked WHERE trim(rest) <> ''),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1 AS seg FROM pieces)"""


@query(f"""WITH {MARKED} SELECT doc_id, tag, count(*) AS n, sum(chars) AS n_chars FROM (SELECT doc_id, 'b' AS tag, length(word) AS chars FROM marked UNION ALL SELECT doc_id, 'p', length(word) + length(rest) FROM marked WHERE i < n - 1
    UNION ALL SELECT doc_id, 'body', sum(length(word) + length(rest)) FROM marked GROUP BY 1) GROUP BY 1, 2""")
def marked_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that close, by tag: an open paragraph or a void element never does."""
    rows = markup.elements(marked_up(spark, sf_dir), "doc_id", "html")
    return rows.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query(f"""WITH {PIECES}, s AS (SELECT *, lag(stack) OVER w AS p, lead(stack) OVER w AS q FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY seg))
    SELECT doc_id, cast(seg AS int) AS seg_no, md5(text) AS digest, cast(len(stack) AS int) AS depth, cast(2 AS int) AS block_depth, 'p' AS block_tag, CASE part WHEN 0 THEN 'text' ELSE 'tail' END AS position,
        cast(CASE WHEN p IS NULL THEN 0 WHEN p[2] = stack[2] THEN 2 ELSE 1 END AS int) AS left_common, cast(CASE WHEN q IS NULL THEN 0 WHEN q[2] = stack[2] THEN 2 ELSE 1 END AS int) AS right_common FROM s""")
def marked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text segments with the ancestors they share with their neighbours."""
    rows = islands.common_depths(markup.text_segments(marked_up(spark, sf_dir), "doc_id", "html"), ["doc_id"], ["seg_no"], "stack")
    return rows.select("doc_id", "seg_no", F.md5("text").alias("digest"), F.size("stack").alias("depth"), "block_depth", "block_tag", "position", "left_common", "right_common")


@query(f"""WITH {PIECES} SELECT doc_id, cast(i + 1 AS bigint) AS run_id, cast(min(seg) AS int) AS first_seg, count(*) AS n, sum({TOKENS}) AS score FROM numbered GROUP BY 1, 2""")
def marked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline runs: consecutive segments of one block."""
    rows = islands.runs(markup.text_segments(marked_up(spark, sf_dir), "doc_id", "html"), ["doc_id"], ["seg_no"], "block_node")
    return rows.groupBy("doc_id", "run_id").agg(F.min("seg_no").alias("first_seg"), F.count(F.lit(1)).alias("n"), F.sum(X.n_tokens(F.col("text"))).alias("score"))


@query(f"""WITH {MARKED} SELECT doc_id, n % 2 = 0 AS well_formed, cast(CASE WHEN n % 2 = 0 THEN 3 * n + 1 END AS int) AS n_nodes FROM marked WHERE i = 0""")
def marked_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are well-formed: void elements are closed, but a paragraph that stays open isn't; of an even number of paragraphs the last is closed here."""
    pages = marked_up(spark, sf_dir)
    even = F.regexp_count("html", F.lit("<p>")) % 2 == 0
    return markup.strict_parse(pages.withColumn("html", F.when(even, F.replace("html", F.lit("</body>"), F.lit("</p><hr></body>"))).otherwise(F.col("html"))), "doc_id", "html").select("doc_id", "well_formed", "n_nodes")


@query(f"""WITH {MARKED} SELECT doc_id, cast(i AS int) AS block_no, 'p' AS tag, 1 AS n_ids, cast(80 + 4 + len(regexp_extract_all(word, '<[^>]*>|[A-Za-z]+|[\\s\\S]')) + len(regexp_extract_all(rest, '<[^>]*>|[A-Za-z]+|[\\s\\S]')) AS bigint) AS score FROM marked""")
def marked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates of blocks with their ids and scores."""
    return templates.block_scores(marked_up(spark, sf_dir), "doc_id", "html")


@query(f"""WITH {MARKED}, b AS (SELECT doc_id, i, word || rest AS text FROM marked) SELECT doc_id, cast(count(*) AS int) AS n_blocks, md5(string_agg(text || '|' || {UPPERED}, '|' ORDER BY i)) AS digest FROM b GROUP BY 1""")
def marked_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their upper case after them: documents parsed, mapped, put together, and read again."""
    done = runs.Run(spark).keep(reassembly.translate_pages(marked_up(spark, sf_dir), "doc_id", "html", standin.upper, "append_block"), "done")  # used twice
    again = markup.text_segments(done, "doc_id", "markup").groupBy("doc_id", "block_node").agg(F.array_sort(F.collect_list(F.struct("seg_no", "text"))).alias("s"))
    texts = again.select("doc_id", F.array_min(F.transform("s", lambda x: x["seg_no"])).alias("at"), F.trim(F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("text"))
    texts = texts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "|").alias("t"))
    return done.join(texts, "doc_id").select("doc_id", "n_blocks", F.md5("t").alias("digest"))
