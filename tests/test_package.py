import io
import re
import zipfile

from quire.operators.translate import Model, Settings, Translation, translate_books
from quire.plans import standin
from quire.sources import package
from quire.sources.markup import closed_elements, encode
from quire.sources.package import Toc

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf" version="2.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>A Book</dc:title><dc:creator>One</dc:creator><dc:creator>Two</dc:creator><dc:language>en</dc:language></metadata>
<manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="css" href="s.css" media-type="text/css"/></manifest><spine toc="ncx"><itemref idref="c1"/><itemref idref="css"/><itemref idref="none"/></spine></package>"""
NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint id="n1" playOrder="7"><navLabel><text>Chapter I</text></navLabel><content src="c1.xhtml"/><navPoint><navLabel><text>Part</text></navLabel><content src="c1.xhtml#x"/></navPoint></navPoint><navPoint><navLabel><text> </text></navLabel></navPoint></navMap></ncx>'
CHAPTER = '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title></head><body><p id="p">Hello <b>you</b></p></body></html>'
NAV = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li id="a"><a href="x.html">One</a><ol><li><span>Deep</span></li></ol></li><li><a id="b" href="y.html#f">Two</a></li></ol></nav></body></html>'


def book() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (("META-INF/container.xml", CONTAINER), ("mimetype", "application/epub+zip"), ("OPS/book.opf", OPF), ("OPS/toc.ncx", NCX), ("OPS/c1.xhtml", CHAPTER), ("OPS/s.css", "p{}")):
            z.writestr(name, text, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def test_tables_of_a_book(spark):
    rows = package.unzipped(spark.createDataFrame([("b", bytearray(book()))], "book_id string, content binary"))
    assert rows.count() == 6
    p = package.packages(rows).cache()
    assert [tuple(r) for r in package.chapters(p).collect()] == [("b", 0, "OPS/c1.xhtml")]
    assert [tuple(r) for r in package.toc_path(p).collect()] == [("b", 2, "OPS/toc.ncx")]
    fields = p.selectExpr("book_id", "inline(metadata)")
    assert [(r.tag_name, r.text) for r in package.translatable(fields).collect()] == [("title", "A Book"), ("creator", "One"), ("creator", "Two")]


def test_books_translated_and_written(spark):
    rows = package.unzipped(spark.createDataFrame([("b", bytearray(book())), ("bad", bytearray(book()))], "book_id string, content binary"))
    done = package.zipped(translate_books(rows, standin.MODEL, "append_block")).where("book_id = 'b'").first()["content"]
    with zipfile.ZipFile(io.BytesIO(bytes(done))) as z:
        assert z.namelist()[0] == "mimetype" and len(z.namelist()) == 6
        assert z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED
        chapter = z.read("OPS/c1.xhtml").decode()
        assert '<p id="p">Hello <b>you</b></p><p id="p__translated">HELLO <b>YOU</b></p>' in chapter
        toc = package.read_toc(z.read("OPS/toc.ncx"), 2)
        assert [t.title for t in toc] == ["Chapter I CHAPTER I"] and toc[0].children[0].fragment == "x"
        assert 'playOrder="1"' in z.read("OPS/toc.ncx").decode()
        assert "A Book A BOOK" in z.read("OPS/book.opf").decode() and ">en<" in z.read("OPS/book.opf").decode()


def test_replaced_members(spark):
    rows = package.unzipped(spark.createDataFrame([("b", bytearray(book()))], "book_id string, content binary"))
    new = spark.createDataFrame([("b", "OPS/s.css", bytearray(b"new"))], "book_id string, path string, content binary")
    got = {r.path: bytes(r.content) for r in package.with_replaced(rows, new).collect()}
    assert got["OPS/s.css"] == b"new" and len(got) == 6


def test_nav_contents():
    toc = package.read_toc(NAV.encode(), 3)
    assert [(t.title, t.id, t.full_href) for t in toc] == [("One", "a", "x.html"), ("Two", "b", "y.html#f")]
    assert [t.title for t in toc[0].children] == ["Deep"]
    toc[0].title, toc[1].href, toc[1].fragment = "Eins", None, None
    again = package.read_toc(package.write_toc(NAV.encode(), 3, [toc[1], toc[0], Toc("Neu", "z.html")]), 3)
    assert [(t.title, t.full_href) for t in again] == [("Two", None), ("Eins", "x.html"), ("Neu", "z.html")]


def test_matching_and_transcoding():
    old = [Toc("a", "x", None, "1"), Toc("b", "y", None, None), Toc("c")]
    assert package.match_toc(old, [Toc("n", "y"), Toc("m", "q", None, "1"), Toc("z"), Toc("w")]) == [1, 0, 2, None]
    toc = [Toc("T & <x>", "h", "f", "i", [Toc("sub")])]
    assert package.decode_toc(package.encode_toc(toc)) == toc
    fields = [("title", "line\ntwo"), ("creator", "A & B"), ("creator", "C")]
    assert package.decode_metadata(package.encode_metadata(fields)) == fields
    assert [r[:4] for r in package.flat_toc(toc)] == [(0, None, 0, "T & <x>"), (1, 0, 1, "sub")]


RICH = '''<html xmlns="http://www.w3.org/1999/xhtml"><body><h1 id="t">A <em>new</em> tale</h1><p id="p">Let <math display="inline"><mi>u</mi><mo>→</mo><mi>v</mi></math> be <b class="x">one</b> and <b>two</b>.</p>
<math display="block"><mi>w</mi></math><ul><li>x<br/>y</li><li><img src="i.png"/>z</li></ul></body></html>'''


def rich_book(spark, chapters):
    files = {"META-INF/container.xml": CONTAINER, "mimetype": "application/epub+zip", "OPS/book.opf": OPF, "OPS/toc.ncx": NCX, "OPS/s.css": "p{}", **chapters}
    rows = [("b", i, path, 0, bytearray(text.encode())) for i, (path, text) in enumerate(files.items())]
    return spark.createDataFrame(rows, package.MEMBERS)


def test_chapters_keep_their_markup(spark):
    done = Translation(rich_book(spark, {"OPS/c1.xhtml": RICH}), standin.MODEL, Settings(budget=3000, action="replace"))
    got = {r.path: bytes(r.content).decode() for r in done.result().collect()}
    chapter = got["OPS/c1.xhtml"]
    assert '<h1 id="t">A <em>NEW</em> TALE</h1>' in chapter
    close = re.sub(r"\s*(<[^>]*>)\s*", r"\1", chapter)  # a template is laid out, so white space beside tags may be new
    assert '<p id="p">LET<math display="inline"><mi>u</mi><mo>→</mo><mi>v</mi></math>BE<b class="x">ONE</b>AND<b>TWO</b>.</p>' in close
    assert '<math display="block"><mi>w</mi></math>' in chapter and "<li>XY</li><li>Z</li>" in close
    assert "CHAPTER I" in got["OPS/toc.ncx"] and "<dc:title>A BOOK</dc:title>" in got["OPS/book.opf"] and got["OPS/s.css"] == "p{}"


def test_requests_are_remembered(spark):
    members = rich_book(spark, {"OPS/c1.xhtml": RICH})
    first = Translation(members, standin.MODEL, Settings(budget=400))
    known = first.remembered.collect()
    assert len(known) == first.filled.count() > 1
    memo = spark.createDataFrame(known, "key string, answer string")

    def never(messages):
        raise AssertionError("asked again")

    again = Translation(members, Model(never, standin.fill, retries=0), Settings(budget=400), memo)
    assert again.remembered.count() == 0
    assert sorted(map(tuple, again.result().select("path", "content").collect())) == sorted(map(tuple, first.result().select("path", "content").collect()))
    other = Translation(members, standin.MODEL, Settings(budget=400, target_language="Finnish"), memo)
    assert other.remembered.count() == len(known)


def test_blocks_that_no_attempt_fills_stay_as_they_were(spark):
    def fill(messages):
        return "no block at all"

    done = Translation(rich_book(spark, {"OPS/c1.xhtml": CHAPTER}), Model(standin.translate, fill, retries=0), Settings(attempts=3))
    events = sorted((r.retried_count, r.over_maximum_retries, r.error_message[:11]) for r in done.failures().collect())
    assert events == [(1, False, "No complete"), (2, False, "No complete"), (3, False, "No complete"), (3, True, "No complete")]
    assert {r.path: bytes(r.content) for r in done.result().collect()} == {r.path: bytes(r.content) for r in done.members.collect()}
    assert [(r.task_no, round(r.progress, 2)) for r in done.progress().orderBy("task_no").collect()] == [(0, 0.05), (1, 0.1), (2, 1.0)]


def test_best_attempts_are_kept_by_block(spark):
    def fill(messages):
        raw = messages[1][1].split("```XML\n", 1)[1].split("\n```\n", 1)[0]
        root = next(closed_elements(raw, ("xml",)))
        for n in root.children:
            n.text, n.children = n.text.strip().upper() + str(len(messages)), []
        # The first try has the first block only, later ones all but the first.
        root.children = root.children[:1] if len(messages) == 2 else root.children[1:]
        return encode(root)

    chapter = '<html xmlns="http://www.w3.org/1999/xhtml"><body><p>a</p><p>b</p><p>c</p></body></html>'
    done = Translation(rich_book(spark, {"OPS/c1.xhtml": chapter}), Model(standin.translate, fill, retries=0), Settings(attempts=2, action="replace"))
    got = {r.path: bytes(r.content).decode() for r in done.result().collect()}
    assert "<p>A4</p><p>B4</p><p>C4</p>" in got["OPS/c1.xhtml"] and "Chapter" not in got["OPS/toc.ncx"]
    assert [(r.attempt, r.n_errors) for r in done.attempts().orderBy("attempt").collect()] == [(0, 1), (1, 1)]


def test_saved_archives(spark, tmp_path):
    whole = package.zipped(rich_book(spark, {"OPS/c1.xhtml": RICH}))
    assert [tuple(r) for r in package.saved(whole, str(tmp_path)).collect()] == [("b", f"{tmp_path}/b.epub")]
    assert [x.name for x in tmp_path.iterdir()] == ["b.epub"]
    again = package.members(spark, f"{tmp_path}/*.epub")
    assert again.count() == 6 and package.listed(again, "OPS/").count() == 4


def test_contents_are_renumbered(spark):
    rows = spark.createDataFrame([("b", 2, bytearray(NCX.encode()))], "book_id string, version int, content binary")
    raw = bytes(package.renumbered(rows).first().content).decode()
    assert [raw.count(f'playOrder="{i}"') for i in (1, 2, 7)] == [1, 1, 0]


def test_members_are_evaluated_once_and_short_blocks_keep_their_edges(spark, tmp_path):
    from pyspark.sql import functions as F

    from quire.operators.translate import Translation
    from quire.plans import standin

    lines = spark.createDataFrame([(1, 0, " a short line "), (1, 1, "x"), (1, 2, " a line that is surely longer than thirty-five characters ")], "doc_id long, line int, text string")
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    members = standin.bound(lines)
    t = Translation(members.mapInPandas(counted, members.schema), standin.MODEL)
    page = t.result().where("path = 'OPS/c1.xhtml'").select(F.decode("content", "utf-8").alias("t")).first().t
    t.attempts().collect()
    assert seen.value == 5  # four members of the book and a chapter, each read once for all stages
    assert "<p> A SHORT LINE </p>" in page and "<p>X</p>" in page and "<p> A LINE THAT IS SURELY LONGER THAN THIRTY-FIVE CHARACTERS </p>" in page


def test_names_of_archives_need_no_content(spark):
    """a list of names inflated every member."""
    rows = rich_book(spark, {"OPS/c1.xhtml": RICH, "OPS/c2.xhtml": CHAPTER})
    archives = package.zipped(rows)
    raw = {r.book_id: bytes(r.content) for r in archives.collect()}
    assert sorted((r.book_id, r.entry_no, r.path) for r in package.names(archives).collect()) == sorted((r.book_id, r.entry_no, r.path) for r in package.unzipped(archives).collect())
    with zipfile.ZipFile(io.BytesIO(raw["b"])) as z:
        assert z.namelist()[0] == "mimetype" and z.testzip() is None and len(z.namelist()) == rows.where("book_id = 'b'").count()
        first = min(e.header_offset + 30 + len(e.filename) for e in z.infolist() if e.filename.startswith("OPS/c1"))
    broken = raw["b"][:first] + bytes(40) + raw["b"][first + 40 :]
    got = package.names(spark.createDataFrame([("b", broken)], "book_id string, content binary"), "OPS/c")
    assert sorted(r.path for r in got.collect()) == ["OPS/c1.xhtml", "OPS/c2.xhtml"]


def test_documents_as_books_are_the_same_by_lines_and_by_arrays(spark):
    """F16: package files made every line anew. A doc_id may have several rows."""
    from pyspark.sql import functions as F

    from quire.plans import standin

    docs = spark.createDataFrame([(1, [(0, "a"), (2, "b")]), (30, [(1, "c")]), (1, [(1, "x")])], "doc_id long, lines array<struct<line: int, text: string>>")
    shown = lambda df: sorted((r.book_id, r.entry_no, r.path, bytes(r.content)) for r in df.collect())
    assert shown(standin.books(docs)) == shown(standin.bound(docs.select("doc_id", F.inline("lines")))) and len(shown(standin.books(docs))) == 10
    # Lines that can't be made don't matter where only ids are asked for.
    bad = docs.withColumn("lines", F.when(F.col("doc_id") > 0, F.raise_error("made")).otherwise(F.col("lines")))
    assert {r.book_id for r in package.packages(standin.books(bad)).collect()} == {"0", "1"}


def test_progress_needs_no_chapters(spark):
    """all members were made and written before the first task was known."""
    from pyspark.sql import functions as F

    from quire.operators.translate import Translation

    rows = rich_book(spark, {"OPS/c1.xhtml": RICH})
    want = sorted(map(tuple, Translation(rows, standin.MODEL).progress().collect()))
    lazy = rows.withColumn("content", F.when(F.col("path").endswith(".xhtml"), F.raise_error("made").cast("binary")).otherwise(F.col("content")))
    assert sorted(map(tuple, Translation(lazy, standin.MODEL).progress().collect())) == want and want
