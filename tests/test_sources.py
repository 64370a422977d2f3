import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexigrid.operators.corpus import tokenize
from lexigrid.sources import files
from lexigrid.streaming.ingest import ingest, latest


def test_decode(spark):
    cases = [
        (b"plain", "plain"), (b"\xef\xbb\xbfmarked", "marked"), ("﻿wide".encode("utf-16-le"), "wide"), ("﻿wide".encode("utf-16-be"), "wide"),
        (b"\x93caf\xe9\x94\x81", "“café”\x81"), (b"\xff\xfe\x00\x00a", None), (b"\xff\xfea", None), (b"\xef\xbb\xbf\xff", None), (b"", ""),
    ]
    df = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(cases)], "i int, b binary")
    assert [r.t for r in df.select("i", files.decode(F.col("b")).alias("t")).orderBy("i").collect()] == [t for _, t in cases]


def test_html():
    text, title = files.html_text("<html><head><title>T</title></head><body><nav>no</nav><h1>Head</h1><p>One<br>two &amp; <b>three</b></p><p aria-hidden=true>gone</p><img alt='pic'><script>var t='</p>'</script></body></html>")
    assert title == "Head" and text == "Head\n\nOne\ntwo & three\n\npic"


@pytest.mark.parametrize(("page", "want"), [
    ("<html><head><title>T</title><body><p>Hello</p></body></html>", ("Hello", "T")), ("<head><title>Q</title><p>x", ("x", "Q")), ("<title>T</title><p>a<p>b<script>x</script>c", ("a\n\nbc", "T")),
    ("<ul><li>a<li>b</ul>t<table><caption>C</caption><tr><td>1<td>2<tr><td>3</table>", ("a\n\nb\n\nt\n\nC\n\n12\n\n3", None)), ("<nav>n<b>x</nav>y</nav>z", ("yz", None)), ("<p role=doc-noteref>keep</p>", ("keep", None)),
    ("<noscript>q</noscript></style>r", ("r", None)), ("<div aria-hidden=true>x<div>y</div>z</div>w", ("w", None)), ("<template><p>x</p></template>k", ("k", None)), ("<form>a<p>b</p></form>", ("a\n\nb", None)), ("", ("", None)), ("</p>x", ("x", None)),
])
def test_html_of_optional_and_stray_tags(page, want):
    assert files.html_text(page) == want


def test_xhtml_hides_references():
    page = '<html><body><h1>A</h1><p>b<a epub:type="noteref" href="#n">1</a><a role="doc-noteref">2</a> c</p></body></html>'
    assert files.html_text(page, strict=True)[0] == "A\n\nb c" and files.html_text(page)[0] == "A\n\nb12 c"


def test_package_titles_and_word_count():
    xml = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" unique-identifier="u"><metadata><dc:identifier id="u">i</dc:identifier><dc:title id="a">Main</dc:title><dc:title id="b">Sub</dc:title>{0}
    <meta property="title-type" refines="#a">main</meta><meta property="title-type" refines="#b">subtitle</meta><meta property="schema:wordCount">1200</meta></metadata></package>"""
    full = '<dc:title id="c">Main, the Whole</dc:title><meta property="title-type" refines="#c">expanded</meta>'
    a, b = files.parse_package(xml.format("").encode()), files.parse_package(xml.format(full).encode())
    assert (a["title"], a["subtitle"], a["full_title"], a["word_count"]) == ("Main", "Sub", "Main: Sub", 1200) and b["full_title"] == "Main, the Whole"


def test_extraction_by_format_with_rejects(spark):
    rows = [("a.txt", b"plain"), ("b.MD", b"\x93x"), ("c.html", b"<h1>T</h1><p>x"), ("d.epub", _book()), ("e.epub", b"no"), ("f.pdf", b"x"), ("g.txt", b"\xff\xfea"), ("h.txt", b"y" * 200), ("i.txt", b"y" * 70), ("j.txt", None), ("k.txt", b"")]
    df = spark.createDataFrame([(p, None if b is None else bytearray(b)) for p, b in rows], "path string, content binary")
    got = {r.path: (r.text, r.rejected) for r in files.extract_files(df.filter("path <> 'd.epub'"), 100, 50).collect()}
    assert got == {
        "a.txt": ("plain", None), "b.MD": ("“x", None), "c.html": ("T\n\nx", None), "e.epub": (None, "DAMAGED"), "f.pdf": (None, "UNSUPPORTED"), "g.txt": (None, "DECODE_FAILED"),
        "h.txt": (None, "TOO_LARGE"), "i.txt": (None, "CAP_EXCEEDED"), "j.txt": (None, "DECODE_FAILED"), "k.txt": ("", None),
    }
    assert files.extract_files(df.filter("path = 'd.epub'")).first().text == "Chapter\n\nText of Chapter."


def _book() -> bytes:
    page = lambda kind, text: f'<html xmlns:epub="http://www.idpf.org/2007/ops"><body epub:type="{kind}"><h2>{text}</h2><p>Text of {text}.</p></body></html>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="epub/content.opf"/></rootfiles></container>')
        z.writestr("epub/content.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" unique-identifier="uid"><metadata><dc:identifier id="uid">id:1</dc:identifier><dc:title id="t">Book</dc:title><dc:creator>Someone</dc:creator><dc:language>en</dc:language><dc:subject>Wolves</dc:subject></metadata><manifest><item id="a" href="text/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="text/b.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.jpg" media-type="image/jpeg"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("epub/text/a.xhtml", page("frontmatter", "Preface"))
        z.writestr("epub/text/b.xhtml", page("bodymatter", "Chapter"))
    return out.getvalue()


def test_epub(spark):
    meta, text = files.read_epub(_book())
    assert (meta["identifier"], meta["title"], meta["authors"], meta["language"], meta["subjects"]) == ("id:1", "Book", ["Someone"], "en", ["Wolves"])
    assert text == "Chapter\n\nText of Chapter."
    assert files.read_epub(_book(), ("front", "body"))[1].startswith("Preface")
    rows = files.extract_epubs(spark.createDataFrame([("a", bytearray(_book())), ("b", bytearray(b"no zip"))], "path string, content binary")).orderBy("path").collect()
    assert rows[0].title == "Book" and rows[1].error.startswith("BadZipFile")


def test_library_caps_catalog_and_tsv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one"), (tmp_path / "b.TXT").write_text("one"), (tmp_path / "c.md").write_text("one"), (tmp_path / "d.pdf").write_text("x")
    assert sorted(r.format for r in files.read_library(spark, str(tmp_path)).collect()) == ["md", "txt"]
    docs = spark.createDataFrame([(0, "aaaa"), (1, "bbbbbbbb"), (2, "cc")], "doc_id long, text string")
    assert [r.admitted for r in files.within_caps(docs, 8, 6).orderBy("doc_id").collect()] == [True, False, True]
    books = spark.createDataFrame([("b1", "First", "X", 2), ("b2", "Other", "Y", 1), ("b3", "Third", "Z", None)], "name string, title string, author string, popularityRank int")
    inside, rest = files.catalog_view(books, spark.createDataFrame([("S", ["b1"])], "name string, members array<string>"))
    assert [r.name for r in inside.collect()] == ["b1"] and [r.name for r in rest.collect()] == ["b2", "b3"]
    d = spark.createDataFrame([("Epub source for the Standard Ebooks edition of War, by A. B. Translated by C D",)], "d string").select(files.describe_edition(F.col("d")).alias("e")).first().e
    assert (d.title, d.author, d.translator) == ("War", "A. B", "C D")
    line = files.tsv_rows(spark.createDataFrame([("a\tb", None, "c\nd")], "x string, y string, z string")).first().line
    assert line == "a b\t\tc d"
    files.write_tsv(docs, str(tmp_path / "out"), {"method": "m/1"})
    assert spark.read.text(str(tmp_path / "out/rows")).count() == 3


def test_streaming_ingest(spark, tmp_path):
    docs = spark.createDataFrame([(0, "one two"), (1, "three. Four")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    run = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "doc_id long, text string").awaitTermination(120)
    run()
    spark.createDataFrame([(1, "five")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = sorted((r.doc_id, r.pos, r.key) for r in latest(spark, str(tmp_path / "out")).collect())
    want = tokenize(spark.createDataFrame([(0, "one two"), (1, "five")], "doc_id long, text string")).select("doc_id", "pos", "key")
    assert got == sorted(tuple(r) for r in want.collect())
