"""Sources: format by name, byte decoding, HTML and EPUB text, the file library; and the TSV sink."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats by suffix. Fixed values.
SUFFIXES = {".txt": "txt", ".md": "md", ".markdown": "md", ".epub": "epub", ".html": "html", ".htm": "html", ".xhtml": "html"}
#: What the bytes 80 to 9F stand for in windows-1252, where they stand for something. Fixed values.
CP1252 = {0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178}


def format_of(name: Column) -> Column:
    """txt, md, html, epub or null, by the suffix in any case."""
    out = F.lit(None).cast("string")
    for suffix, kind in SUFFIXES.items():
        out = F.when(F.lower(name).endswith(suffix), kind).otherwise(out)
    return out


def strip_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(txt|markdown|md|epub|xhtml|html|htm)$", "")


def decode(content: Column) -> Column:
    """Text of bytes: by their mark (UTF-8, UTF-16 either way), else UTF-8 if they are that, else windows-1252.

    Null for a UTF-32 mark, an odd UTF-16 length, or bytes that break what their mark says.
    """
    head = F.hex(F.substring(content, 1, 4))
    size = F.octet_length(content)
    rest = lambda n: F.substring(content, n + 1, 2_000_000_000)
    utf8 = lambda c: F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))
    wide = lambda name: F.when(size % 2 == 0, F.decode(rest(2), name))
    high = "".join(map(chr, CP1252))
    latin = F.translate(F.decode(content, "ISO-8859-1"), high, "".join(chr(v) for v in CP1252.values()))
    return (
        F.when(head.isin("FFFE0000", "0000FEFF"), F.lit(None).cast("string"))
        .when(head.startswith("EFBBBF"), utf8(rest(3)))
        .when(head.startswith("FFFE"), wide("UTF-16LE"))
        .when(head.startswith("FEFF"), wide("UTF-16BE"))
        .otherwise(F.coalesce(utf8(content), latin))
    )


def suspicious_controls(text: Column) -> Column:
    """Control characters but tab, line feed and carriage return; DEL and C1 count."""
    return F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"))


#: The steps of ``html_lite``, each a pattern (for Java and RE2 alike) and what replaces it.
HTML_LITE = (
    (r"(?is)<!--.*?-->", ""), (r"(?is)<(script|style|nav|head|template|noscript)\b.*?</(script|style|nav|head|template|noscript)\s*>", ""),
    (r"\s+", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</?(p|div|h[1-6]|ul|ol|li|section|article|header|footer|main|aside|blockquote|table|tr|td|th|figure|pre|hr|body|html)\b[^>]*>", "\n\n"),
    (r"<[^>]*>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"[ \t]*\n[ \t]*", "\n"), (r" {2,}", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
)


def html_lite(html: Column) -> Column:
    """Text of HTML by replacements only: fast, and good for well-behaved pages."""
    for pattern, new in HTML_LITE:
        html = F.regexp_replace(html, pattern, new)
    return html


#: Elements whose content is no text, elements that stand apart, and elements without an end tag. Fixed values.
SKIPPED = frozenset(("script", "style", "nav", "head", "template", "noscript"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "caption", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "li", "main", "ol", "p", "pre", "section", "table", "tbody", "tfoot", "thead", "tr", "ul",
))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Elements that belong into the head; any other one ends it. Fixed values.
IN_HEAD = frozenset(("base", "link", "meta", "noscript", "script", "style", "template", "title", "head", "html"))
#: Which open elements a start tag ends by itself (up to an element that holds such ones). Fixed values.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tr", "td", "th", "tbody", "thead", "tfoot"), "thead": ("caption", "tbody"), "tfoot": ("tr", "td", "th", "tbody", "thead"),
}
HOLDERS = frozenset(("ul", "ol", "dl", "table", "select", "div", "section", "article", "body"))
_HEADING = re.compile("h[1-6]")


class _Walker(HTMLParser):
    """Text of one page by a stack of open elements: those that stand apart between empty lines, hidden ones left out.

    ``head`` ends with its end tag, with ``body`` or with what cannot stand in it; an end tag that nothing
    is open for is passed over. With ``strict`` (XHTML) references to notes and pages are hidden too, and
    headings do not part the text.
    """

    def __init__(self, strict: bool = False):
        super().__init__(convert_charrefs=True)
        self.strict = strict
        self.parts: list[list[str]] = [[]]
        self.title: str | None = None
        self.page_title: str | None = None
        self._open: list[tuple[str, bool]] = []
        self._hidden = 0
        self._headings = 0
        self._heading: list[str] | None = None
        self._page_title: list[str] | None = None

    def _push(self, text: str) -> None:
        self.parts[-1].append(text)

    def _close(self, depth: int) -> None:
        """End the open elements from ``depth`` on, the innermost one first."""
        while len(self._open) > depth:
            tag, hides = self._open.pop()
            self._hidden -= hides
            if tag == "title" and self._page_title is not None:
                self.page_title = self.page_title or " ".join("".join(self._page_title).split()) or None
                self._page_title = None
            if self._hidden or hides:
                continue
            if _HEADING.fullmatch(tag):
                self._headings -= 1
                if not self._headings and self._heading is not None:
                    self.title, self._heading = " ".join("".join(self._heading).split()) or None, None
            if tag in BLOCKS:
                self._push("\n\n")

    def _end_head(self) -> None:
        for depth, (tag, _) in enumerate(self._open):
            if tag == "head":
                self._close(depth)
                return

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self._end_head()
        if tag in ("html", "body"):
            return
        for depth in range(len(self._open) - 1, -1, -1):
            name = self._open[depth][0]
            if tag in ENDS and name in ENDS[tag]:
                self._close(depth)
            elif tag in ENDS and name in HOLDERS:
                break
            elif tag in BLOCKS and name == "p" and not tag == "p" or tag == name == "p":
                self._close(depth)
                break
        a = dict(attrs)
        kinds = (a.get("epub:type") or "").split()
        hides = tag in SKIPPED or a.get("aria-hidden") == "true" or tag == "title"
        if self.strict:
            hides = hides or "doc-noteref" in (a.get("role") or "").split() or any(k in ("backlink", "noteref", "pagebreak") for k in kinds)
        shown = not self._hidden and not hides
        if shown and tag == "br":
            self._push("\n")
        elif shown and tag == "img":
            self._push((a.get("alt") or "").strip())
        elif shown and tag in BLOCKS:
            if _HEADING.fullmatch(tag):
                if not self._headings and not self.strict:
                    self.parts.append([])
                self._headings += tag not in VOID
                if self.title is None and self._heading is None:
                    self._heading = []
            self._push("\n\n")
        if tag in VOID:
            return
        if tag == "title":
            self._page_title = []
        self._open.append((tag, hides))
        self._hidden += hides

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.strict and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":  # counts as a line break of its own
            self.handle_starttag(tag, [])
        elif tag == "p" and not any(t == "p" for t, _ in self._open):
            self.handle_starttag(tag, [])
            self._close(len(self._open) - 1)
        else:
            for depth in range(len(self._open) - 1, -1, -1):
                if self._open[depth][0] == tag:
                    self._close(depth)
                    break

    def handle_data(self, data):
        if self._page_title is not None:
            self._page_title.append(data)
        if data.strip() and self._open and self._open[-1][0] == "head":
            self._end_head()
        if not self._hidden:
            text = re.sub(r"[\t\r\n\f\v ]+", " ", data)
            self._push(text)
            if self._heading is not None:
                self._heading.append(text)

    def close(self):
        super().close()
        self._close(0)


def tidy(text: str) -> str:
    """Line ends alike, blanks single, nothing around line ends, at most one empty line."""
    text = re.sub(r"[\t\f\v ]+", " ", re.sub(r"\r\n?", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def html_text(html: str, strict: bool = False) -> tuple[str, str | None]:
    """Text and first heading (else the title) of a page: HTML, or XHTML if ``strict``."""
    w = _Walker(strict)
    w.feed(html)
    w.close()
    parts = [t for t in (tidy("".join(p)) for p in w.parts) if t]
    return "\n\n".join(parts), w.title or w.page_title


def extract_html(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` with extracted and title."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [html_text(h) if isinstance(h, str) else (None, None) for h in pdf[html]]
            yield pdf.assign(extracted=[f[0] for f in found], title=[f[1] for f in found])

    return df.mapInPandas(run, df.withColumns({"extracted": F.lit(None).cast("string"), "title": F.lit(None).cast("string")}).schema)


_NS = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "dc": "http://purl.org/dc/elements/1.1/"}


def parse_package(xml: bytes) -> dict:
    """What a package document says of a book: identifier, titles, people, language, subjects, word count, collections."""
    root = ElementTree.fromstring(xml)
    meta = root.find("o:metadata", _NS)
    refined: dict[tuple[str, str], str] = {}
    for m in meta.findall("o:meta", _NS):
        if m.get("refines"):
            refined[m.get("refines").lstrip("#"), m.get("property", "")] = (m.text or "").strip()
    of = lambda tag: [(e.get("id", ""), " ".join("".join(e.itertext()).split())) for e in meta.findall(f"dc:{tag}", _NS)]
    named = [(refined.get((i, "title-type")), t) for i, t in of("title") if t]
    titles = {kind: t for kind, t in reversed(named)}
    title, subtitle = titles.get("main") or (named[0][1] if named else None), titles.get("subtitle")
    unique = root.get("unique-identifier")
    plain = {m.get("property"): (m.text or "").strip() for m in meta.findall("o:meta", _NS) if not m.get("refines")}
    return {
        "identifier": next((t for i, t in of("identifier") if i == unique), None), "title": title, "subtitle": subtitle, "full_title": titles.get("expanded") or (f"{title}: {subtitle}" if subtitle else title),
        "authors": [t for _, t in of("creator")], "translators": [t for i, t in of("contributor") if refined.get((i, "role")) == "trl"],
        "contributors": [t for i, t in of("contributor") if refined.get((i, "role")) != "trl"], "language": next((t for _, t in of("language")), None), "subjects": [t for _, t in of("subject")],
        "word_count": int(plain["schema:wordCount"]) if plain.get("schema:wordCount", "").isdigit() else None,
        "collections": [((m.text or "").strip(), refined.get((m.get("id", ""), "group-position"))) for m in meta.findall("o:meta", _NS) if m.get("property") == "belongs-to-collection"],
    }


def _partition(xhtml: str) -> str:
    found = re.search(r'<body[^>]*epub:type="([^"]*)"', xhtml)
    kinds = (found[1] if found else "").split()
    return next((k.removesuffix("matter") for k in ("frontmatter", "bodymatter", "backmatter") if k in kinds), "unknown")


def read_epub(data: bytes, partitions: tuple[str, ...] = ("body",), most_bytes: int = 128 << 20) -> tuple[dict, str]:
    """Metadata and text of a book: its reading order's pages of the chosen parts, two line ends between."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        wanted = [i for i in z.infolist() if re.search(r"(container\.xml|\.opf|\.xhtml)$", i.filename)]
        if sum(i.file_size for i in wanted) > most_bytes:
            raise ValueError("the book is too large when unpacked")
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = box.find(".//c:rootfile", _NS).get("full-path")
        xml = z.read(package)
        root, top = ElementTree.fromstring(xml), posixpath.dirname(package)
        items = {i.get("id"): i for i in root.findall(".//o:manifest/o:item", _NS)}
        texts = []
        for ref in root.findall(".//o:spine/o:itemref", _NS):
            item = items[ref.get("idref")]
            if item.get("media-type") != "application/xhtml+xml":
                continue
            path = posixpath.normpath(posixpath.join(top, item.get("href")))
            if path.startswith(("..", "/")):
                raise ValueError("a page lies outside the book")
            page = z.read(path).decode("utf-8")
            if _partition(page) in partitions:
                texts.append(html_text(page, strict=True)[0])
    return parse_package(xml), "\n\n".join(t for t in texts if t)


def extract_epubs(files: DataFrame, partitions: tuple[str, ...] = ("body",)) -> DataFrame:
    """path, title, authors, language, text and, for damaged books, error, from binary files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    meta, text = read_epub(bytes(content), partitions)
                    rows.append((path, meta["title"], meta["authors"], meta["language"], text, None))
                except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "title", "authors", "language", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, title string, authors array<string>, language string, text string, error string")


def library(files: DataFrame) -> DataFrame:
    """Files (path, content) with their format, key (format and SHA-256) and decoded text (null for EPUB); one row for each
    key, that of the smallest path. Files of other formats are left out."""
    known = files.withColumn("format", format_of(F.col("path"))).filter("format is not null").withColumn("key", F.concat_ws(":", "format", F.sha2("content", 256)))
    # The smallest path of a key leaves each task, without the content.
    first = known.groupBy("key").agg(F.min("path").alias("path"))
    kept = known.join(first.repartition("path"), ["key", "path"], "left_semi").dropDuplicates(["key"])
    return kept.withColumn("text", F.when(F.col("format") != "epub", decode(F.col("content"))))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """The library of all files below ``path``."""
    return library(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def well_formed(text: Column) -> Column:
    """Whether a text is UTF-8 all through, without halves of surrogate pairs."""
    return F.is_valid_utf8(text)


#: What an extraction may be, per file. Null counts as none.
MOST_SOURCE_BYTES, MOST_TEXT_CHARS = 256 << 20, 64 << 20


def extract_files(files: DataFrame, most_bytes: int = MOST_SOURCE_BYTES, most_chars: int = MOST_TEXT_CHARS) -> DataFrame:
    """Files (path, content) by what their format needs: path, format, title, text and ``rejected``.

    TXT and MD are their decoded bytes, HTML and EPUB what is read in them. A file is rejected (with a null
    text) for its format, its size before or its length after extraction, bytes that can't be decoded or a
    damaged book; the reasons are UNSUPPORTED, TOO_LARGE, CAP_EXCEEDED, DECODE_FAILED and DAMAGED.
    """
    known = files.select("path", "content", format_of(F.col("path")).alias("format"))
    none = F.lit(None).cast("string")
    small = F.octet_length("content") <= most_bytes
    bad = known.filter(F.col("format").isNull() | ~F.coalesce(small, F.lit(False)))
    why = F.when(F.col("format").isNull(), "UNSUPPORTED").when(F.col("content").isNull(), "DECODE_FAILED").otherwise("TOO_LARGE")
    refused = bad.select("path", "format", none.alias("title"), none.alias("text"), why.alias("rejected"))
    good = known.filter(F.col("format").isNotNull() & F.coalesce(small, F.lit(False)))
    decoded = good.filter("format <> 'epub'").select("path", "format", decode(F.col("content")).alias("text"))
    failed = F.when(F.col("text").isNull(), "DECODE_FAILED")
    plain = decoded.filter("format in ('txt', 'md')").select("path", "format", none.alias("title"), "text", failed.alias("rejected"))
    pages = extract_html(decoded.filter("format = 'html'").withColumnRenamed("text", "html")).withColumnRenamed("extracted", "text")
    pages = pages.select("path", "format", "title", "text", failed.alias("rejected"))
    books = extract_epubs(good.filter("format = 'epub'")).select("path", F.lit("epub").alias("format"), "title", "text", F.when(F.col("error").isNotNull(), "DAMAGED").alias("rejected"))
    every = plain.unionByName(pages).unionByName(books)
    long = F.length("text") > most_chars
    capped = every.withColumn("rejected", F.coalesce("rejected", F.when(long, "CAP_EXCEEDED"))).withColumn("text", F.when(F.col("rejected").isNull(), F.col("text")))
    return capped.unionByName(refused)


def delete_from_library(library: DataFrame, keys: DataFrame) -> DataFrame:
    return library.join(keys.select("key"), "key", "left_anti")


def within_caps(docs: DataFrame, most_chars: int | None = None, most_total: int | None = None, text: str = "text", order: str = "doc_id") -> DataFrame:
    """``docs`` with ``admitted``: not longer than ``most_chars``, and in order as long as the total stays below ``most_total``.

    A document that would cross the total is left out and smaller ones behind it may still fit. That is a
    fold over lengths, so one group of (``order``, length) pairs, without texts; it is meant for a project's
    documents, not for a corpus.
    """
    size = F.length(text)
    ok = F.lit(True) if most_chars is None else size <= most_chars
    if most_total is None:
        return docs.withColumn("admitted", F.coalesce(ok, F.lit(False)))
    sizes = docs.filter(ok).select(F.col(order).alias("o_"), size.cast("long").alias("n"))
    line = sizes.agg(F.array_sort(F.collect_list(F.struct("o_", "n"))).alias("z"))
    fits = lambda acc, x: acc["total"] + x["n"] <= most_total
    kind = docs.schema[order].dataType.simpleString()
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast(f"array<{kind}>").alias("taken"))
    fold = F.aggregate("z", zero, lambda acc, x: F.when(fits(acc, x), F.struct((acc["total"] + x["n"]).alias("total"), F.concat(acc["taken"], F.array(x["o_"])).alias("taken"))).otherwise(acc), lambda acc: acc["taken"])
    taken = line.select(F.explode(fold).alias("o_")).withColumn("t_", F.lit(True))
    joined = docs.join(taken, docs[order] == taken["o_"], "left").withColumn("admitted", F.coalesce("t_", F.lit(False)) & F.coalesce(ok, F.lit(False)))
    return joined.select(*docs.columns, "admitted")


def catalog_view(books: DataFrame, series: DataFrame, query: str = "") -> tuple[DataFrame, DataFrame]:
    """Series with their members in order, and the other books by popularity, that have the query in title, author or series."""
    like = lambda *cols: F.lit(True) if not query else F.concat_ws(" ", *cols).contains(query) | F.lower(F.concat_ws(" ", *cols)).contains(query.lower())
    members = series.select(F.col("name").alias("series"), F.posexplode("members").alias("position", "book"))
    inside = members.join(books, F.col("book") == F.col("name")).filter(like("title", "author", "series")).select("series", "position", "name", "title", "author")
    rest = books.join(members, F.col("name") == F.col("book"), "left_anti").filter(like("title", "author")).orderBy(F.asc_nulls_last("popularityRank"), "title")
    return inside, rest


def describe_edition(description: Column) -> Column:
    """title, author and translator from an edition's one-line description."""
    pattern = r"^Epub source for the Standard Ebooks edition of (.+?), by (.+?)(?:\. Translated by (.+?))?\.?$"
    part = lambda n: F.nullif(F.regexp_extract(description, pattern, n), F.lit(""))
    return F.struct(part(1).alias("title"), part(2).alias("author"), part(3).alias("translator"))


def tsv_rows(df: DataFrame) -> DataFrame:
    """One column ``line``: the cells of each row with tabs between; null is empty, tabs and line ends in cells are spaces."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in df.columns]
    return df.select(F.concat_ws("\t", *cells).alias("line"))


def write_tsv(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """A folder of TSV files, and what made them (as comment lines, with the header) in one of its own."""
    spark = df.sparkSession
    tsv_rows(df).write.text(f"{path}/rows")
    head = [f"# {k}: {v}" for k, v in provenance.items()] + ["\t".join(df.columns)]
    spark.createDataFrame([(line,) for line in head], "line string").coalesce(1).write.text(f"{path}/header")
