"""The positional corpus: one row per token, and the small tables that follow from it.

Tokens are runs of letters, marks, digits and underscores, joined over single apostrophes and points
(profile ``regex-word-v1``), or follow Unicode's word boundaries (``uax29-word-v1``). Sentence, paragraph and character places are running sums inside each text.
Offsets are code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Texts whose tokens are handled together.
PIECE_DOCS = 256
TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
NUMERAL = r"^\p{N}+(?:[.,·]\p{N}+)*$"
SENTENCE_BREAK = r"[.!?…]+[\"'”’)\]]*\s"
PARAGRAPH_BREAK = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])[ \t]*(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])"


def normal_keys(raw: pa.Array) -> pa.Array:
    """The vocabulary keys of tokens: composed (NFC), with plain apostrophes for typographic ones. Case stays."""
    wide = pc.invert(pc.string_is_ascii(raw))
    if pc.any(wide).as_py():
        # Each distinct one once, in Python: Arrow's own normalisation leaves decomposed text as it is.
        some = raw.filter(wide).dictionary_encode()
        keys = [unicodedata.normalize("NFC", x).replace("’", "'").replace("ʼ", "'") for x in some.dictionary.to_pylist()]
        raw = pc.replace_with_mask(raw, wide, pa.array(keys, raw.type).take(some.indices))
    return raw


def strip_marks(text: str) -> str:
    """Decomposed, stripped of marks and composed again."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.category(c).startswith("M")))


@F.pandas_udf(T.StringType())
def without_marks(keys: pd.Series) -> pd.Series:
    return keys.map(strip_marks)


def _places(batches: Iterator[pa.RecordBatch], numerals: bool) -> Iterator[pa.RecordBatch]:
    """Rows of tokens from rows of texts (doc_id, tk, sp: tokens and what stands between), some texts at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, PIECE_DOCS):
            part = batch.slice(first, PIECE_DOCS)
            tk, sp = part.column("tk"), part.column("sp")
            n = np.asarray(pc.fill_null(pc.list_value_length(tk), 0), np.int64)
            firsts = np.cumsum(n) - n
            # The stretch behind a text's last token belongs to none.
            m = np.asarray(pc.fill_null(pc.list_value_length(sp), 0), np.int64)
            before = np.ones(int(m.sum()), bool)
            before[(np.cumsum(m) - 1)[m > 0]] = False
            raw, gap = pc.list_flatten(tk), pc.list_flatten(sp).filter(pa.array(before))
            doc, pos = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(firsts, n)

            def inside(x: np.ndarray, n=n, firsts=firsts) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(x)])
                return total[1:] - np.repeat(total[firsts], n)

            size = np.asarray(pc.utf8_length(raw), np.int64)
            end = inside(np.asarray(pc.utf8_length(gap), np.int64) + size)
            hit = lambda pattern, gap=gap: np.asarray(pc.match_substring_regex(gap, pattern), bool)
            paragraph = hit(PARAGRAPH_BREAK) & (pos > 0)
            sentence = paragraph | hit(SENTENCE_BREAK) & (pos > 0)
            numeral = np.asarray(pc.match_substring_regex(raw, NUMERAL), bool)
            columns = {
                "doc_id": part.column("doc_id").take(pa.array(doc)), "pos": pos if numerals else inside(~numeral) - 1, "raw": raw,
                "key": normal_keys(raw), "cls": pc.if_else(pa.array(numeral), "numeral", "lexical"),
                "char_start": end - size, "char_end": end, "sent_id": inside(sentence), "para_id": inside(paragraph),
            }
            out = pa.RecordBatch.from_pydict({c: x if isinstance(x, pa.Array | pa.ChunkedArray) else pa.array(x, pa.int64()) for c, x in columns.items()})
            yield out if numerals else out.filter(pa.array(~numeral))


_WORDLIKE, _BOUNDARY = regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"(?V1w)\b")


def uax29_words(text: str) -> tuple[list[str], list[str]]:
    """The stretches between Unicode's default word boundaries that have a letter or digit, and what stands before, between and behind them."""
    edges = sorted({0, len(text), *(m.start() for m in _BOUNDARY.finditer(text))})
    words, gaps, last = [], [], 0
    for a, b in zip(edges, edges[1:], strict=False):
        if _WORDLIKE.search(text, a, b):
            words.append(text[a:b])
            gaps.append(text[last:a])
            last = b
    return words, [*gaps, text[last:]]


_CUT = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("tk", "sp")])


@F.pandas_udf(_CUT)
def _uax29(texts: pd.Series) -> pd.DataFrame:
    cut = [uax29_words(t) if isinstance(t, str) else (None, None) for t in texts]
    return pd.DataFrame({"tk": [c[0] for c in cut], "sp": [c[1] for c in cut]})


#: How tokens are cut: by the pattern TOKEN, or by Unicode's default word boundaries.
PROFILES = ("regex-word-v1", "uax29-word-v1")


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", numerals: bool = True, profile: str = PROFILES[0]) -> DataFrame:
    """doc_id, pos, raw, key, cls, char_start, char_end, sent_id, para_id of every token.

    Without ``numerals`` those tokens are dropped and positions counted without them. Null texts have none.
    A text is one row, so all places are counted inside it: nothing is moved or sorted.
    """
    if profile not in PROFILES:
        raise ValueError(f"the profile is one of {', '.join(PROFILES)}")
    if profile == PROFILES[0]:
        parts = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("tk"), F.split(text, TOKEN, -1).alias("sp")
        cut = docs.select(F.col(doc_id).alias("doc_id"), *parts)
    else:
        cut = docs.select(F.col(doc_id).alias("doc_id"), _uax29(F.col(text)).alias("z")).select("doc_id", "z.tk", "z.sp")
    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, pos long, raw string, key string, cls string, char_start long, char_end long, sent_id long, para_id long"
    return cut.mapInArrow(lambda batches: _places(batches, numerals), schema)


def running_total(df: DataFrame, order: str, value: str, to: str, leading: str | None = None) -> DataFrame:
    """``to``: the sum of ``value`` over all rows before, by ``order``, without one task that sees all rows.

    Rows are cut into ranges of ``leading`` (a number that ``order`` begins with; by default ``order`` itself)
    at bounds that the driver has looked up, so that both passes see the same ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = leading or order
    bounds = sorted(set(df.select(F.col(head).cast("double").alias("x")).approxQuantile("x", [k / n for k in range(1, n)], 0.001)))
    at = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col(head).cast("double"))) if bounds else F.lit(0)
    ranged = df.withColumn("range_", at)
    own = Window.partitionBy("range_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range, so a bounded number.
    sums = ranged.groupBy("range_").agg(F.sum(value).alias("part_"))
    before = sums.withColumn("before_", F.coalesce(F.sum("part_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("part_")
    summed = ranged.withColumn("own_", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return summed.join(F.broadcast(before), "range_").withColumn(to, F.col("own_") + F.col("before_")).drop("range_", "own_", "before_")


class Corpus:
    """Documents in declared order (ascending doc_id) and what is derived from them, computed once."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.spark: SparkSession = docs.sparkSession
        self.documents = docs.withColumnRenamed(doc_id, "doc_id").withColumnRenamed(text, "text")
        #: Small results that are read more than once, by what they are.
        self.kept: dict[object, DataFrame] = {}

    @cached_property
    def tokens(self) -> DataFrame:
        return tokenize(self.documents).persist()

    @cached_property
    def stream(self) -> DataFrame:
        """The rows of ``tokens``, made anew by each query that passes over them and never kept."""
        return tokenize(self.documents)

    @cached_property
    def keys(self) -> DataFrame:
        """The distinct keys."""
        return self.stream.select("key").distinct().persist()

    @cached_property
    def docs(self) -> DataFrame:
        """doc_id, token_count and seq_base, the tokens of all documents before. Documents without tokens count."""
        n = F.greatest(F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))), F.lit(0)).cast("long")
        counts = self.documents.groupBy("doc_id").agg(F.sum(n).alias("token_count"))
        every = self.documents.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("token_count", F.lit(0)).alias("token_count"))
        return running_total(every, "doc_id", "token_count", "seq_base").select("doc_id", "token_count", F.col("seq_base").cast("long").alias("seq_base")).persist()

    @cached_property
    def doc_terms(self) -> DataFrame:
        return self.stream.groupBy("doc_id", "key", "cls").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).persist()

    @cached_property
    def vocab(self) -> DataFrame:
        """key, cls, n, df and where it was first seen (its rank by that is the type id)."""
        seen = F.min(F.struct("doc_id", "first_pos")).alias("seen")
        return self.doc_terms.groupBy("key", "cls").agg(F.sum("n").alias("n"), F.count("*").alias("df"), seen)

    @cached_property
    def folded(self) -> DataFrame:
        """Each distinct key and what it is without marks. Only keys beyond ASCII need Python."""
        keys = self.keys
        wide = F.col("key").rlike(r"[^\x00-\x7F]")
        return keys.filter(~wide).withColumn("bare", F.col("key")).unionByName(keys.filter(wide).withColumn("bare", without_marks(F.col("key")))).persist()

    def type_ids(self) -> DataFrame:
        vocab = self.vocab.withColumn("one", F.lit(1))
        return running_total(vocab.withColumn("seen_doc", F.col("seen.doc_id")), "seen", "one", "type_id", "seen_doc").select("key", "cls", "n", "df", F.col("type_id").cast("long").alias("type_id"))


    def close(self) -> None:
        """Let go of everything that was computed and kept."""
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()
        for name in ("tokens", "keys", "docs", "doc_terms", "folded"):
            if name in self.__dict__:
                self.__dict__.pop(name).unpersist()
        for name in ("stream", "vocab"):
            self.__dict__.pop(name, None)


_OPEN: dict[tuple[str, str], Corpus] = {}
#: Corpora of one application that stay open; the one opened first goes when there are more.
MOST_OPEN = 4


def open_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of a folder's documents; kept for the application, so that queries share its tokens."""
    app = spark.sparkContext.applicationId
    for key in [k for k in _OPEN if k[0] != app]:
        del _OPEN[key]  # of an application that has ended
    if (app, sf_dir) not in _OPEN:
        while len(_OPEN) >= MOST_OPEN:
            _OPEN.pop(next(iter(_OPEN))).close()
        _OPEN[app, sf_dir] = Corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return _OPEN[app, sf_dir]
