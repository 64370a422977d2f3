"""What must hold of token tables and snapshots, as queries for the rows that break it, and names for how they were made."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import NUMERAL, PARAGRAPH_BREAK, SENTENCE_BREAK, TOKEN, Corpus, tokenize
from .terms import TermGroup

CLASSES = ("lexical", "numeral")
PROBE = "One can't stop. 3,141.5 wolves!\n\nNaïve café’s end… “Yes.” He left."


def _broken(text: str | None, row: tuple, before: tuple) -> list[str]:
    """The rules that a token (pos, raw, cls, char_start, char_end, sent_id, para_id) breaks behind ``before`` (pos, char_end, sent_id, para_id); what is null breaks none."""
    (pos, raw, cls, start, end, sent, para), (p0, e0, s0, u0) = row, before
    holds = lambda rule, *xs: None not in xs and rule(*xs)

    def other(text: str, raw: str, a: int, b: int) -> bool:
        first = a if a >= 0 else 0 if a == -1 else len(text) + a + 1  # as SQL's substring counts
        return text[max(first, 0) : max(first + b - a, 0)] != raw

    rules = {
        "no such document": text is None, "positions have gaps": holds(lambda a: a != p0 + 1, pos), "spans overlap or are empty": holds(lambda a: a < e0, start) or holds(lambda a, b: a >= b, start, end),
        "beyond the text": holds(lambda t, b: b > len(t), text, end), "unknown class": holds(lambda c: c not in CLASSES, cls), "not the text": holds(other, text, raw, start, end),
        "units go back": holds(lambda s: s < s0, sent) or holds(lambda u: u < u0, para), "a paragraph parts a sentence": holds(lambda u, s, p: u != u0 and s == s0 and p > 0, para, sent, pos),
    }
    return [name for name, broken in rules.items() if broken]


def token_violations(tokens: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, pos and ``broken`` of tokens that break a rule: positions without gaps, spans in order inside the
    text, known classes, the raw token that the text has there, units that never go back.

    A document's tokens meet its text once, as looking a place up in it for each token takes the text's length each time.
    """
    names = ["pos", "raw", "cls", "char_start", "char_end", "sent_id", "para_id"]
    z = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("z"))
    texts = z.join(documents.select("doc_id", "text"), "doc_id", "left").select("doc_id", "text", *[F.col(f"z.{n}").alias(n) for n in names])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                doc, text, *columns = (c[k].as_py() for c in batch.columns)
                p0, e0, s0, u0, size = -1, 0, 0, 0, len(text or "")
                for row in zip(*columns, strict=True):
                    pos, raw, cls, start, end, sent, para = row
                    fine = text is not None and None not in row and pos == p0 + 1 and e0 <= start < end <= size and cls in CLASSES and text[start:end] == raw and sent >= s0 and para >= u0
                    if not fine or para != u0 and sent == s0:
                        found += [(doc, pos, b) for b in _broken(text, row, (p0, e0, s0, u0))]
                    p0, e0, s0, u0 = -1 if pos is None else pos, end or 0, sent or 0, para or 0
            columns = zip(*found, strict=True) if found else ([], [], [])
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "pos", "broken"])

    return texts.mapInArrow(check, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, pos long, broken string")


def snapshot_violations(corpus: Corpus) -> DataFrame:
    """What a corpus' derived tables contradict its tokens in: ``what`` and ``rows``, empty if nothing."""
    counts = corpus.tokens.groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = corpus.docs.join(counts, "doc_id", "full").filter(F.coalesce("n", F.lit(0)) != F.coalesce("token_count", F.lit(-1)))
    terms = corpus.doc_terms.groupBy("doc_id").agg(F.sum("n").alias("m")).join(counts, "doc_id", "full").filter(~F.col("m").eqNullSafe(F.col("n")))
    types = corpus.type_ids().agg(F.count("*").alias("n"), F.count_distinct("type_id").alias("d"), F.coalesce(F.min("type_id"), F.lit(0)).alias("lo"), F.coalesce(F.max("type_id"), F.lit(-1)).alias("hi"))
    bad_types = types.filter("n <> d or lo <> 0 or hi <> n - 1")
    # Each document begins where all before it end: with the next one's base, a check of neighbours in ranges.
    last = corpus.docs.agg(F.max(F.col("seq_base") + F.col("token_count")).alias("end"), F.sum("token_count").alias("total")).filter("end <> total")
    count = lambda df, what: df.agg(F.count("*").alias("rows")).select(F.lit(what).alias("what"), "rows")
    every = count(docs, "token counts").unionByName(count(terms, "term counts")).unionByName(count(bad_types, "type ids")).unionByName(count(last, "sequence bases"))
    return every.filter("rows > 0")


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def segmenter_fingerprint(spark: SparkSession) -> dict:
    """Which profile cuts tokens here, with a digest of what it makes of a probe."""
    rows = tokenize(spark.createDataFrame([(0, PROBE)], "doc_id long, text string")).orderBy("pos").collect()
    packed = "|".join(",".join(str(r[c]) for r in rows) for c in ("char_start", "char_end", "cls", "sent_id", "para_id"))
    return {"profile": "regex-word-v1", "probe_sha256": hashlib.sha256(packed.encode()).hexdigest()}


def recipe_hash(spark: SparkSession, numerals: bool = True) -> str:
    """A digest of all that decides a token table; tables of one recipe may be used for each other."""
    recipe = {
        "word": TOKEN, "sentence": SENTENCE_BREAK, "paragraph": PARAGRAPH_BREAK, "numeral": NUMERAL, "numerals": "keep" if numerals else "drop", "apostrophes": "plain",
        "segmenter": segmenter_fingerprint(spark),
    }
    return hashlib.sha256(canonical_json(recipe).encode()).hexdigest()


def group_identity(g: TermGroup) -> str:
    """The same for groups that match alike: members in order and whether overlaps count."""
    members = [
        {"elements": [[e.kind, e.stem] for e in m.elements], "cross_sentence": m.cross_sentence, "fold_case": m.fold_case, "fold_marks": m.fold_marks} for m in g.members
    ]
    return hashlib.sha256(canonical_json({"members": members, "count_overlaps": g.count_overlaps}).encode()).hexdigest()


def token_table(docs: DataFrame, folder: str, numerals: bool = True) -> DataFrame:
    """The tokens of ``docs`` from the table of their recipe below ``folder``, which is written if it is not there.

    Rows are clustered and sorted by key, so that a lookup of few keys reads few row groups. ``folder``
    belongs to one version of ``docs``.
    """
    spark = docs.sparkSession
    path = f"{folder.rstrip('/')}/tokens-{recipe_hash(spark, numerals)[:16]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        rows = tokenize(docs, numerals=numerals).repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "pos")
        rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(path)
    return spark.read.parquet(path)
