"""Every query of the engine's own operators with the SQL that it must equal.

Doubles are rounded to six places on both sides. Queries whose steps are sequential (destinations, MTLD,
HTML by parser) have no SQL; their tests compare them with plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bins, counts, navigate, proximity, quality, selection, terms
from ..operators.corpus import NUMERAL, PARAGRAPH_BREAK, SENTENCE_BREAK, TOKEN, Corpus, open_corpus, tokenize
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _q(s: str) -> str:
    return s.replace("'", "''")


def _tokens_sql(source: str = "documents", doc_id: str = "doc_id") -> str:
    return f"""raw AS (SELECT {doc_id} AS doc_id, regexp_extract_all(text, '{_q(TOKEN)}') AS tk, string_split_regex(text, '{_q(TOKEN)}') AS sp FROM {source}),
ex AS (SELECT doc_id, unnest(tk) AS raw, unnest(sp[1:len(tk)]) AS gap, unnest(range(len(tk))) AS pos FROM raw),
tokens AS (SELECT doc_id, pos, raw, regexp_replace(nfc_normalize(raw), '[’ʼ]', '''', 'g') AS key, lower(strip_accents(regexp_replace(nfc_normalize(raw), '[’ʼ]', '''', 'g'))) AS f,
  CASE WHEN regexp_matches(raw, '{_q(NUMERAL)}') THEN 'numeral' ELSE 'lexical' END AS cls,
  (sum(length(gap) + length(raw)) OVER w - length(raw))::BIGINT AS char_start, (sum(length(gap) + length(raw)) OVER w)::BIGINT AS char_end,
  (sum((pos > 0 AND (regexp_matches(gap, '{_q(SENTENCE_BREAK)}') OR regexp_matches(gap, '{_q(PARAGRAPH_BREAK)}')))::INT) OVER w)::BIGINT AS sent_id,
  (sum((pos > 0 AND regexp_matches(gap, '{_q(PARAGRAPH_BREAK)}'))::INT) OVER w)::BIGINT AS para_id
  FROM ex WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


BASE = f"""WITH {_tokens_sql()},
docs AS (SELECT doc_id, n AS token_count, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seq_base
  FROM (SELECT d.doc_id, count(t.pos) AS n FROM documents d LEFT JOIN tokens t USING (doc_id) GROUP BY 1)),
doc_terms AS (SELECT doc_id, key, cls, count(*) AS n, min(pos) AS first_pos FROM tokens GROUP BY ALL),
types AS (SELECT key, cls, sum(n)::BIGINT AS n, count(*) AS df, row_number() OVER (ORDER BY min(doc_id * 4294967296 + first_pos)) - 1 AS type_id FROM doc_terms GROUP BY ALL),
runs AS (SELECT doc_id, 5::BIGINT AS r_start, 30::BIGINT AS r_end FROM docs WHERE token_count >= 40 UNION ALL SELECT doc_id, 35, 40 FROM docs WHERE token_count >= 40),
occ AS (SELECT 0 AS track, doc_id, pos, 1 AS span FROM tokens WHERE f = 'the' UNION ALL SELECT 1, doc_id, pos, 1 FROM tokens WHERE f = 'of')"""


def _register(name: str, sql: str | None = None, base: bool = True):
    def add(f: Callable[[Corpus], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(open_corpus(spark, sf_dir))
            return out.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = (BASE + "\n" + sql) if base else sql
        return f

    return add


def _table(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def _runs(c: Corpus) -> DataFrame:
    """Ranges that touch, and one apart, in every document of 40 tokens or more."""
    docs = c.docs.filter("token_count >= 40").select("doc_id")
    parts = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("r_start"), F.lit(b).cast("long").alias("r_end")) for a, b in ((5, 20), (15, 30), (35, 40))]))
    return selection.merge_ranges(docs.select("doc_id", parts.alias("r")).select("doc_id", "r.*"))


def _occ(c: Corpus) -> DataFrame:
    return terms.tracks(c, [terms.group("the"), terms.group("of")])


def _occ3(c: Corpus) -> DataFrame:
    """The same two tracks and a third one that occurs nowhere."""
    return terms.tracks(c, [terms.group("the"), terms.group("of"), terms.group("zzyzxq")])


def _english(c: Corpus) -> tuple[DataFrame, DataFrame]:
    d = c.documents
    return d.filter("lang = 'en'").select("doc_id"), d.filter("lang <> 'en'").select("doc_id")


# ---- index and selection ---------------------------------------------------------------------------------------------

_register("tokens", "SELECT doc_id, pos, raw, key, cls, char_start, char_end, sent_id, para_id FROM tokens")(lambda c: c.tokens)
_register("tokens_without_numerals", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, key FROM tokens WHERE cls = 'lexical'")(
    lambda c: tokenize(c.documents, numerals=False).select("doc_id", "pos", "key")
)
_register("tokens_uax29")(lambda c: tokenize(c.documents, profile="uax29-word-v1").select("doc_id", "pos", "key", "cls", "char_start", "char_end"))
_register("vocabulary", "SELECT key, cls, n, df, type_id FROM types")(lambda c: c.type_ids())
_register("snapshot_docs", "SELECT doc_id, token_count, seq_base FROM docs")(lambda c: c.docs)
_register("doc_terms", "SELECT doc_id, key, cls, n FROM doc_terms")(lambda c: counts.term_counts(c))
_register("doc_terms_ranged", "SELECT doc_id, key, cls, count(*) AS n FROM tokens JOIN runs USING (doc_id) WHERE pos >= r_start AND pos < r_end GROUP BY ALL")(lambda c: counts.term_counts(c, _runs(c)))
_register("selection_merge", "SELECT * FROM runs")(_runs)
_register("selection_resolve", "SELECT * FROM runs UNION ALL SELECT doc_id, 0, token_count FROM docs WHERE token_count < 40")(lambda c: selection.resolve(c, ranges=_runs(c)))
_register("selection_overlap", "SELECT doc_id FROM docs WHERE token_count >= 40")(lambda c: selection.overlaps(_runs(c), c.docs.select("doc_id", F.lit(39).cast("long").alias("r_start"), F.col("token_count").alias("r_end"))))
_register("selection_commit", """SELECT doc_id, CASE WHEN doc_id = 3 THEN 7 ELSE 0 END::BIGINT AS r_start, CASE WHEN doc_id = 12 THEN least(5, token_count) ELSE token_count END::BIGINT AS r_end
FROM docs WHERE doc_id BETWEEN 3 AND 12 AND token_count > 0""")(lambda c: selection.commit_range(c, 3, 7, 12, 4))
_register("slot_map", "SELECT doc_id, ordinal, row_number() OVER (ORDER BY doc_id) - 1 AS slot FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents) WHERE lang = 'en'")(lambda c: bins.slot_map(c, _english(c)[0]))
_register("token_violations", "SELECT doc_id, pos, ''::VARCHAR AS broken FROM tokens WHERE length(raw) <> char_end - char_start")(lambda c: quality.token_violations(c.stream, c.documents))
_register("snapshot_violations", "SELECT ''::VARCHAR AS what, 0::BIGINT AS rows FROM docs WHERE token_count < 0", )(lambda c: quality.snapshot_violations(c))
_register("progress", "SELECT doc_id, pos, round((seq_base + pos + 1)::DOUBLE / (SELECT sum(token_count) FROM docs), 6) AS progress FROM occ JOIN docs USING (doc_id) WHERE track = 1")(lambda c: navigate.progress(c, _occ(c).filter("track = 1").select("doc_id", "pos")))
_register("missing_documents", "SELECT doc_id FROM documents WHERE lang <> 'en'")(lambda c: selection.missing(c.documents, _english(c)[0]))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("z"))
    texts = turns.select(F.col("conv_id").alias("doc_id"), F.array_join(F.col("z.text"), "\n\n").alias("text"))
    units = tokenize(texts).groupBy("doc_id", "para_id").agg(F.min("pos").alias("first"), F.count("*").alias("length"))
    return units


_table("paragraphs", _paragraphs, f"""WITH conv AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY 1),
{_tokens_sql('conv', 'conv_id')}
SELECT doc_id, para_id, min(pos) AS first, count(*) AS length FROM tokens GROUP BY ALL""")

# ---- counts ----------------------------------------------------------------------------------------------------------

_FREQ = """, c AS (SELECT doc_id, key, cls, n, sum(n) OVER (PARTITION BY key) AS t, sum(n) OVER (PARTITION BY doc_id) AS size FROM doc_terms),
tot AS (SELECT sum(size) AS total, count(*) FILTER (size > 0) AS parts, min(size) AS least FROM (SELECT token_count AS size FROM docs)),
freq AS (SELECT key, cls, count, doc_freq, round(count * 10000.0 / total, 6) AS rate_per_10k, round(greatest(0, least(1, 0.5 * (1 + m))), 6) AS dp,
  round(greatest(0, least(1, 0.5 * (1 + m))) / (1 - least::DOUBLE / total), 6) AS dp_norm
  FROM (SELECT key, cls, sum(n)::BIGINT AS count, count(*) AS doc_freq, sum(abs(n::DOUBLE / t - size::DOUBLE / total) - size::DOUBLE / total) AS m, any_value(total) AS total, any_value(least) AS least FROM c, tot GROUP BY ALL))
"""
_register("freq_list", _FREQ + "SELECT * FROM freq")(lambda c: counts.frequency_table(c))
_register("freq_page", _FREQ + "SELECT freq.*, type_id FROM freq JOIN types USING (key) ORDER BY count DESC, type_id LIMIT 50 OFFSET 10")(lambda c: counts.frequency_page(c, offset=10))
_register("freq_page_by_key", _FREQ + "SELECT key, count, type_id FROM freq JOIN types USING (key) WHERE count >= 3 AND doc_freq >= 2 AND regexp_matches(key, '^[a-m]') ORDER BY lower(key), count DESC, type_id LIMIT 100")(
    lambda c: counts.frequency_page(c, "key", False, limit=100, min_count=3, min_docs=2, pattern="^[a-m]").select("key", "count", "type_id")
)
_register("freq_numerals", "SELECT key, sum(n)::BIGINT AS count, count(*) AS doc_freq FROM doc_terms WHERE cls = 'numeral' GROUP BY 1")(
    lambda c: counts.frequency_table(c, classes=("numeral",), dispersion=False).select("key", "count", "doc_freq")
)
_KEYNESS = """, s AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS side FROM documents), c AS (SELECT doc_id, key, cls, n, side FROM doc_terms JOIN s USING (doc_id)),
size AS (SELECT side, doc_id, sum(n) AS size FROM c GROUP BY ALL), tot AS (SELECT side, sum(size)::DOUBLE AS total, count(*) AS parts FROM size GROUP BY 1),
m AS (SELECT key, side, sum(abs(c.n::DOUBLE / t - size / total) - size / total) AS m FROM (SELECT *, sum(n) OVER (PARTITION BY key, side) AS t FROM c) c JOIN size USING (side, doc_id) JOIN tot USING (side) GROUP BY ALL),
k AS (SELECT key, cls, coalesce(sum(n) FILTER (side = 'a'), 0)::BIGINT AS count_a, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS count_b,
  count(*) FILTER (side = 'a') AS range_a, count(*) FILTER (side = 'b') AS range_b FROM c GROUP BY ALL),
v AS (SELECT k.*, count_a::DOUBLE AS a, count_b::DOUBLE AS b, ta.total AS n1, tb.total AS n2, ma.m AS ma, mb.m AS mb FROM k, (SELECT total FROM tot WHERE side = 'a') ta, (SELECT total FROM tot WHERE side = 'b') tb
  LEFT JOIN m ma ON ma.key = k.key AND ma.side = 'a' LEFT JOIN m mb ON mb.key = k.key AND mb.side = 'b'),
keyness AS (SELECT key, cls, count_a, count_b, range_a, range_b, round(a / n1 * 10000, 6) AS rate_a, round(b / n2 * 10000, 6) AS rate_b,
  log2(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n2 + 1))) AS lr, 1.959963984540054 * sqrt(1 / (a + 0.5) - 1 / (n1 + 1) + 1 / (b + 0.5) - 1 / (n2 + 1)) / ln(2) AS w,
  CASE WHEN a * n2 >= b * n1 THEN 2 ELSE -2 END * (CASE WHEN a > 0 THEN a * ln(a / (n1 * (a + b) / (n1 + n2))) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / (n2 * (a + b) / (n1 + n2))) ELSE 0 END
    + CASE WHEN n1 > a THEN (n1 - a) * ln((n1 - a) / (n1 * (n1 + n2 - a - b) / (n1 + n2))) ELSE 0 END + CASE WHEN n2 > b THEN (n2 - b) * ln((n2 - b) / (n2 * (n1 + n2 - a - b) / (n1 + n2))) ELSE 0 END) AS g,
  CASE WHEN count_a > 0 THEN round(greatest(0, least(1, 0.5 * (1 + ma))), 6) END AS dp_a, CASE WHEN count_b > 0 THEN round(greatest(0, least(1, 0.5 * (1 + mb))), 6) END AS dp_b FROM v)
"""
_KEYNESS_OUT = "SELECT key, cls, count_a, count_b, rate_a, rate_b, round(lr, 6) AS log_ratio, round(lr - w, 6) AS lr_low, round(lr + w, 6) AS lr_high, round(g, 6) AS g2, range_a, range_b, dp_a, dp_b FROM keyness"
_register("keyness", _KEYNESS + _KEYNESS_OUT)(lambda c: counts.keyness_table(c, *_english(c)))
_register("keyness_side", _KEYNESS + _KEYNESS_OUT + " WHERE lr > 0 AND count_a + count_b >= 5 AND range_a + range_b >= 3")(lambda c: counts.keyness_table(c, *_english(c), min_count=5, min_docs=3, side="a"))
_register("keyness_page", _KEYNESS + """, kp AS (SELECT keyness.*, type_id, count(*) OVER () AS total FROM keyness JOIN types USING (key))
SELECT key, cls, count_a, count_b, round(lr, 6) AS log_ratio, round(g, 6) AS g2, type_id, total FROM kp ORDER BY lr DESC, g DESC, count_a + count_b DESC, type_id LIMIT 40 OFFSET 20""")(
    lambda c: counts.keyness_page(c, *_english(c), sort="log_ratio", offset=20, limit=40).select("key", "cls", "count_a", "count_b", "log_ratio", "g2", "type_id", "total")
)
_register("keyness_divergence", _KEYNESS + """SELECT round(sum(0.5 * (CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)), 6) AS bits, count(*) AS types
FROM (SELECT a / n1 AS p, b / n2 AS q FROM v)""")(lambda c: counts.divergence(c, *_english(c)))

_UNITS = ", u AS (SELECT doc_id, sent_id, min(pos) AS u_start, count(*) AS length FROM tokens GROUP BY ALL)"
_MATTR = """, mt AS (SELECT doc_id, pos AS i, coalesce(lag(pos) OVER (PARTITION BY doc_id, key ORDER BY pos), -1) AS before, count(*) OVER (PARTITION BY doc_id) AS n FROM tokens),
mattr AS (SELECT doc_id, CASE WHEN max(n) <= 100 THEN (count(*) FILTER (before < 0))::DOUBLE / max(n) ELSE sum(greatest(0, least(i, n - 100) - greatest(before + 1, i - 99, 0) + 1))::DOUBLE / (100 * (max(n) - 99)) END * max(n) / max(n) AS mattr, max(n) <= 100 AS plain_ttr FROM mt GROUP BY 1)"""
_register("mattr", _MATTR + " SELECT doc_id, round(mattr, 6) AS mattr, plain_ttr FROM mattr")(lambda c: counts.mattr(c, 100))
_register("mtld")(counts.mtld)
_register("inventory_docs", _UNITS + _MATTR + """, st AS (SELECT doc_id, count(*) AS sentences, avg(length) AS sm, median(length) AS sd, quantile_disc(length, 0.9) AS p90 FROM u GROUP BY 1),
ct AS (SELECT doc_id, sum(n)::BIGINT AS tokens, coalesce(sum(n) FILTER (cls = 'lexical'), 0)::BIGINT AS lexical, count(*) AS types, count(*) FILTER (n = 1) AS hapax FROM doc_terms GROUP BY 1),
pg AS (SELECT doc_id, count(*) AS paragraphs, avg(length) AS pm FROM (SELECT doc_id, para_id, count(*) AS length FROM tokens GROUP BY ALL) GROUP BY 1)
SELECT doc_id, token_count AS full_tokens, coalesce(tokens, 0) AS tokens, coalesce(lexical, 0) AS lexical, coalesce(types, 0) AS types, coalesce(hapax, 0) AS hapax, coalesce(sentences, 0) AS sentences,
  round(sm, 6) AS sentence_mean, round(sd, 6) AS sentence_median, p90 AS sentence_p90, coalesce(paragraphs, 0) AS paragraphs, round(pm, 6) AS paragraph_mean, round(mattr, 6) AS mattr, plain_ttr, round(types * 1.0 / tokens, 6) AS ttr
FROM docs LEFT JOIN ct USING (doc_id) LEFT JOIN st USING (doc_id) LEFT JOIN pg USING (doc_id) LEFT JOIN mattr USING (doc_id)""")(lambda c: counts.inventory_docs(c))
_register("inventory_totals", """, ty AS (SELECT key, cls, n, length(regexp_replace(key, '[^\\p{L}\\p{Nd}]', '', 'g')) AS c, length(regexp_replace(key, '[^\\p{L}]', '', 'g')) AS l FROM types)
SELECT (SELECT count(*) FROM docs) AS documents, 0::BIGINT AS missing, (SELECT count(*) FROM (SELECT DISTINCT doc_id, sent_id FROM tokens)) AS sentences, (SELECT count(*) FROM (SELECT DISTINCT doc_id, para_id FROM tokens)) AS paragraphs,
  sum(n)::BIGINT AS tokens, (sum(n) FILTER (cls = 'lexical'))::BIGINT AS lexical, count(*) AS types, count(*) FILTER (n = 1) AS hapax, sum(c * n)::BIGINT AS readability_characters, sum(l * n)::BIGINT AS readability_letters,
  (SELECT sum(c) FROM (SELECT max(char_end) - min(char_start) AS c FROM tokens GROUP BY doc_id))::BIGINT AS chars, coalesce(sum(n) FILTER (cls = 'numeral'), 0)::BIGINT AS numeral FROM ty""")(lambda c: counts.inventory_totals(c))
_register("inventory_rhythm", _UNITS + """, w AS (SELECT doc_id, ceil(token_count / 10.0)::BIGINT AS width FROM docs WHERE token_count > 0), f AS (SELECT doc_id, width, unnest(range(10))::INT AS bin FROM w),
s AS (SELECT doc_id, least(9, u_start // width)::INT AS bin, count(*) AS sentences, avg(length) AS mean, median(length) AS median FROM u JOIN w USING (doc_id) GROUP BY ALL),
t AS (SELECT doc_id, least(9, pos // width)::INT AS bin, count(*) AS bin_tokens FROM tokens JOIN w USING (doc_id) GROUP BY ALL)
SELECT doc_id, bin, bin * width AS bin_start, coalesce(bin_tokens, 0) AS bin_tokens, coalesce(sentences, 0) AS sentences, round(mean, 6) AS mean, round(median, 6) AS median FROM f LEFT JOIN s USING (doc_id, bin) LEFT JOIN t USING (doc_id, bin)""")(lambda c: counts.rhythm(c, 10))
_register("collocates", """, p AS (SELECT DISTINCT doc_id, sent_id, lower(key) AS word FROM tokens WHERE cls = 'lexical'), a AS (SELECT doc_id, sent_id FROM p WHERE word = 'the'),
b AS (SELECT word, count(*) AS together FROM p JOIN a USING (doc_id, sent_id) WHERE word <> 'the' GROUP BY 1 HAVING count(*) >= 5), y AS (SELECT word, count(*) AS y FROM p GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM (SELECT DISTINCT doc_id, sent_id FROM tokens)) AS n)
SELECT word, together, x, y, round(14 + log2(2.0 * together / (x + y)), 6) AS log_dice, round(log2(together::DOUBLE * n / (x::DOUBLE * y)), 6) AS pmi, round((together - x::DOUBLE * y / n) / sqrt(together), 6) AS t FROM b JOIN y USING (word), n""")(lambda c: counts.collocates(c, "the", 5))
_register("compare_profile", _UNITS + _MATTR + """, s AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'a' ELSE 'b' END AS side FROM documents),
ty AS (SELECT side, key, sum(n) AS n FROM doc_terms JOIN s USING (doc_id) GROUP BY ALL), tt AS (SELECT side, count(*) AS types, count(*) FILTER (n = 1) AS hapax, sum(length(regexp_replace(key, '[^\\p{L}\\p{Nd}]', '', 'g')) * n) AS chars FROM ty GROUP BY 1),
d AS (SELECT side, sum(token_count)::BIGINT AS tokens FROM docs JOIN s USING (doc_id) GROUP BY 1), se AS (SELECT side, count(*) AS sentences FROM u JOIN s USING (doc_id) GROUP BY 1),
pa AS (SELECT side, count(*) AS paragraphs FROM (SELECT DISTINCT doc_id, para_id FROM tokens) JOIN s USING (doc_id) GROUP BY 1),
ma AS (SELECT side, sum(mattr * token_count) / sum(token_count) AS mattr FROM mattr JOIN docs USING (doc_id) JOIN s USING (doc_id) WHERE NOT plain_ttr GROUP BY 1)
SELECT side, tokens, types, sentences, paragraphs, round(mattr, 6) AS mattr, round(hapax * 1000.0 / types, 6) AS hapax_per_1k, round(tokens * 1.0 / sentences, 6) AS tokens_per_sentence, round(tokens * 1.0 / paragraphs, 6) AS tokens_per_paragraph,
  round(4.71 * chars / tokens + 0.5 * tokens / sentences - 21.43, 6) AS ari FROM d JOIN tt USING (side) JOIN se USING (side) JOIN pa USING (side) LEFT JOIN ma USING (side)""")(
    lambda c: counts.compare_profile(c, c.documents.select("doc_id", F.when(F.col("lang") == "en", "a").otherwise("b").alias("side")))
)

# ---- occurrences -----------------------------------------------------------------------------------------------------

_plain = lambda d: d.select("doc_id", "pos", "span", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))
_one = "SELECT doc_id, pos, 1 AS span, '0' AS members FROM tokens WHERE "
_PHRASE = """, nb AS (SELECT doc_id, pos, f, lead(f) OVER w AS f1, lag(f) OVER w AS f0, lead(sent_id) OVER w = sent_id AS same1, lag(sent_id) OVER w = sent_id AS same0 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ph AS (SELECT doc_id, pos FROM nb WHERE f = 'of' AND f1 = 'the' AND same1)"""
_register("match_token", _one + "f = 'the'")(lambda c: _plain(terms.occurrences(c, terms.group("the"))))
_register("match_exact", _one + "key = 'The'")(lambda c: _plain(terms.occurrences(c, terms.group("The", exact=True))))
_register("match_prefix", _one + "starts_with(f, 'th')")(lambda c: _plain(terms.occurrences(c, terms.group("th*"))))
_register("match_suffix", _one + "ends_with(f, 'tion')")(lambda c: _plain(terms.occurrences(c, terms.group("*tion"))))
_register("match_phrase", _PHRASE + " SELECT doc_id, pos, 2 AS span, '0' AS members FROM ph")(lambda c: _plain(terms.occurrences(c, terms.group("of the"))))
_register("match_ranged", _PHRASE + " SELECT doc_id, pos, 2 AS span, '0' AS members FROM ph JOIN runs USING (doc_id) WHERE pos >= r_start AND pos + 2 <= r_end")(lambda c: _plain(terms.occurrences(c, terms.group("of the"), _runs(c))))
_register("match_union", _PHRASE + """ SELECT doc_id, pos, 2 AS span, '0,1' AS members FROM ph UNION ALL SELECT doc_id, pos, 1, '1' FROM nb WHERE f = 'the' AND NOT coalesce(f0 = 'of' AND same0, false)""")(
    lambda c: _plain(terms.occurrences(c, terms.group("of the", "the")))
)
_register("match_raw", _PHRASE + " SELECT doc_id, pos, 2 AS span, '0' AS members FROM ph UNION ALL SELECT doc_id, pos, 1, '1' FROM tokens WHERE f = 'the'")(lambda c: _plain(terms.occurrences(c, terms.group("of the", "the", count_overlaps=True))))

_TREND = """, sh AS (SELECT doc_id, token_count, seq_base, {width} AS width, {n} AS n_bins FROM docs WHERE token_count > 0),
fr AS (SELECT *, bin * width AS bin_start, least(bin * width + width, token_count) AS bin_end FROM (SELECT *, unnest(range(n_bins)) AS bin FROM sh)),
cn AS (SELECT track, doc_id, least(n_bins - 1, pos // width) AS bin, count(*) AS count FROM occ JOIN sh USING (doc_id) GROUP BY ALL),
trend AS (SELECT track, fr.doc_id, fr.bin, bin_start, greatest(0, bin_end - bin_start) AS bin_tokens, coalesce(count, 0) AS count, seq_base, token_count AS doc_tokens
  FROM fr CROSS JOIN (VALUES (0), (1), (2)) tr(track) LEFT JOIN cn USING (track, doc_id, bin)), rated AS (SELECT *, CASE WHEN bin_tokens = 0 THEN 0 ELSE count * 10000.0 / bin_tokens END AS rate FROM trend)
"""
_BINS = _TREND.format(width="ceil(token_count / 8.0)::BIGINT", n="8::BIGINT")
_TREND_OUT = "SELECT track, doc_id, bin, bin_start, bin_tokens, count, round(rate, 6) AS rate_per_10k, seq_base, doc_tokens FROM rated"
_register("trend_bins", _BINS + _TREND_OUT)(lambda c: bins.trend(c, _occ3(c), 3, bins=8))
_register("trend_tokens", _TREND.format(width="250::BIGINT", n="ceil(token_count / 250.0)::BIGINT") + _TREND_OUT)(lambda c: bins.trend(c, _occ3(c), 3, width=250))
_register("trend_ranged", """, oc AS (SELECT o.* FROM occ o JOIN runs USING (doc_id) WHERE pos >= r_start AND pos < r_end), sh AS (SELECT doc_id, token_count, ceil(token_count / 8.0)::BIGINT AS width FROM docs WHERE token_count >= 40),
fr AS (SELECT *, bin * width AS bin_start, least(bin * width + width, token_count) AS bin_end FROM (SELECT *, unnest(range(8)) AS bin FROM sh)),
bt AS (SELECT fr.doc_id, bin, sum(greatest(0, least(bin_end, r_end) - greatest(bin_start, r_start)))::BIGINT AS bin_tokens FROM fr JOIN runs USING (doc_id) GROUP BY ALL),
cn AS (SELECT track, doc_id, least(7, pos // width) AS bin, count(*) AS count FROM oc JOIN sh USING (doc_id) GROUP BY ALL)
SELECT track, bt.doc_id, bt.bin, bin_tokens, coalesce(count, 0) AS count FROM bt CROSS JOIN (VALUES (0), (1), (2)) tr(track) LEFT JOIN cn USING (track, doc_id, bin)""")(
    lambda c: bins.trend(c, terms.tracks(c, [terms.group("the"), terms.group("of")], _runs(c)), 3, bins=8, runs=_runs(c)).select("track", "doc_id", "bin", "bin_tokens", "count")
)
_register("trend_smoothed", _BINS + """SELECT track, doc_id, bin, round(CASE WHEN bin_tokens > 0 THEN CASE WHEN count(*) FILTER (bin_tokens > 0) OVER w >= 3 THEN sum(rate * bin_tokens) OVER w / sum(bin_tokens) OVER w ELSE rate END END, 6) AS smoothed
FROM rated WINDOW w AS (PARTITION BY track, doc_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")(lambda c: bins.smooth(bins.trend(c, _occ3(c), 3, bins=8), 5).select("track", "doc_id", "bin", "smoothed"))
_register("book_totals", _BINS + "SELECT track, doc_id, sum(count)::BIGINT AS count, sum(bin_tokens)::BIGINT AS tokens, round(sum(count) * 10000.0 / sum(bin_tokens), 6) AS rate_per_10k FROM rated GROUP BY 1, 2")(lambda c: bins.book_totals(bins.trend(c, _occ3(c), 3, bins=8)))
_register("catalog_totals", _BINS + "SELECT track, coalesce(doc_id, -1) AS doc_id, sum(count)::BIGINT AS count, sum(bin_tokens)::BIGINT AS tokens, round(sum(count) * 10000.0 / sum(bin_tokens), 6) AS rate_per_10k FROM rated GROUP BY GROUPING SETS ((track, doc_id), (track))")(
    lambda c: bins.catalog_totals(bins.trend(c, _occ3(c), 3, bins=8)).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1).cast("long")))
)
_register("range_compare", """, t AS (SELECT sum(token_count) AS tokens FROM docs), i AS (SELECT sum(r_end - r_start) AS tokens_in FROM runs),
h AS (SELECT track, count(occ.doc_id) AS hits, count(r_start) AS hits_in FROM (VALUES (0), (1), (2)) tr(track) LEFT JOIN occ USING (track) LEFT JOIN runs ON runs.doc_id = occ.doc_id AND pos >= r_start AND pos < r_end GROUP BY 1)
SELECT track, hits_in, tokens_in::BIGINT AS tokens_in, hits - hits_in AS hits_out, (tokens - tokens_in)::BIGINT AS tokens_out,
  CASE WHEN hits > 0 THEN round((hits_in::DOUBLE / tokens_in - (hits - hits_in)::DOUBLE / (tokens - tokens_in)) / (hits_in::DOUBLE / tokens_in + (hits - hits_in)::DOUBLE / (tokens - tokens_in)), 6) END AS contrast,
  CASE WHEN hits > 0 THEN round(hits::DOUBLE / tokens * least(tokens_in, tokens - tokens_in), 6) END AS expected_min, CASE WHEN hits > 0 THEN hits::DOUBLE / tokens * least(tokens_in, tokens - tokens_in) >= 5 END AS evidenced,
  CASE WHEN hits = 0 THEN 'no-occurrences' END AS undefined FROM h, t, i""")(lambda c: bins.range_compare(c, _occ3(c), 3, _runs(c)))
_register("dispersion_exact", "SELECT * FROM occ WHERE track IN (SELECT track FROM occ GROUP BY 1 HAVING count(*) <= 50000)")(lambda c: bins.dispersion_exact(_occ(c)))
_register("dispersion_density")(lambda c: bins.dispersion_density(c, _occ(c)))
_register("dispersion_by_document", """, b AS (SELECT track, doc_id, ((pos + 1) * 1 - 1) // token_count AS bucket FROM occ JOIN docs USING (doc_id)), n AS (SELECT track, doc_id, bucket, count(*) AS count FROM b GROUP BY ALL)
SELECT track, doc_id, bucket, 0::BIGINT AS bucket_start, count, round(count::DOUBLE / max(count) OVER (PARTITION BY track), 6) AS intensity FROM n""")(lambda c: bins.dispersion_density(c, _occ(c), budget=1))
_NEAREST = """, nr AS (SELECT a.track, p.peer, a.doc_id, a.pos, max(b.pos + b.span) FILTER (b.pos < a.pos) AS prior, min(b.pos) FILTER (b.pos >= a.pos) AS next
  FROM occ a CROSS JOIN (VALUES (0), (1), (2)) p(peer) LEFT JOIN occ b ON b.track = p.peer AND b.doc_id = a.doc_id WHERE p.peer <> a.track GROUP BY ALL),
g AS (SELECT *, coalesce(prior > pos, false) OR coalesce(next < pos + 1, false) AS over, pos - prior AS back, next - pos - 1 AS ahead FROM nr),
w AS (SELECT track, peer, doc_id, pos, CASE WHEN over THEN 0 ELSE least(back, ahead) END AS gap, CASE WHEN over THEN 'overlap' WHEN back IS NULL AND ahead IS NULL THEN 'none' WHEN back = ahead THEN 'tied' WHEN ahead IS NULL OR back < ahead THEN 'backward' ELSE 'forward' END AS way FROM g),
co AS (SELECT *, (SELECT max(e) FROM (VALUES (0), (1), (2), (3), (4), (5), (7), (10), (15), (25), (50), (100), (200)) x(e) WHERE e <= gap) AS bucket_edge FROM w)
"""
_register("company", _NEAREST + """SELECT track, peer, coalesce(bucket_edge, -1) AS bucket_edge, count(*) AS n, count(*) FILTER (way = 'forward') AS forward, count(*) FILTER (way = 'backward') AS backward, count(*) FILTER (way = 'tied') AS tied,
  count(*) FILTER (way = 'overlap') AS overlap, count(*) FILTER (way = 'none') AS "none" FROM co GROUP BY 1, 2, 3""")(lambda c: proximity.company(_occ3(c), 3).withColumn("bucket_edge", F.coalesce("bucket_edge", F.lit(-1))))
_register("company_docs", "SELECT x.track, y.track AS peer, (SELECT count(*) FROM (SELECT doc_id FROM occ WHERE track IN (x.track, y.track) GROUP BY 1 HAVING count(DISTINCT track) = 2)) AS docs_with_both FROM (VALUES (0), (1), (2)) x(track), (VALUES (0), (1), (2)) y(track) WHERE x.track < y.track")(lambda c: proximity.docs_with_both(_occ3(c), 3))
_register("company_tracks", "SELECT track, count(occ.doc_id) AS total, count(DISTINCT doc_id) AS doc_count FROM (VALUES (0), (1), (2)) tr(track) LEFT JOIN occ USING (track) GROUP BY 1")(lambda c: proximity.company_tracks(c, _occ3(c), 3))
_register("company_pairs", _NEAREST + """, s AS (SELECT track, peer, count(*) FILTER (way = 'forward') AS forward, count(*) FILTER (way = 'backward') AS backward, count(*) FILTER (way = 'tied') AS tied, count(*) FILTER (way = 'overlap') AS overlap, count(*) FILTER (way = 'none') AS "none" FROM w GROUP BY 1, 2),
pr AS (SELECT x.track, y.track AS peer FROM (VALUES (0), (1), (2)) x(track), (VALUES (0), (1), (2)) y(track) WHERE x.track < y.track), bo AS (SELECT count(*) AS n FROM (SELECT doc_id FROM occ GROUP BY 1 HAVING count(DISTINCT track) = 2))
SELECT pr.track, pr.peer, CASE WHEN pr.peer = 1 THEN n ELSE 0 END AS docs_with_both, """ + ", ".join(f'coalesce(a."{w}", 0) AS "{w}", coalesce(b."{w}", 0) AS {w}_back' for w in ("forward", "backward", "tied", "overlap", "none")) + """
FROM pr LEFT JOIN s a ON a.track = pr.track AND a.peer = pr.peer LEFT JOIN s b ON b.track = pr.peer AND b.peer = pr.track, bo""")(lambda c: proximity.company_pairs(_occ3(c), 3))
_register("company_coverage", _NEAREST + """, cv AS (SELECT track, count(*) FILTER (gap < 25) * 1.0 / count(*) AS c FROM co WHERE peer < 2 GROUP BY 1)
SELECT 0 AS track, 1 AS peer, round(a.c, 6) AS coverage, round(b.c, 6) AS coverage_back, (SELECT count(*) FROM (SELECT doc_id FROM occ GROUP BY 1 HAVING count(DISTINCT track) = 2)) AS docs_with_both, round(least(a.c, b.c), 6) AS mutual
FROM cv a, cv b WHERE a.track = 0 AND b.track = 1""")(lambda c: proximity.company_coverage(_occ3(c), 3))
_register("destinations")(lambda c: proximity.destinations(c, _occ(c), 2).drop("counts"))
_register("destination_snippets")(lambda c: proximity.snippets(c, proximity.destinations(c, _occ(c), 2, focus=(0, 1))).drop("counts"))
_register("destination_marks")(lambda c: proximity.snippet_marks(proximity.snippets(c, proximity.destinations(c, _occ(c), 2)), _occ(c)))
_RANKED = ", rk AS (SELECT track, doc_id, pos, span, seq_base + pos AS g, row_number() OVER (ORDER BY doc_id, pos, span, track) - 1 AS rank FROM occ JOIN docs USING (doc_id))"
_register("matches_rank", _RANKED + " SELECT track, doc_id, pos, g AS \"global\", rank FROM rk")(lambda c: navigate.ranked(c, _occ(c)).select("track", "doc_id", "pos", "global", "rank"))
_register("sparse_axis", _RANKED + """, rn AS (SELECT g, min(rank) AS rank FROM rk GROUP BY 1)
SELECT rank, g AS "global" FROM rn WHERE rank % 128 = 0""")(lambda c: navigate.sparse_axis(c, _occ(c)))
_register("matches_window", _RANKED + """, pg AS (SELECT * FROM rk WHERE rank BETWEEN 100 AND 149),
ch AS (SELECT rank, track, pg.doc_id, pg.pos, span, min(char_start) AS c0, min(char_start) FILTER (t.pos = pg.pos) AS c1, max(char_end) FILTER (t.pos = pg.pos) AS c2, max(char_end) AS c3 FROM pg JOIN tokens t ON t.doc_id = pg.doc_id AND t.pos BETWEEN pg.pos - 10 AND pg.pos + 10 GROUP BY ALL)
SELECT rank, track, doc_id, pos, span, substr(text, (c0 + 1)::BIGINT, c1 - c0) AS "left", substr(text, (c1 + 1)::BIGINT, c2 - c1) AS node, substr(text, (c2 + 1)::BIGINT, c3 - c2) AS "right" FROM ch JOIN documents USING (doc_id)""")(lambda c: navigate.matches_window(c, _occ(c), 100, 50).drop("members"))
_register("matches_context_marks", _RANKED + """, pg AS MATERIALIZED (SELECT * FROM rk WHERE rank BETWEEN 100 AND 149), oc AS MATERIALIZED (SELECT * FROM occ WHERE doc_id IN (SELECT doc_id FROM pg)) SELECT pg.rank, o.track AS other, o.doc_id, o.pos, o.span, CASE WHEN o.pos < pg.pos THEN 'left' ELSE 'right' END AS side
FROM pg JOIN oc o ON o.doc_id = pg.doc_id AND o.track <> pg.track AND o.pos < pg.pos + 11 AND o.pos + 1 > pg.pos - 10""")(lambda c: navigate.context_marks(navigate.ranked(c, _occ(c)).filter("rank between 100 and 149").select("rank", "track", "doc_id", "pos", "span"), _occ(c), 10).drop("truncated"))
_STEP = """, g AS (SELECT occ.*, seq_base + pos AS g FROM occ JOIN docs USING (doc_id)), h AS (SELECT seq_base + 3 AS h FROM docs WHERE doc_id = 5) SELECT doc_id, pos, max(span) AS span, min(track) AS track, false AS at_edge FROM g WHERE g = """
_step = lambda way: lambda c: navigate.occurrence_step(c, _occ(c), 5, 3, way).drop("members")
_register("occurrence_next", _STEP + "(SELECT min(g) FROM g, h WHERE g > h) GROUP BY 1, 2")(_step(1))
_register("occurrence_previous", _STEP + "(SELECT max(g) FROM g, h WHERE g < h) GROUP BY 1, 2")(_step(-1))
_register("reader_page", """, p AS (SELECT * FROM tokens WHERE doc_id = 7 AND pos >= 10 AND pos < 30) SELECT doc_id, 10::BIGINT AS start, max(pos) + 1 AS "end", substr(text, (min(char_start) + 1)::BIGINT, max(char_end) - min(char_start)) AS text, false AS at_start, max(pos) + 1 = any_value(token_count) AS at_end,
CASE WHEN max(pos) + 1 < any_value(token_count) THEN 'tokens' END AS capped_by FROM p JOIN documents USING (doc_id) JOIN docs USING (doc_id) GROUP BY doc_id, text""")(lambda c: navigate.reader_page(c, 7, "from", 10, 20).drop("spans", "previous", "next"))
_register("marks", "SELECT track, doc_id, pos AS t0, pos + 1 AS t1, char_start, char_end FROM occ JOIN tokens USING (doc_id, pos) WHERE doc_id = 7 AND pos < 200")(lambda c: navigate.marks(c, _occ(c), 7, 0, 200).drop("clipped_start", "clipped_end"))

# ---- sources ---------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _named():
    """File names of pages: their addresses, most with a suffix, by length."""
    suffix = F.element_at(F.array(*map(F.lit, (".HTML", ".md", ".TXT", ".epub", ".pdf", "", ""))), (F.length("url") % 7 + 1).cast("int"))
    return F.concat("url", suffix)


def _replaced(column: str) -> str:
    for pattern, new in files.HTML_LITE:
        column = f"regexp_replace({column}, '{_q(pattern)}', '{_q(new)}', 'g')"
    return column.replace("\n", "' || chr(10) || '")


_table("html_lite", lambda s, d: _pages(s, d).select("page_id", files.html_lite(F.col("html")).alias("text")), f"SELECT page_id, {_replaced('html')} AS text FROM pages")
_table("html_text", lambda s, d: files.extract_html(_pages(s, d).select("page_id", "html")).select("page_id", "title", "extracted"), None)
_table("source_format", lambda s, d: _pages(s, d).select("page_id", _named().alias("name")).select("page_id", files.format_of(F.col("name")).alias("format"), files.strip_suffix(F.col("name")).alias("stem")), """SELECT page_id, CASE WHEN regexp_matches(name, '(?i)\\.(html?|xhtml)$') THEN 'html' WHEN regexp_matches(name, '(?i)\\.(md|markdown)$') THEN 'md' WHEN regexp_matches(name, '(?i)\\.txt$') THEN 'txt' WHEN regexp_matches(name, '(?i)\\.epub$') THEN 'epub' END AS format,
regexp_replace(name, '(?i)\\.(txt|markdown|md|epub|xhtml|html|htm)$', '') AS stem FROM (SELECT page_id, url || CASE WHEN length(url) % 7 < 5 THEN list_extract(['.HTML', '.md', '.TXT', '.epub', '.pdf'], (length(url) % 7 + 1)::INT) ELSE '' END AS name FROM pages)""")
_table("source_decode", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", files.decode(F.encode("text", "UTF-8")).alias("text"), files.decode(F.concat(F.lit(bytearray(b"\xfe\xff")), F.encode("text", "UTF-16BE"))).alias("wide"), files.suspicious_controls(F.col("text")).cast("long").alias("controls")),
       "SELECT doc_id, text, text AS wide, len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]'))::BIGINT AS controls FROM documents")
_table("library_keys", lambda s, d: files.library(s.read.parquet(f"{d}/documents.parquet").select(F.format_string("%012d.txt", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))).select("key", F.substring_index("path", ".", 1).cast("long").alias("doc_id")), "SELECT 'txt:' || sha256(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
_table("tsv_rows", lambda s, d: files.tsv_rows(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")), "SELECT doc_id || chr(9) || lang || chr(9) || regexp_replace(text, '[\\t\\r\\n]', ' ', 'g') AS line FROM documents")
