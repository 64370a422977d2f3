"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every version of every path is addressed by the SHA-256 of its text. A blob is scanned once per rule
version: pairs that the ledger already has are left alone, and findings are joined back to all paths
that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh_path, materialise, path_exists, text_or_empty, unused_names


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are spans; ``least`` is the shortest length of ``group`` that counts."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    revision: int = 1

    @property
    def version(self) -> str:
        return f"{self.kind}/{self.revision}"


#: The base rules, in the order in which spans of one start are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of hexadecimal digits are maximal, so the least length can stand in the pattern.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What this method adds to them.
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _no_spans() -> Column:
    return F.array().cast(SPANS)


def _spans(rule: Rule, rank: int, text: Column, found: Column) -> Column:
    """Spans of ``found`` (the whole matches in ``text``) in code points: lengths of what lies between, summed."""
    between = F.split(text, rule.pattern, -1)
    sized = F.transform(found, lambda x: F.length(x))
    counted = sized if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x))
    steps = F.arrays_zip(
        F.transform(F.slice(between, 1, F.size(found)), lambda x: F.length(x)).alias("gap"), sized.alias("size"), counted.alias("counted")
    )

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(x["counted"] >= rule.least, F.array(span)).otherwise(_no_spans())
        return F.struct(end.alias("at"), F.concat(acc["out"], kept).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), _no_spans().alias("out"))
    return F.aggregate(steps, zero, add, lambda acc: acc["out"])


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, seen: str | None = None) -> DataFrame:
    """(blob, found) of ``blobs`` (blob, text and perhaps ``seen``, the rule versions done): the other rules' spans by rule version."""
    out = blobs
    for i, r in enumerate(rules):
        hit = F.regexp_extract_all(F.col("text"), F.lit(r.pattern), F.lit(0))
        if seen:
            hit = F.when(~F.array_contains(seen, r.version), hit)
        out = out.withColumn(f"m{i}", hit)
    pairs = [
        F.struct(
            F.lit(r.version).alias("rule_version"),
            F.when(F.size(f"m{i}") > 0, _spans(r, i, F.col("text"), F.col(f"m{i}"))).when(F.col(f"m{i}").isNotNull(), _no_spans()).alias("spans"),
        )
        for i, r in enumerate(rules)
    ]
    return out.select("blob", F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["spans"].isNotNull())).alias("found"))


def address(versions: DataFrame, text: str, blob: str = "blob") -> DataFrame:
    return versions.withColumn(blob, F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256)))


def update_ledger(versions: DataFrame, text: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What a ledger gains from ``versions``: rows (blob, found) with the pairs of blob and rule version not scanned before.

    ``found`` maps a rule version to its spans; pairs without findings have empty ones, so that they are not
    scanned again. Null texts are the empty blob; repeated texts are one blob; an empty table adds nothing.
    """
    # One row of each text leaves a map task, so a text that a third of all rows repeat is no hot key.
    blobs = versions.select(text_or_empty(text).alias("text")).transform(lambda d: address(d, "text")).dropDuplicates(["blob"])
    if ledger is None:
        return scan_blobs(blobs, rules)
    done = ledger.select("blob", F.explode(F.map_keys("found")).alias("v")).groupBy("blob").agg(F.collect_set("v").alias("seen"))
    blobs = blobs.join(done, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    every = F.array(*[F.lit(r.version) for r in rules])
    return scan_blobs(blobs.filter(F.size(F.array_except(every, "seen")) > 0), rules, "seen")


LEDGER = f"blob binary, found map<string, {SPANS}>"


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger below ``folder``, None if nothing has been written there."""
    return spark.read.schema(LEDGER).parquet(folder) if path_exists(spark, folder) else None


def find_secrets(versions: DataFrame, text: str, folder: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` (paths at any time) with ``secrets``, the spans of its text.

    Spans are structs (start, rank, end, kind) in code points, end exclusive, sorted by start and then by
    the order of ``rules``. The ledger below ``folder`` (a new one in the shared folder if None) first gains
    the pairs of blob and rule version that it lacks, which alone are scanned; findings are then joined back
    from it. Null and empty texts have none. Rows come back as they are, repeated ones too; a column of the
    name ``secrets`` in the input makes the new one ``secrets_``.
    """
    spark = versions.sparkSession
    folder = folder or fresh_path(spark, "ledger")
    update_ledger(versions, text, read_ledger(spark, folder), rules).write.mode("append").parquet(folder)
    versions_of = {r.version: i for i, r in enumerate(rules)}
    pairs = read_ledger(spark, folder).select("blob", F.explode("found").alias("rule_version", "spans"))
    pairs = pairs.filter((F.size("spans") > 0) & F.col("rule_version").isin(list(versions_of)))
    # Ranks by this call's order of rules, whatever it was when the blob was scanned.
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in versions_of.items() for x in pair]), F.col("rule_version"))
    ranked = pairs.select("blob", F.transform("spans", lambda x: x.withField("rank", rank)).alias("spans"))
    blob, secrets, key = unused_names(versions, "blob", "secrets", "blob_of_finding")
    # A blob has as many pairs as there are rules, which bounds the list.
    found = ranked.groupBy(F.col("blob").alias(key)).agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias(secrets))
    # Written, so that the join reads two plain shuffles, whose hot keys adaptive execution splits.
    found = materialise(found, "findings")
    joined = address(versions, text, blob).join(found, F.col(blob) == F.col(key), "left")
    return joined.drop(key, blob).withColumn(secrets, F.coalesce(secrets, _no_spans()))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(df: DataFrame, text: str, secrets: str, mark: str = "[secret]") -> DataFrame:
    """``text`` with every stretch that spans cover (touching ones are one) replaced by ``mark``."""

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["start"] <= F.get(acc, F.size(acc) - 1)["end"])
        one = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end")))
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end")))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.concat(acc, one))

    pieces = F.array().cast("array<struct<start:int,end:int>>")

    def cut(acc: Column, x: Column) -> Column:
        kept = F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], kept, F.lit(mark)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.aggregate(F.col(secrets), pieces, merge), start, cut, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    return df.withColumn(text, F.when(F.size(secrets) > 0, done).otherwise(F.col(text)))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of every row of ``documents`` through a ledger of its own; null texts have none, repeated rows stay."""
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"), "text").select("doc_id", "secrets")
    base = F.filter("secrets", lambda x: x["rank"] < len(BASE_RULES))
    count = lambda i: F.size(F.filter("secrets", lambda x: x["rank"] == i)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''").replace(r"\x20", " ")
        size = f"regexp_extract_all(body, '{pattern}', {r.group})[j]" if r.group else "m"
        parts.append(f"""
  SELECT body, {i} AS rank, '{r.kind}' AS kind, span.s AS s, span.s + length(span.m) AS e FROM (
    SELECT body, unnest(list_transform(range(1, len(found) + 1), lambda j: {{
      's': list_sum(list_transform(gaps[1:j], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:j - 1], lambda f: length(f))), 0),
      'm': found[j], 'k': {size.replace('m', 'found[j]') if not r.group else size}}})) AS span
    FROM (SELECT body, regexp_extract_all(body, '{pattern}') AS found, string_split_regex(body, '{pattern}') AS gaps FROM bodies)
  ) WHERE length(span.k) >= {r.least}""")
    return f"""
WITH bodies AS (SELECT DISTINCT coalesce(text, '') AS body FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
found AS (
  SELECT body, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (rank < {len(BASE_RULES)}) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY body
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN found ON coalesce(text, '') = body
"""


QUERIES = {"op9_secrets": op9_secrets}
ORACLES = {"op9_secrets": _oracle()}
