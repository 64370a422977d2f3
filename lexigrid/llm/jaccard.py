"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Texts with equal sets of word shingles are one class. Classes that share a band of MinHash values are
candidates; within a component of candidates MinHash values are compared a group at a time, and a pair is
dropped as soon as the posterior probability that it reaches the threshold falls below a tolerance. What
is left is verified on the shingles. Pairs are counted inside the tasks and never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, small_arrow_batches, unused_names
from .components import components
from .words import ALNUM, Words, mix, split_words, windows

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values, those in a band, and those compared between two looks at the posterior.
HASHES, BAND, LOOK = 128, 4, 32
#: Posterior probability below which a pair is dropped.
TOLERANCE = 1e-7
#: Classes of a component that one task compares with as many others.
BLOCK = 512

_RNG = np.random.Generator(np.random.PCG64(7))
_FACTORS = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and the number of each text.

    Words are runs of letters and digits, A-Z lower-cased. A text of fewer than ``n`` words has one shingle,
    all of them; a text without words none.
    """
    words: Words = split_words(texts, ALNUM, True)
    h, ok = windows(words, n)
    text = np.repeat(np.arange(len(texts)), words.counts)
    few = np.flatnonzero((words.counts > 0) & (words.counts < n))
    firsts, short = words.firsts, []
    for t in few:
        acc = np.uint64(words.counts[t])
        with np.errstate(over="ignore"):
            for w in words.hashes[firsts[t] : firsts[t + 1]]:
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + w
        short.append(acc)
    text = np.concatenate([text[ok], few])
    h = np.concatenate([h[ok], np.array(short, np.uint64)])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], np.bincount(text[keep], minlength=len(texts))


def describe(h: np.ndarray, counts: np.ndarray, signatures: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """For each text that has shingles: 16 bytes that name its set, and its MinHash values."""
    some = counts > 0
    starts = (np.cumsum(counts) - counts)[some]
    if not len(starts):
        return np.empty((0, 2), np.uint64), np.empty((0, HASHES), np.uint32)
    name = np.stack([np.add.reduceat(mix(h), starts), np.add.reduceat(mix(h ^ np.uint64(0x5BD1E995)), starts)], 1)
    sig = np.empty((len(starts), HASHES if signatures else 0), np.uint32)
    # Some texts at a time, so that the arrays stay in the processor's cache.
    ends = np.append(starts[1:], len(h))
    at = 0
    while signatures and at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + 50_000, "right")))
        part, begins = h[starts[at] : ends[stop - 1]], starts[at:stop] - starts[at]
        for k in range(HASHES):
            sig[at:stop, k] = np.minimum.reduceat(((part * _FACTORS[k] + _ADDENDS[k]) >> np.uint64(32)).astype(np.uint32), begins)
        at = stop
    return name, sig


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches with which the threshold is still likelier than ``tolerance``).

    The prior is uniform, so after m of k matches P(J >= t) is the chance of m or fewer successes of k + 1
    at rate t.
    """
    out = []
    for k in range(LOOK, HASHES + 1, LOOK):
        chance, total, m = (1 - threshold) ** (k + 1), 0.0, 0
        while True:
            total += chance
            if total >= tolerance:
                break
            chance *= (k + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        out.append((k, m))
    return out


def likely_pairs(a: np.ndarray, b: np.ndarray, same: bool, looks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (MinHash values) that no look at the posterior dropped; x < y if both are the ``same``."""
    left, right = [], []
    first, least = looks[0]
    rows = max(1, (1 << 22) // max(1, len(b) * first))
    for s in range(0, len(a), rows):
        found = (a[s : s + rows, None, :first] == b[None, :, :first]).sum(2, dtype=np.int16) >= least
        x, y = np.nonzero(found)
        x = x + s
        if same:
            x, y = x[x < y], y[x < y]
        for k, m in looks[1:]:
            ok = np.zeros(len(x), bool)
            for c in range(0, len(x), 1 << 15):
                p, q = x[c : c + (1 << 15)], y[c : c + (1 << 15)]
                ok[c : c + (1 << 15)] = (a[p, :k] == b[q, :k]).sum(1) >= m
            x, y = x[ok], y[ok]
        left.append(x)
        right.append(y)
    return np.concatenate(left or [np.empty(0, np.int64)]), np.concatenate(right or [np.empty(0, np.int64)])


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x and y (sorted hashes), pair by pair."""
    used = np.unique(np.concatenate([x, y]))
    if len(x) * 12 < len(used) ** 2 // 2 or len(used) < 24:
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
    # Many pairs of few sets: products of incidence matrices, some shingles at a time.
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    names, column, times = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    owner, column = owner[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for c in range(0, int(rank[-1]) + 1, 2048):
        lo, hi = np.searchsorted(column, [c, c + 2048])
        part = np.zeros((len(used), 2048), np.float32)
        part[owner[lo:hi], column[lo:hi] - c] = 1
        total += part @ part.T
    return total[place[x], place[y]].astype(np.int64)


def _compare(pdf: pd.DataFrame, threshold: float, looks: list[tuple[int, int]]) -> pd.DataFrame:
    """The links that one task finds: for each class the documents it links to and the smallest class it hangs together with."""
    pdf = pdf.drop_duplicates("c").sort_values("c", kind="stable").reset_index(drop=True)
    names, copies = pdf["c"].tolist(), pdf["copies"].to_numpy()
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), HASHES)
    sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
    size = np.array([len(s) for s in sets])
    lower = pdf["block"].to_numpy() == pdf["i"].to_numpy()
    if bool((pdf["i"] == pdf["j"]).all()):
        x, y = likely_pairs(sig, sig, True, looks)
    else:
        p, q = np.flatnonzero(lower), np.flatnonzero(~lower)
        x, y = likely_pairs(sig[p], sig[q], False, looks)
        x, y = p[x], q[y]
    if len(x):
        most = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9
        x, y = x[most], y[most]
    if len(x):
        both = overlaps(sets, x, y)
        good = both >= threshold * (size[x] + size[y] - both) - 1e-9
        x, y = x[good], y[good]
    links = np.bincount(x, copies[y], len(pdf)) + np.bincount(y, copies[x], len(pdf))
    root = np.arange(len(pdf))
    while True:  # the smallest neighbour's root, until nothing changes
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked = np.flatnonzero(links > 0)
    return pd.DataFrame({"c": [names[k] for k in linked], "links": links[linked].astype(np.int64), "root": [names[root[k]] for k in linked]})


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``df``: doc_id, c (name of its shingle set, null without words), n_links, copy_of and class_id.

    n_links counts the other rows whose Jaccard similarity is ``threshold`` or more, copies included;
    copy_of is the smallest doc_id of the same set, class_id that of the whole group that links hold
    together. Rows whose text is null, empty or without words link to nothing and are classes of
    their own. A null doc_id sorts behind all others; repeated rows are copies of each other.
    """
    spark = df.sparkSession
    small_arrow_batches(spark)
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, counts = shingle_sets(list(pdf["body"]))
            name, sig = describe(h, counts)
            some = counts > 0
            out = pdf[["id"]].copy()
            out["c"], out["sig"] = None, None
            places = np.flatnonzero(some)
            c, s = np.full(len(pdf), None, object), np.full(len(pdf), None, object)
            for k, p in enumerate(places):
                c[p], s[p] = name[k].tobytes(), sig[k].tobytes()
            out["c"], out["sig"] = c, s
            yield out

    signed = materialise(docs.mapInPandas(sign, f"id {kind}, c binary, sig binary"), "signatures")
    classes = materialise(
        signed.filter("c is not null").groupBy("c").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes"
    )
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring(F.col("sig"), 4 * BAND * b + 1, 4 * BAND)) for b in range(HASHES // BAND)])
    banded = classes.select("c", F.posexplode(bands).alias("band", "bucket"))
    heads = banded.groupBy("band", "bucket").agg(F.min("c").alias("head"), F.max("c").alias("tail")).filter("head <> tail").drop("tail")
    edges = banded.join(heads, ["band", "bucket"]).select(F.col("c").alias("u"), F.col("head").alias("v"))
    group = materialise(components(edges), "groups")

    # Classes with candidates get their shingles from one text of each.
    sizes = materialise(group.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = group.join(sizes, "component").select(F.col("node").alias("c"), "component", blocks.alias("blocks"))
    wanted = classes.join(members, "c").select(F.col("rep"), F.col("c"), "component", "blocks", "copies", "sig")
    texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["rep"])).select("body", "c", "component", "blocks", "copies", "sig")

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, counts = shingle_sets(list(pdf["body"]))
            name, _ = describe(h, counts, signatures=False)
            ends = np.cumsum(counts)
            names = iter(name)
            own = [next(names).tobytes() if n else None for n in counts]
            out = pdf.drop(columns="body")
            out["shingles"] = [h[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
            # Rows that share an id may have other texts.
            yield out[[a == b for a, b in zip(own, pdf["c"], strict=True)]]

    sets = texts.mapInPandas(shingles, "c binary, component binary, blocks int, copies long, sig binary, shingles binary")
    placed = sets.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    looks = least_matches(threshold)
    found = materialise(tasks.groupBy("component", "i", "j").applyInPandas(lambda pdf: _compare(pdf, threshold, looks), "c binary, links long, root binary"), "links")

    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("c").alias("u"), F.col("root").alias("v")))
    named = classes.select("c", "rep", "copies").join(joined.select(F.col("node").alias("c"), "component"), "c", "left")
    # Both written, so that their join reads no aggregate: a group that holds many classes is then no hot key.
    named = materialise(named.withColumn("component", F.coalesce("component", "c")), "named")
    first = materialise(named.groupBy("component").agg(F.min("rep").alias("class_id")), "class-ids")
    info = named.join(first, "component").join(links, "c", "left").select("c", "component", "rep", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("id", "c").join(info, "c", "left").select(
        F.col("id").alias(doc_id), "c", "component", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("rep")).alias("copy_of"), F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
    )


def keep_one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without the rows that are near-duplicates of a row of smaller doc_id in their group: one row of each group stays.

    Rows without words stay. Of repeated rows of the smallest doc_id one stays.
    """
    (c,) = unused_names(df, "shingle_set")
    found = near_duplicates(df, doc_id, text, threshold).filter("c is not null")
    found = materialise(found.select("c", "component", F.col(doc_id).alias("id"), "class_id"), "groups-found")
    # Rows of a group's smallest id: one, but for repeated rows.
    firsts = found.filter(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("component").agg(F.count("*").alias("n"), F.min("c").alias("c"), F.first("id").alias("keep"))
    firsts = materialise(firsts, "groups-kept")

    def name_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, counts = shingle_sets(list(pdf[text]))
            names = iter(describe(h, counts, signatures=False)[0])
            out = pdf.copy(deep=False)
            out[c] = [next(names).tobytes() if n else None for n in counts]
            yield out

    wide = df.withColumn(c, F.lit(None).cast("binary"))
    named = df.mapInPandas(name_sets, wide.schema)
    right, keep = unused_names(wide, "kept_set", "kept_id")
    kept = firsts.select(F.col("c").alias(right), F.col("keep").alias(keep))
    matched = named.join(kept, (F.col(c) == F.col(right)) & F.col(doc_id).eqNullSafe(F.col(keep)), "left").filter(F.col(c).isNull() | F.col(right).isNotNull())
    if firsts.filter("n > 1").limit(1).count():
        some = matched.filter(F.col(c).isNotNull()).dropDuplicates([c])
        matched = some.unionByName(matched.filter(F.col(c).isNull()))
    return matched.select(*df.columns)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every row of ``documents``; rows without words stand alone, repeated rows are copies."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "class_id", "n_links", "copy_of")


QUERIES = {"op7_jaccard": op7_jaccard}
ORACLES = {
    "op7_jaccard": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + {SHINGLE - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS k FROM d WHERE len(w) > 0)
), sets AS (
  SELECT c, min(doc_id) AS rep, count(*) AS copies, first(n) AS n, list(doc_id) AS members
  FROM (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS c, count(*) AS n FROM s GROUP BY 1) GROUP BY 1
), r AS (SELECT rep, g FROM sets JOIN s ON doc_id = rep),
pairs AS (SELECT a.rep AS x, b.rep AS y, count(*) AS k FROM r a JOIN r b USING (g) WHERE a.rep <> b.rep GROUP BY 1, 2),
links AS (SELECT x, y, b.copies FROM pairs JOIN sets a ON a.rep = x JOIN sets b ON b.rep = y WHERE k >= {THRESHOLD} * (a.n + b.n - k) - 1e-9),
reach AS (SELECT rep AS x, rep AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
named AS (SELECT rep, min(y) AS class_id FROM sets JOIN reach ON x = rep GROUP BY 1),
counted AS (SELECT rep, any_value(sets.copies) - 1 + coalesce(sum(links.copies), 0) AS n FROM sets LEFT JOIN links ON x = rep GROUP BY 1),
full_rows AS (SELECT unnest(members) AS doc_id, rep FROM sets)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(f.rep, d.doc_id) AS copy_of
FROM d LEFT JOIN full_rows f USING (doc_id) LEFT JOIN named USING (rep) LEFT JOIN counted USING (rep)
"""
}
