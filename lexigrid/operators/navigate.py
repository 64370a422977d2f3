"""Moving through occurrences: keyword in context, the next or previous one, pages of a document, marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .corpus import Corpus, running_total, tokenize
from .terms import merge_overlaps


def ranked(corpus: Corpus, occ: DataFrame) -> DataFrame:
    """Occurrences with their corpus position and rank: by position, span, track, members.

    Ranks are counted inside documents and moved by what all documents before hold.
    """
    placed = occ.join(corpus.docs.select("doc_id", "seq_base", "token_count"), "doc_id").withColumn("global", F.col("seq_base") + F.col("pos"))
    own = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "span", "track", "members")) - 1
    counts = corpus.docs.select("doc_id").join(occ.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").fillna(0, ["n"])
    before = running_total(counts, "doc_id", "n", "hits_before").select("doc_id", "hits_before")
    return placed.join(before, "doc_id").withColumn("rank", (own + F.col("hits_before")).cast("long")).drop("hits_before")


def bracket(corpus: Corpus, occ: DataFrame, doc_id: int, token: int) -> dict:
    """total, anchor_rank (the first at or after the place, the last at most) and preceding (rank of the last before)."""
    rows = ranked(corpus, occ)
    anchor = corpus.docs.filter(F.col("doc_id") == doc_id).select("seq_base").first()
    if anchor is None:
        raise ValueError("no such document")
    at = anchor.seq_base + token
    r = rows.agg(F.count("*").alias("total"), F.count_if(F.col("global") < at).alias("lower"), F.max(F.when(F.col("global") < at, F.col("rank"))).alias("preceding")).first()
    return {"total": r.total, "anchor_rank": min(r.lower, r.total - 1) if r.total else None, "preceding": r.preceding}


def sparse_axis(corpus: Corpus, occ: DataFrame, stride: int = 128) -> DataFrame:
    """rank and global of samples along all occurrences: the first, then each time the first run of equal places at
    least ``stride`` ranks behind the sample before.

    Whether a run is sampled depends on the samples before, so this is a fold: runs stream through the driver,
    those of one stretch of ``stride`` ranks at a time.
    """
    runs = ranked(corpus, occ).groupBy("global").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    # A stretch holds ``stride`` runs at most.
    block = F.floor(F.col("rank") / stride)
    stretches = runs.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "global"))).alias("runs"))
    samples, last = [], -stride
    for r in stretches.orderBy("block").toLocalIterator():
        for run in r.runs:
            if run["rank"] - last >= stride:
                samples.append((run["rank"], run["global"]))
                last = run["rank"]
    return corpus.spark.createDataFrame(samples, "rank long, global long")


def progress(corpus: Corpus, places: DataFrame) -> DataFrame:
    """Places (doc_id, pos) with ``progress``: the share of the corpus up to and with that token."""
    total = corpus.docs.agg(F.sum("token_count").alias("total"))
    at = places.join(corpus.docs.select("doc_id", "seq_base"), "doc_id").crossJoin(F.broadcast(total))
    return at.select(*places.columns, ((F.col("seq_base") + F.col("pos") + 1) / F.col("total")).alias("progress"))


def matches_at(corpus: Corpus, occ: DataFrame, doc_id: int, token: int, before: int = 25, after: int = 25, context: int = 10) -> tuple[dict, DataFrame]:
    """The header (total, anchor_rank, preceding, first and last rank of the page) and the rows around a place of a document."""
    if not 0 <= before <= 500 or not 0 <= after <= 500 or before + after < 1:
        raise ValueError("up to 500 rows before and after, one at least")
    head = bracket(corpus, occ, doc_id, token)
    anchor = head["anchor_rank"] or 0
    first = max(0, anchor - before)
    head |= {"first": first if head["total"] else None, "last": min(head["total"], anchor + after) - 1 if head["total"] else None}
    return head, matches_window(corpus, occ, first, min(500, max(1, anchor + after - first)), context)


def matches_window(corpus: Corpus, occ: DataFrame, first: int, rows: int, context: int = 10, most_chars: int = 2048) -> DataFrame:
    """Keyword-in-context rows of ranks ``first`` on: up to ``context`` tokens of the document on either side.

    Only the rows of the page meet tokens and text.
    """
    if not 1 <= rows <= 500 or not 0 <= context <= 256:
        raise ValueError("1 to 500 rows with 0 to 256 tokens of context")
    # 500 rows at most: the tokens stay where they are.
    page = F.broadcast(ranked(corpus, occ).filter(F.col("rank").between(first, first + rows - 1))).alias("p")
    members = page.select("rank", "members")
    # Only the page's documents are cut into tokens.
    own = corpus.documents.join(F.broadcast(page.select("doc_id").distinct()), "doc_id", "left_semi")
    t = tokenize(own).select("doc_id", F.col("pos").alias("t"), "char_start", "char_end").alias("t")
    inside = (F.col("p.doc_id") == F.col("t.doc_id")) & (F.col("t") >= F.col("pos") - context) & (F.col("t") < F.col("pos") + F.col("span") + context)
    node = (F.col("t") >= F.col("pos")) & (F.col("t") < F.col("pos") + F.col("span"))
    placed = page.join(t, inside).groupBy("rank", "track", "p.doc_id", "pos", "span").agg(
        F.min("char_start").alias("c0"), F.min(F.when(node, F.col("char_start"))).alias("c1"), F.max(F.when(node, F.col("char_end"))).alias("c2"), F.max("char_end").alias("c3")
    )
    cut = lambda a, b: F.substring(F.col("text"), F.col(a) + 1, F.col(b) - F.col(a))
    near = placed.join(F.broadcast(members), "rank").withColumns({"c0": F.greatest("c0", F.col("c1") - most_chars), "c3": F.least("c3", F.col("c2") + most_chars)})
    return corpus.documents.select("doc_id", "text").join(F.broadcast(near), "doc_id").select("rank", "track", "doc_id", "pos", "span", "members", cut("c0", "c1").alias("left"), cut("c1", "c2").alias("node"), cut("c2", "c3").alias("right"))


def occurrence_step(corpus: Corpus, occ: DataFrame, doc_id: int, token: int, direction: int = 1) -> DataFrame:
    """The nearest start after (or before) a place, from the other end if there is none; equal starts are one."""
    if direction not in (1, -1):
        raise ValueError("the direction is 1 or -1")
    base = corpus.docs.select("doc_id", "seq_base")
    here = base.filter(F.col("doc_id") == doc_id).select((F.col("seq_base") + token).alias("here"))
    starts = occ.join(base, "doc_id").withColumn("global", F.col("seq_base") + F.col("pos")).crossJoin(F.broadcast(here))
    beyond = F.col("global") > F.col("here") if direction > 0 else F.col("global") < F.col("here")
    pick = F.min if direction > 0 else F.max
    target = starts.agg(pick(F.when(beyond, F.col("global"))).alias("hit"), pick("global").alias("wrap"))
    target = target.select(F.coalesce("hit", "wrap").alias("target"), F.col("hit").isNull().alias("at_edge"))
    joined = starts.join(F.broadcast(target), F.col("global") == F.col("target"))
    return joined.groupBy("doc_id", "pos").agg(F.max("span").alias("span"), F.min("track").alias("track"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"), F.first("at_edge").alias("at_edge"))


def reader_page(corpus: Corpus, doc_id: int, mode: str, token: int, most_tokens: int = 4096, most_chars: int = 32_768) -> DataFrame:
    """One page of a document: ``from`` a token on, ``before`` it, or ``around`` it, within both limits.

    One row: start, end, text, at_start, at_end, what cut it (tokens, text or null), the tokens' places in the
    document's text, and the places that the pages before (to be read ``before``) and behind (``from``) have,
    null at either end. A token that is longer than the limit comes whole.
    """
    n = corpus.docs.filter(F.col("doc_id") == doc_id).select("token_count").first()
    if n is None or mode not in ("from", "before", "around") or most_tokens < 1 or not (1 <= token <= n[0] if mode == "before" else 0 <= token < n[0]):
        raise ValueError("the place must lie in the document")
    most = min(most_tokens, 4096)
    # A page's tokens and as many again: a bounded number of small rows of one document.
    lo, hi = {"from": (token, token + most), "before": (token - most, token), "around": (token - most, token + most)}[mode]
    rows = corpus.tokens.filter((F.col("doc_id") == doc_id) & (F.col("pos") >= max(0, lo)) & (F.col("pos") < hi)).select("pos", "char_start", "char_end").orderBy("pos").collect()
    places = {r.pos: (r.char_start, r.char_end) for r in rows}
    a, b = {"from": (token, token + 1), "before": (token - 1, token), "around": (token, token + 1)}[mode]
    capped: str | None = None

    def fits(x: int, y: int) -> bool:
        nonlocal capped
        if y - x > most:
            capped = "tokens"
        elif places[y - 1][1] - places[x][0] > most_chars:
            capped = "text"
        else:
            return True
        return False

    ahead, behind = mode != "before", mode != "from"
    while ahead or behind:
        if ahead := ahead and b < n[0] and fits(a, b + 1):
            b += 1
        if behind := behind and a > 0 and fits(a - 1, b):
            a -= 1
    c0, c1 = places[a][0], places[b - 1][1]
    text = corpus.documents.filter(F.col("doc_id") == doc_id).select(F.substring("text", c0 + 1, c1 - c0)).first()[0]
    spans = [places[k] for k in range(a, b)]
    row = [(doc_id, a, b, text, a == 0, b == n[0], capped, spans, a if a > 0 else None, b if b < n[0] else None)]
    shape = "doc_id long, start long, end long, text string, at_start boolean, at_end boolean, capped_by string, spans array<struct<start:long,end:long>>, previous long, next long"
    return corpus.spark.createDataFrame(row, shape)


#: Marks that one page of a document has at most.
MOST_MARKS = 5000


def reader_marks(corpus: Corpus, occ: DataFrame, page: DataFrame, limit: int = MOST_MARKS) -> tuple[DataFrame, bool]:
    """The marks of a page (a row of ``reader_page``), the first ``limit`` in reading order, and whether there are more."""
    p = page.select("doc_id", "start", "end").first()
    found = marks(corpus, occ, p.doc_id, p.start, p.end, limit + 1).orderBy("char_start", "char_end", "track", "t0").collect()
    shape = "track int, doc_id long, t0 long, t1 long, char_start long, char_end long, clipped_start boolean, clipped_end boolean"
    return corpus.spark.createDataFrame(found[:limit], shape), len(found) > limit


def marks(corpus: Corpus, occ: DataFrame, doc_id: int, start: int, end: int, limit: int | None = None) -> DataFrame:
    """Occurrences that reach into a stretch of tokens, clipped to it, as characters; in reading order, the first ``limit``."""
    inside = (F.col("doc_id") == doc_id) & (F.col("pos") < end) & (F.col("pos") + F.col("span") > start)
    clipped = occ.filter(inside).select("track", "doc_id", F.greatest("pos", F.lit(start)).alias("t0"), F.least(F.col("pos") + F.col("span"), F.lit(end)).alias("t1"),
        (F.col("pos") < start).alias("clipped_start"), (F.col("pos") + F.col("span") > end).alias("clipped_end"))
    t = corpus.tokens.filter(F.col("doc_id") == doc_id).select("pos", "char_start", "char_end")
    out = clipped.join(t.select(F.col("pos").alias("t0"), "char_start"), "t0").join(t.select((F.col("pos") + 1).alias("t1"), "char_end"), "t1").select("track", "doc_id", "t0", "t1", "char_start", "char_end", "clipped_start", "clipped_end")
    return out if limit is None else out.orderBy("char_start", "char_end", "track", "t0").limit(limit)


def context_marks(page: DataFrame, occ: DataFrame, context: int, most: int = 32) -> DataFrame:
    """Other tracks' occurrences around each row of a page (rank, track, doc_id, pos, span), merged where they overlap; the nearest ``most`` a side, with ``truncated`` where there are more."""
    # A page has few rows: the occurrences stay where they are.
    p, o = F.broadcast(page).alias("p"), occ.alias("o")
    near = (F.col("p.doc_id") == F.col("o.doc_id")) & (F.col("p.track") != F.col("o.track")) & (F.col("o.pos") < F.col("p.pos") + F.col("p.span") + context) & (F.col("o.pos") + F.col("o.span") > F.col("p.pos") - context)
    hits = p.join(o, near).select("rank", F.col("o.track").alias("other"), "p.doc_id", "o.pos", "o.span", F.lit(0).alias("member"), F.col("p.pos").alias("anchor"))
    merged = merge_overlaps(hits, "rank", "other", "anchor").withColumn("side", F.when(F.col("pos") < F.col("anchor"), "left").otherwise("right"))
    nearest = F.row_number().over(Window.partitionBy("rank", "side").orderBy(F.abs(F.col("pos") - F.col("anchor")), "other"))
    counted = merged.withColumns({"nth": nearest, "truncated": F.count("*").over(Window.partitionBy("rank", "side")) > most})
    return counted.filter(F.col("nth") <= most).select("rank", "other", "doc_id", "pos", "span", "side", "truncated")


def collapse_marks(text: str, marks: list[tuple[int, int, object]]) -> tuple[str, list[tuple[int, int, object]]]:
    """``text`` with white space collapsed and trimmed, and its marks (start, end, value) moved along; empty ones go."""
    place, out, end = [], [], 0
    lead, trail = len(text) - len(text.lstrip()), len(text.rstrip())
    for k, c in enumerate(text):
        place.append(len(out))
        if lead <= k < trail and not (c.isspace() and text[k - 1].isspace() and k > lead):
            out.append(" " if c.isspace() else c)
    place.append(len(out))
    clip = lambda x: max(0, min(len(text), x))
    moved = [(place[clip(a)], place[clip(b)], v) for a, b, v in marks]
    return "".join(out), sorted((m for m in moved if m[0] < m[1]), key=lambda m: m[:2])


def mark_segments(length: int, marks: list[tuple[int, int, object]]) -> list[tuple[int, int, list]]:
    """Stretches (start, end, values of the marks that cover them) that follow each other over the whole length."""
    edges = sorted({0, length, *(max(0, min(length, x)) for a, b, _ in marks for x in (a, b))})
    return [(a, b, [v for x, y, v in marks if x <= a and b <= y]) for a, b in zip(edges, edges[1:], strict=False)]
