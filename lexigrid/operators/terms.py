"""Term groups: words, beginnings, endings and phrases, and where they occur.

An alias is compiled on the driver. Its elements are resolved against the distinct keys, and a phrase is
the places where as many elements as it has agree on where it would begin, so only matching tokens move.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .corpus import TOKEN, Corpus, strip_marks

MOST_MEMBERS, MOST_ELEMENTS, MOST_UNITS = 32, 16, 256
_TOKEN = regex.compile(TOKEN)


@dataclass(frozen=True)
class Element:
    """What one word must be: equal to the stem, begin with it or end with it."""

    kind: str
    stem: str


@dataclass(frozen=True)
class Member:
    elements: tuple[Element, ...]
    cross_sentence: bool = False
    fold_case: bool = True
    fold_marks: bool = True


@dataclass(frozen=True)
class TermGroup:
    members: tuple[Member, ...]
    count_overlaps: bool = False

    def __post_init__(self):
        if not 1 <= len(self.members) <= MOST_MEMBERS:
            raise ValueError(f"a group has 1 to {MOST_MEMBERS} members")
        if any(not 1 <= len(m.elements) <= MOST_ELEMENTS for m in self.members):
            raise ValueError(f"a member has 1 to {MOST_ELEMENTS} elements")


def fold(text: str, case: bool = True, marks: bool = True) -> str:
    """Case first, then marks: decomposed, stripped of them and composed again."""
    text = text.lower() if case else text
    return strip_marks(text) if marks else text


def compile_alias(raw: str, exact: bool = False, cross_sentence: bool = False) -> Member:
    """``wolf``, ``wol*``, ``*olf``, ``dire wolf``, ``New Yo*``: one ``*`` at one end at most. ValueError if it says nothing."""
    text = unicodedata.normalize("NFC", raw.strip())
    if not text:
        raise ValueError("an alias must not be empty")
    if len(text) > MOST_UNITS:
        raise ValueError("the alias is too long")
    stars = text.count("*")
    head, tail = text.startswith("*"), text.endswith("*")
    if stars > 1 or stars and not (head or tail):
        raise ValueError("one * at the beginning or the end")
    words = [regex.sub("[’ʼ]", "'", m[0]) for m in _TOKEN.finditer(text)]
    if not words:
        raise ValueError("the alias has no word")
    if len(words) > MOST_ELEMENTS:
        raise ValueError("the alias has too many words")
    kinds = ["token"] * len(words)
    if stars and tail:
        kinds[-1] = "prefix"
    elif stars:
        kinds[0] = "suffix"
    return Member(tuple(map(Element, kinds, words)), cross_sentence, not exact, not exact)


def quick_add(text: str, exact: bool = False) -> list[TermGroup]:
    """A comma list of aliases, a group each; those that say the same are one."""
    members = dict.fromkeys(compile_alias(a, exact) for a in text.split(",") if a.strip())
    return [TermGroup((m,)) for m in members]


def group(*aliases: str, exact: bool = False, count_overlaps: bool = False, cross_sentence: bool = False) -> TermGroup:
    return TermGroup(tuple(compile_alias(a, exact, cross_sentence) for a in aliases), count_overlaps)


def _says(e: Element, m: Member, key: Column) -> Column:
    stem = fold(e.stem, m.fold_case, m.fold_marks)
    if not stem:
        return F.lit(False)
    return {"token": key == stem, "prefix": key.startswith(stem), "suffix": key.endswith(stem)}[e.kind]


def resolve_terms(corpus: Corpus, g: TermGroup) -> DataFrame:
    """key and the (member, nth element) that it satisfies, over the distinct keys."""
    marks = any(m.fold_marks for m in g.members)
    keys = corpus.folded if marks else corpus.vocab.select("key", F.col("key").alias("bare"))
    says = []
    for k, m in enumerate(g.members):
        seen = F.col("bare") if m.fold_marks else F.col("key")
        seen = F.lower(seen) if m.fold_case else seen
        says += [F.when(_says(e, m, seen), F.struct(F.lit(k).alias("member"), F.lit(n).alias("nth"))) for n, e in enumerate(m.elements)]
    found = keys.select("key", F.array_compact(F.array(*says)).alias("says"))
    return found.filter(F.size("says") > 0).select("key", F.explode("says").alias("s")).select("key", "s.*")


def matches(corpus: Corpus, g: TermGroup, runs: DataFrame | None = None) -> DataFrame:
    """doc_id, pos, span, member: every place where a member occurs, inside one range of the selection."""
    return _matches(corpus, [g], runs).drop("track")


#: Resolved keys that are sent to all tasks at most, so that tokens stay where they are.
MOST_SENT = 100_000


def _named(corpus: Corpus, g: TermGroup, track: int) -> DataFrame:
    """``resolve_terms`` with the track, the member's number of elements and whether it crosses sentences."""
    sizes = [len(m.elements) for m in g.members]
    size = F.element_at(F.array(*map(F.lit, sizes)), F.col("member") + 1)
    crosses = F.element_at(F.array(*[F.lit(m.cross_sentence) for m in g.members]), F.col("member") + 1)
    return resolve_terms(corpus, g).select("key", "member", "nth", F.lit(track).alias("track"), size.alias("size"), crosses.alias("crosses"))


def _matches(corpus: Corpus, groups: list[TermGroup], runs: DataFrame | None) -> DataFrame:
    """``matches`` of several groups, numbered by ``track``, in one pass over the tokens, which are not kept."""
    resolved = reduce(DataFrame.unionByName, [_named(corpus, g, k) for k, g in enumerate(groups)])
    if resolved.limit(MOST_SENT + 1).count() <= MOST_SENT:
        resolved = F.broadcast(resolved)
    hits = corpus.stream.select("doc_id", "pos", "key", "sent_id").join(resolved, "key").withColumn("start", F.col("pos") - F.col("nth"))
    if max(len(m.elements) for g in groups for m in g.members) == 1:
        found = hits.select("track", "doc_id", "pos", F.lit(1).alias("span"), "member").distinct()
    else:
        whole = hits.groupBy("track", "doc_id", "start", "member", "size", "crosses").agg(F.count_distinct("nth").alias("n"), F.min("sent_id").alias("s0"), F.max("sent_id").alias("s1"))
        found = whole.filter((F.col("n") == F.col("size")) & ((F.col("s0") == F.col("s1")) | F.col("crosses"))).select("track", "doc_id", F.col("start").alias("pos"), F.col("n").cast("int").alias("span"), "member")
    if runs is not None:
        o, r = found.alias("o"), runs.alias("r")
        inside = (F.col("o.doc_id") == F.col("r.doc_id")) & (F.col("pos") >= F.col("r_start")) & (F.col("pos") + F.col("span") <= F.col("r_end"))
        found = o.join(r, inside).select("o.*")
    return found


def merge_overlaps(found: DataFrame, *by: str) -> DataFrame:
    """Unions of spans that overlap (touching ones stay apart), with the sorted members of each."""
    place = Window.partitionBy(*by, "doc_id").orderBy("pos", F.desc("span"), "member")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    opened = found.withColumn("open", F.coalesce(F.col("pos") >= F.max(F.col("pos") + F.col("span")).over(before), F.lit(True)).cast("int"))
    island = opened.withColumn("island", F.sum("open").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.min("pos")
    return island.groupBy(*by, "doc_id", "island").agg(
        start.alias("pos"), (F.max(F.col("pos") + F.col("span")) - start).cast("int").alias("span"), F.array_sort(F.collect_set("member")).alias("members")
    ).drop("island")


def occurrences(corpus: Corpus, g: TermGroup, runs: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """doc_id, pos, span, members. With ``most`` set, more occurrences than that are an error."""
    found = matches(corpus, g, runs)
    out = found.select("doc_id", "pos", "span", F.array("member").alias("members")) if g.count_overlaps else merge_overlaps(found)
    if most is not None and out.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} occurrences")
    return out


def tracks(corpus: Corpus, groups: list[TermGroup], runs: DataFrame | None = None) -> DataFrame:
    """Occurrences of several groups, numbered by ``track``."""
    key = ("tracks", tuple(groups))
    if runs is None and key in corpus.kept:
        return corpus.kept[key]
    found = _matches(corpus, groups, runs)
    plain = [k for k, g in enumerate(groups) if g.count_overlaps]
    columns = ["track", "doc_id", "pos", "span", "members"]
    out = merge_overlaps(found.filter(~F.col("track").isin(plain)) if plain else found, "track").select(*columns)
    if plain:
        out = out.unionByName(found.filter(F.col("track").isin(plain)).withColumn("members", F.array("member")).select(*columns))
    if runs is None:
        out = corpus.kept[key] = out.persist()
    return out
