import random

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import bins, counts, navigate, proximity, selection, terms
from lexigrid.operators.corpus import Corpus


def corpus(spark, *texts):
    return Corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def places(df):
    return sorted((r.doc_id, r.pos, r.span, tuple(r.members)) for r in df.collect())


def test_frequency_list(spark):
    rows = {r.key: r for r in counts.frequency_page(corpus(spark, "x x x y", "x z z z")).collect()}
    assert list(rows) == ["x", "z", "y"]
    assert (rows["x"]["count"], rows["x"].doc_freq, rows["x"].rate_per_10k, rows["x"].dp, rows["x"].dp_norm) == (4, 2, 5000, 0.25, 0.5)
    assert (rows["z"]["count"], rows["z"].dp, rows["z"].dp_norm) == (3, 0.5, 1)


def test_frequency_classes(spark):
    c = corpus(spark, "word 12 word 34", "word 12 other 56")
    page = counts.frequency_page(c, "key", False, 1, 2, classes=("numeral",)).collect()
    assert [r.key for r in page] == ["34", "56"]
    assert [r.key for r in counts.frequency_table(c, classes=("lexical",), min_count=2, min_docs=2).collect()] == ["word"]
    with pytest.raises(ValueError):
        counts.frequency_page(c, limit=201)


def test_inventory(spark):
    c = corpus(spark, "One two three. Four five.\n\nSix seven eight nine.", "Ten eleven. Twelve thirteen fourteen.")
    runs = selection.resolve(c, ranges=spark.createDataFrame([(0, 1, 6)], "doc_id long, r_start long, r_end long"))
    a, b = counts.inventory_docs(c, 100, runs).orderBy("doc_id").collect()
    assert (a.full_tokens, a.tokens, a.sentences, a.sentence_mean, a.sentence_median, a.sentence_p90, a.paragraphs, a.paragraph_mean) == (9, 5, 2, 3, 3, 4, 1, 4)
    total = counts.inventory_totals(c, runs).first()
    assert (total.tokens, total.sentences, total.paragraphs) == (10, 4, 2)


def test_mattr_by_range_and_readability(spark):
    c = corpus(spark, "a b a c c")
    runs = spark.createDataFrame([(0, 0, 2), (0, 3, 5)], "doc_id long, r_start long, r_end long")
    r = counts.mattr(c, 3, runs).first()
    assert (r.mattr, r.plain_ttr) == (0.75, True)
    t = counts.inventory_totals(corpus(spark, "Don't 123 café 𐐀.")).first()
    assert (t.readability_characters, t.readability_letters) == (12, 9)


def test_matching(spark):
    c = corpus(spark, "The wolf ran. A WOLF howled.", "a lone wolf again")
    assert places(terms.occurrences(c, terms.group("wolf"))) == [(0, 1, 1, (0,)), (0, 4, 1, (0,)), (1, 2, 1, (0,))]
    assert [p[1] for p in places(terms.occurrences(corpus(spark, "wolf wolves wolfish sheep"), terms.group("wolf*")))] == [0, 2]
    d = corpus(spark, "I saw the dire. Wolf howled anyway.")
    assert places(terms.occurrences(d, terms.group("dire wolf"))) == []
    assert places(terms.occurrences(d, terms.group("dire wolf", cross_sentence=True))) == [(0, 3, 2, (0,))]
    y = corpus(spark, "New York and New Yorker, but old York.")
    assert [p[1:3] for p in places(terms.occurrences(y, terms.group("New Yo*")))] == [(0, 2), (3, 2)]
    assert places(terms.occurrences(corpus(spark, "Élan elan ÉLAN"), terms.group("elan"))) == [(0, k, 1, (0,)) for k in range(3)]
    assert places(terms.occurrences(corpus(spark, "Élan elan"), terms.group("elan", exact=True))) == [(0, 1, 1, (0,))]


def test_ranges_and_unions(spark):
    c = corpus(spark, "x dire wolf y dire wolf z")
    run = lambda e: spark.createDataFrame([(0, 0, e)], "doc_id long, r_start long, r_end long")
    assert [p[1] for p in places(terms.occurrences(c, terms.group("dire wolf"), run(3)))] == [1]
    assert places(terms.occurrences(c, terms.group("dire wolf"), run(2))) == []
    assert places(terms.occurrences(corpus(spark, "a b c d"), terms.group("a b", "b c", "c d"))) == [(0, 0, 4, (0, 1, 2))]
    d = corpus(spark, "the dire wolf howled")
    assert places(terms.occurrences(d, terms.group("dire wolf", "wolf"))) == [(0, 1, 2, (0, 1))]
    assert places(terms.occurrences(d, terms.group("dire wolf", "wolf", count_overlaps=True))) == [(0, 1, 2, (0,)), (0, 2, 1, (1,))]
    with pytest.raises(ValueError):
        terms.occurrences(d, terms.group("wolf", "dire"), most=0)


def test_aliases():
    kinds = lambda a: [e.kind for e in terms.compile_alias(a).elements]
    assert [kinds(a) for a in ("NYC", "Yo*", "*ork", "New Yo*", "*ork City")] == [["token"], ["prefix"], ["suffix"], ["token", "prefix"], ["suffix", "token"]]
    assert [e.stem for e in terms.compile_alias("Washington, D.C.").elements] == ["Washington", "D.C"]
    assert [e.stem for e in terms.compile_alias("co-operation").elements] == ["co", "operation"]
    for bad in ("", "  ", "…", "*", "*wolf*", "wo*lf", "**"):
        with pytest.raises(ValueError):
            terms.compile_alias(bad)
    assert len(terms.quick_add("wolf, sheep, wolf")) == 2


def test_trend(spark):
    c = corpus(spark, "wolf b c d wolf", "x wolf y")
    rows = bins.trend(c, terms.tracks(c, [terms.group("wolf")]), 1, bins=4).orderBy("doc_id", "bin").collect()
    assert [r.bin_tokens for r in rows] == [2, 2, 1, 0, 1, 1, 1, 0]
    assert [r["count"] for r in rows] == [1, 0, 1, 0, 0, 1, 0, 0]
    d = corpus(spark, "wolf b c d wolf f", "x wolf y z")
    runs = spark.createDataFrame([(0, 0, 2), (0, 4, 6), (1, 1, 2)], "doc_id long, r_start long, r_end long")
    rows = bins.trend(d, terms.tracks(d, [terms.group("wolf")], runs), 1, bins=4, runs=runs).orderBy("doc_id", "bin").collect()
    assert [r.bin_tokens for r in rows] == [2, 0, 2, 0, 0, 1, 0, 0]
    assert [r["count"] for r in rows] == [1, 0, 1, 0, 0, 1, 0, 0]
    e = corpus(spark, " ".join(["w"] * 501))
    assert [(r.bin_start, r.bin_tokens) for r in bins.trend(e, terms.tracks(e, [terms.group("w")]), 1, width=250).orderBy("bin").collect()] == [(0, 250), (250, 250), (500, 1)]
    with pytest.raises(ValueError):
        bins.trend(e, e.tokens, 1, bins=3)


def _occ(spark, rows):
    return spark.createDataFrame(rows, "track int, doc_id long, pos long, span int").withColumn("members", F.array(F.lit(0)))


def test_company_fixture(spark):
    occ = _occ(spark, [(0, 0, 0, 2), (0, 0, 10, 1), (0, 1, 5, 1), (1, 0, 2, 1), (1, 0, 8, 4)])
    total = {}
    for r in proximity.company(occ, 2).collect():
        for w in ("forward", "backward", "tied", "overlap", "none"):
            total[r.track, w] = total.get((r.track, w), 0) + r[w]
        total[r.track, r.bucket_edge] = r.n
    assert (total[0, 0], total[0, "none"], total[0, "forward"], total[0, "overlap"]) == (2, 1, 1, 1)
    assert (total[1, 0], total[1, "none"], total[1, "backward"], total[1, "overlap"]) == (2, 0, 1, 1)
    assert proximity.docs_with_both(occ, 2).first().docs_with_both == 1
    near = proximity.nearest(_occ(spark, [(0, 0, 20, 1), (1, 0, 0, 10), (1, 0, 5, 1), (1, 0, 31, 1)]), 2).filter("track = 0").first()
    assert (near.gap, near.way) == (10, "tied")


def test_company_against_brute_force(spark):
    rng, rows = random.Random(1), []
    for d in range(12):
        rows += {(rng.randrange(3), d, rng.randrange(60), rng.randint(1, 6)) for _ in range(rng.randint(0, 14))}
    got = {(r.track, r.peer, r.doc_id, r.pos, r.way, r.gap) for r in proximity.nearest(_occ(spark, rows), 3).collect()}
    want = set()
    for t, d, p, s in rows:
        for peer in range(3):
            if peer == t:
                continue
            others = [(q, q + n) for u, e, q, n in rows if u == peer and e == d]
            over = any(q < p + s and e > p for q, e in others)
            back, ahead = min((p - e for q, e in others if q < p), default=None), min((q - p - s for q, e in others if q >= p), default=None)
            gaps = [g for g in (back, ahead) if g is not None]
            way = "overlap" if over else "none" if not gaps else "tied" if back == ahead else "backward" if ahead is None or back is not None and back < ahead else "forward"
            want.add((t, peer, d, p, way, 0 if over else min(gaps, default=None)))
    assert got == want


def test_destinations(spark):
    c = corpus(spark, " ".join(["w"] * 300))
    r = proximity.destinations(c, _occ(spark, [(0, 0, p, 1) for p in (10, 20, 30, 40)]), 1).collect()
    assert [(x.score, x.counts, x.start, x.end) for x in r] == [(33_554_432, [4], 0, 300)]
    far = corpus(spark, " ".join(["w"] * 3000))
    assert proximity.destinations(far, _occ(spark, [(0, 0, 100, 1), (1, 0, 2800, 1)]), 2, focus=(0, 1)).count() == 0


def test_keyness(spark):
    c = corpus(spark, "apple apple apple apple " + "common " * 6, "apple " + "common " * 9)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    rows = {r.key: r for r in counts.keyness_table(c, ids(0), ids(1)).collect()}
    a = rows["apple"]
    assert (a.count_a, a.count_b, a.rate_a, a.rate_b) == (4, 1, 4000, 1000) and a.log_ratio > 0 and a.g2 > 0
    assert [r.key for r in counts.keyness_table(c, ids(0), ids(1), side="a").collect()] == ["apple"]
    assert [r.key for r in counts.keyness_table(c, ids(0), ids(1), side="b").collect()] == ["common"]
    back = {r.key: r for r in counts.keyness_table(c, ids(1), ids(0)).collect()}
    assert back["apple"].g2 == pytest.approx(-a.g2) and back["apple"].log_ratio == pytest.approx(-a.log_ratio)
    d = corpus(spark, "alpha alpha alpha alpha", "beta beta beta beta")
    assert tuple(counts.divergence(d, ids(0), ids(1)).first()) == (1.0, 2)
    with pytest.raises(ValueError):
        counts.keyness_table(c, ids(0), ids(0, 1))


def test_steps_pages_and_buckets(spark):
    c = corpus(spark, "a b c d e f g h i j", "k l m n o p q r")
    occ = _occ(spark, [(0, 0, 2, 1), (0, 0, 7, 2), (1, 0, 7, 1), (0, 1, 1, 3), (0, 1, 6, 1)])
    step = lambda *a: [(r.doc_id, r.pos, r.span, r.at_edge) for r in navigate.occurrence_step(c, occ, *a).collect()]
    assert step(0, 2, 1) == [(0, 7, 2, False)]
    assert step(1, 6, 1) == [(0, 2, 1, True)]
    assert step(0, 2, -1) == [(1, 6, 1, True)]
    assert navigate.bracket(c, occ, 1, 0) == {"total": 5, "anchor_rank": 3, "preceding": 2}
    page = navigate.reader_page(c, 0, "around", 5, 3).first()
    assert (page.start, page.end, page.text, page.capped_by) == (4, 7, "e f g", "tokens")
    before = navigate.reader_page(c, 0, "before", 3, 100).first()
    assert (before.start, before.end, before.at_start, before.capped_by) == (0, 3, True, None)
    assert {r.doc_id: r.buckets for r in bins.bucket_plan(c, 9).collect()} == {0: 5, 1: 4}
    density = bins.dispersion_density(c, occ, 9)
    assert density.agg(F.sum("count")).first()[0] == 5
    merged = selection.merge_ranges(spark.createDataFrame([(0, 0, 3), (0, 3, 5), (0, 7, 9), (0, 8, 10)], "doc_id long, r_start long, r_end long"))
    assert sorted((r.r_start, r.r_end) for r in merged.collect()) == [(0, 5), (7, 10)]
    with pytest.raises(ValueError):
        selection.resolve(c, ranges=spark.createDataFrame([(0, 5, 50)], "doc_id long, r_start long, r_end long"))


def test_tracks_that_occur_nowhere(spark):
    c = corpus(spark, "wolf b c d wolf", "x wolf y", "none here at all")
    occ = terms.tracks(c, [terms.group("wolf"), terms.group("zebra"), terms.group("b")])
    rows = bins.trend(c, occ, 3, bins=4)
    assert {(r.track, r.n) for r in rows.groupBy("track").agg(F.sum("count").alias("n")).collect()} == {(0, 3), (1, 0), (2, 1)}
    assert bins.catalog_totals(rows).filter("track = 1").count() == 4
    runs = spark.createDataFrame([(0, 0, 2)], "doc_id long, r_start long, r_end long")
    got = {r.track: r for r in bins.range_compare(c, occ, 3, runs).collect()}
    assert (got[1].undefined, got[1].contrast) == ("no-occurrences", None) and (got[0].hits_in, got[0].hits_out, got[0].tokens_out) == (1, 2, 10)
    whole = c.docs.select("doc_id", F.lit(0).cast("long").alias("r_start"), F.col("token_count").alias("r_end"))
    assert {r.undefined for r in bins.range_compare(c, occ, 3, whole).collect()} == {"whole-corpus"}
    assert {r.undefined for r in bins.range_compare(c, occ, 3, whole.limit(0)).collect()} == {"empty-range"}
    pairs = {(r.track, r.peer): r for r in proximity.company_pairs(occ, 3).collect()}
    assert set(pairs) == {(0, 1), (0, 2), (1, 2)} and (pairs[0, 1].none, pairs[0, 1].none_back, pairs[0, 1].docs_with_both) == (3, 0, 0)
    assert {(r.track, r.total, r.doc_count) for r in proximity.company_tracks(c, occ, 3).collect()} == {(0, 3, 2), (1, 0, 0), (2, 1, 1)}
    assert proximity.destinations(c, occ, 3, focus=(0, 1)).count() == 0 and proximity.destinations(c, occ, 3, focus=(0, 2)).count() == 1
    selection.whole_corpus(c, whole)
    with pytest.raises(ValueError):
        selection.whole_corpus(c, runs)


def _plain_destinations(sizes, hits, window, focus, results=12, per_doc=8):
    """By the definition: each anchor's window, the best of each run of anchors, then round by round over documents."""
    from math import isqrt

    tracks = len(hits[0])
    totals = [sum(len(h[t]) for h in hits) for t in range(tracks)]
    weight = [min(16 * 65536, 65536 * max(totals) // max(1, n)) for n in totals]
    lists = []
    for d, n in enumerate(sizes):
        found = []
        for a in sorted({p for h in hits[d] for p in h}):
            begin = min(max(0, a - window // 2), max(0, n - window))
            end = min(n, begin + window)
            k = [sum(begin <= p < end for p in h) for h in hits[d]]
            if focus and not (k[focus[0]] and k[focus[1]]):
                continue
            score = sum(x > 0 for x in k) * sum(w * isqrt(65536 * min(x, 4096)) for w, x in zip(weight, k, strict=True))
            track = min((t for t in range(tracks) if a in hits[d][t]), key=lambda t: (-weight[t], t))
            found.append((-score, -sum(x > 0 for x in k), -sum(k), begin, a, track, end, k))
        runs, first, last = [], None, None
        for f in found:
            if first is None or f[4] - last >= window or f[4] - first > 4 * window:
                runs.append([])
                first = f[4]
            last = f[4]
            runs[-1].append(f)
        lists.append(sorted(min(r, key=lambda f: f[:6]) for r in runs)[:per_doc])
    active = sum(bool(x) for x in lists)
    quota, taken = min(per_doc, -(-results // max(1, min(active, 4)))), []
    for depth in range(per_doc):
        level = [(x[depth][:3], d, x[depth]) for d, x in enumerate(lists) if len(x) > depth]
        for _, d, f in sorted(level, key=lambda x: (*x[0], x[1], x[2][3:6])):
            own = [t for t in taken if t[0] == d]
            if len(taken) < results and len(own) < quota and not any(t[1] < f[6] and f[3] < t[2] for t in own):
                taken.append((d, f[3], f[6], f[4], f[5], -f[0], f[7]))
    return taken


@pytest.mark.parametrize(("docs", "focus"), [(3, None), (3, (0, 2)), (20, None), (20, (1, 2))])
def test_destinations_against_the_definition(spark, docs, focus):
    rng = random.Random(docs)
    sizes = [rng.randint(1, 900) for _ in range(docs)]
    hits = [[sorted(rng.sample(range(n), min(n, rng.choice([0, 1, 3, 9])))) for _ in range(3)] for n in sizes]
    c = corpus(spark, *[" ".join(["w"] * n) for n in sizes])
    occ = _occ(spark, [(t, d, p, 1) for d, h in enumerate(hits) for t in range(3) for p in h[t]])
    got = [(r.doc_id, r.start, r.end, r.anchor, r.anchor_track, r.score, list(r.counts)) for r in proximity.destinations(c, occ, 3, window=60, focus=focus).orderBy("rank").collect()]
    assert got == _plain_destinations(sizes, hits, 60, focus)


def test_mtld_against_the_scalar(spark):
    from lexigrid.functions import stats

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n)) for k, n in ((2, 50), (26, 400), (5, 1), (26, 26), (9, 300))] + [" ".join(f"w{i}" for i in range(30))]
    got = {r.doc_id: r.mtld for r in counts.mtld(corpus(spark, *texts)).collect()}
    assert got == {i: pytest.approx(stats.mtld_of(t.split())) for i, t in enumerate(texts)}


def test_keyness_pages_and_sides(spark):
    c = corpus(spark, "apple apple pear plum common common", "apple common common fig fig", "12 13")
    a, b = counts.compare_sides(c, [0])
    assert {r.doc_id for r in b.collect()} == {1, 2}
    every = counts.keyness_page(c, a, b, limit=200).collect()
    assert [r.key for r in every] == sorted((r.key for r in every), key=[r.key for r in every].index) and every[0].total == len(every)
    parts = [r.key for k in range(0, len(every), 2) for r in counts.keyness_page(c, a, b, offset=k, limit=2).collect()]
    assert parts == [r.key for r in every]
    assert [r.count_b for r in counts.keyness_page(c, a, b, sort="count_b").collect()] == sorted((r.count_b for r in every), reverse=True)
    with pytest.raises(ValueError):
        counts.keyness_page(c, a, c.docs.filter("doc_id = 2").select("doc_id"), classes=("lexical",))
    with pytest.raises(ValueError):
        counts.compare_sides(c, [0], rest=False, others=[0, 1])


def test_quality_and_identity(spark, tmp_path):
    from lexigrid.operators import quality

    c = corpus(spark, "One two. Three\n\nfour", "", "x's y")
    assert quality.token_violations(c.tokens, c.documents).count() == 0 and quality.snapshot_violations(c).count() == 0
    bad = c.tokens.withColumn("char_end", F.when(F.col("pos") == 1, F.col("char_end") + 100).otherwise(F.col("char_end"))).withColumn("cls", F.when(F.col("pos") == 2, "odd").otherwise(F.col("cls")))
    assert {r.broken for r in quality.token_violations(bad, c.documents).collect()} >= {"beyond the text", "unknown class", "not the text", "spans overlap or are empty"}
    assert quality.recipe_hash(spark) == quality.recipe_hash(spark) != quality.recipe_hash(spark, numerals=False)
    g = terms.group
    assert quality.group_identity(g("a", "b")) == quality.group_identity(g("a", "b")) != quality.group_identity(g("b", "a")) != quality.group_identity(g("b", "a", count_overlaps=True))
    first = quality.token_table(c.documents, f"file://{tmp_path}")
    assert first.count() == c.tokens.count() and quality.token_table(c.documents.limit(0), f"file://{tmp_path}").count() == first.count()


def test_axis_windows_and_reader_marks(spark):
    c = corpus(spark, " ".join(["w"] * 300), " ".join(["v"] * 50))
    occ = _occ(spark, [(t, 0, p, 1) for p in range(0, 300, 2) for t in range(1 + (p % 20 == 0))] + [(0, 1, 49, 1)])
    ranks = {}
    for r in navigate.ranked(c, occ).collect():
        ranks[r["global"]] = min(r["rank"], ranks.get(r["global"], r["rank"]))
    want, last = [], -50
    for g in sorted(ranks):
        if ranks[g] - last >= 50:
            want.append((ranks[g], g))
            last = ranks[g]
    assert sorted(tuple(r) for r in navigate.sparse_axis(c, occ, 50).collect()) == want
    head, page = navigate.matches_at(c, occ, 1, 0, before=2, after=3, context=1)
    assert head == {"total": 166, "anchor_rank": 165, "preceding": 164, "first": 163, "last": 165} and sorted(r["rank"] for r in page.collect()) == [163, 164, 165]
    assert navigate.progress(c, spark.createDataFrame([(1, 49)], "doc_id long, pos long")).first().progress == 1
    page = navigate.reader_page(c, 0, "from", 10, 4)
    p = page.first()
    assert (p.previous, p.next, [tuple(x) for x in p.spans]) == (10, 14, [(20, 21), (22, 23), (24, 25), (26, 27)])
    wide = _occ(spark, [(0, 0, 9, 3), (1, 0, 13, 5), (0, 0, 11, 1)])
    found, more = navigate.reader_marks(c, wide, page, 2)
    assert more and [(r.t0, r.t1, r.clipped_start, r.clipped_end) for r in found.orderBy("char_start").collect()] == [(10, 12, True, False), (11, 12, False, False)]
    assert navigate.collapse_marks("  a \n b  ", [(0, 3, 1), (3, 7, 2), (8, 9, 3)]) == ("a b", [(0, 1, 1), (1, 3, 2)])
    assert navigate.mark_segments(5, [(0, 3, "x"), (2, 4, "y")]) == [(0, 2, ["x"]), (2, 3, ["x", "y"]), (3, 4, ["y"]), (4, 5, [])]


def test_buckets_by_default_budget_against_the_definition(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 3000) for _ in range(9)]
    c = corpus(spark, *[" ".join(["w"] * n) for n in sizes])
    plan = {r.doc_id: r.buckets for r in bins.bucket_plan(c).collect()}
    assert sum(plan.values()) == min(4096, sum(sizes)) and all(1 <= plan[d] <= n for d, n in enumerate(sizes))
    occ = terms.tracks(c, [terms.group("w")])
    got = {(r.doc_id, r.bucket): (r.bucket_start, r["count"]) for r in bins.dispersion_density(c, occ).collect()}
    want = {}
    for d, n in enumerate(sizes):
        edges = [b * n // plan[d] for b in range(plan[d] + 1)]
        want |= {(d, b): (edges[b], edges[b + 1] - edges[b]) for b in range(plan[d])}
    assert got == want


def test_keys_are_composed_and_uax29_words(spark):
    from lexigrid.operators.corpus import tokenize, uax29_words

    assert uax29_words("can't 3,141.5 a.b.c x_y naïve日本 “q”") == (["can't", "3,141.5", "a.b.c", "x_y", "naïve", "日", "本", "q"], ["", " ", " ", " ", " ", "", "", " “", "”"])
    docs = spark.createDataFrame([(0, "cafe\u0301’s CAFÉ's 12,5"), (1, None), (2, "")], "doc_id long, text string")
    rows = tokenize(docs).orderBy("pos").collect()
    assert [r.key for r in rows][:2] == ["café's", "CAFÉ's"] and rows[0].raw == "cafe\u0301’s" and (rows[1].char_start, rows[1].char_end) == (8, 14)
    rows = tokenize(spark.createDataFrame([(0, "café’s 12,5 日本"), (1, None)], "doc_id long, text string"), profile="uax29-word-v1").orderBy("pos").collect()
    assert [(r.key, r.cls, r.char_start) for r in rows] == [("café's", "lexical", 0), ("12,5", "numeral", 7), ("日", "lexical", 12), ("本", "lexical", 13)]


def test_snippet_marks(spark):
    c = corpus(spark, " ".join(["w"] * 300))
    occ = _occ(spark, [(0, 0, p, 1) for p in range(90, 130)] + [(1, 0, 100, 3)])
    found = proximity.snippets(c, proximity.destinations(c, occ, 2))
    marks = proximity.snippet_marks(found, occ, 4).orderBy("rank", "t0", "track").collect()
    s = found.filter("rank = 0").first()
    assert all(s.snippet_start <= m.t0 < m.t1 <= s.snippet_end for m in marks if m["rank"] == 0) and len([m for m in marks if m["rank"] == 0]) == 4 and marks[0].truncated


def test_occurrences_mtld_and_keyness_keep_no_tokens(spark):
    rows = [(1, "the cat of the house"), (2, "of mice and the men"), (3, None), (4, "alone 42")]
    c = Corpus(spark.createDataFrame(rows, "doc_id long, text string"))
    occ = terms.tracks(c, [terms.group("the"), terms.group("of")])
    found = [(r.track, r.doc_id, r.pos, r["rank"]) for r in navigate.ranked(c, occ).orderBy("rank").collect()]
    assert found == [(0, 1, 0, 0), (1, 1, 2, 1), (0, 1, 3, 2), (1, 2, 0, 3), (0, 2, 3, 4)]
    assert [(r.track, r.peer, r.docs_with_both) for r in proximity.company_pairs(occ, 2).collect()] == [(0, 1, 2)]
    assert navigate.matches_window(c, occ, 3, 1, 1).first().right == " mice"
    assert {r.doc_id for r in counts.mtld(c).collect()} == {1, 2, 4}
    a, b = c.docs.filter("doc_id = 1").select("doc_id"), c.docs.filter("doc_id > 1").select("doc_id")
    assert counts.keyness_page(c, a, b).first().total == 9
    assert "tokens" not in vars(c)
    c.close()


def test_token_violations_look_long_texts_up_once(spark):
    from lexigrid.operators import quality

    c = Corpus(spark.createDataFrame([(1, "ab cd " * 30_000), (2, "One. Two")], "doc_id long, text string"))
    bad = F.when((F.col("doc_id") == 1) & (F.col("pos") == 59_999), "xx").otherwise(F.col("raw"))
    out = quality.token_violations(c.stream.withColumn("raw", bad), c.documents)
    assert "Window" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in out.collect()] == [(1, 59_999, "not the text")]
