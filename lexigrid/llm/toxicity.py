"""Toxicity by weak supervision.

Voters are words (a lexicon) and beginnings of words (patterns) that labelled training rows connect with
toxic texts. A generative label model estimates how often each of them fires in texts of either kind, and
which of them say the same thing; its posterior labels train a linear classifier over the votes, which
scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_arrow_batches, unused_names
from .words import ALNUM, split_words

#: Labelled rows that voters are chosen over, and that the label model and the classifier are fitted on, at most (by hash).
VOTER_ROWS, FIT_ROWS = 200_000, 16_000
#: Voters at most: the strongest by G2, which is at least LEAST_G2.
MOST_VOTERS, LEAST_G2, LEAST_ODDS = 1024, 24.0, 25.0
#: Bytes of the beginnings of words that are tried as patterns.
PREFIX_BYTES = (4, 5, 6, 7)
#: Correlation, within texts of one kind, above which voters share one vote.
CORRELATED = 0.4
#: Least numbers of voters that fire in a text, of the label model's bins.
FIRED = (1, 2, 3, 4, 6, 9)
THRESHOLD = 0.3


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature) pairs, each once, and the number of words of each text.

    A feature is the hash of a whole word or the bytes of a beginning under a bit pattern of its own.
    """
    words = split_words(texts, ALNUM, True)
    if not len(words.hashes):
        return np.empty(0, np.int64), np.empty(0, np.uint64), words.counts
    flat = np.frombuffer(words.data, np.uint8)
    text = np.repeat(np.arange(len(texts)), words.counts)
    size = words.ends - words.starts
    found, owners, code = [words.hashes | np.uint64(1)], [text], np.zeros(len(size), np.uint64)
    for k in range(max(PREFIX_BYTES)):
        code = (code << np.uint64(8)) | flat[np.minimum(words.starts + k, len(flat) - 1)].astype(np.uint64)
        if k + 1 in PREFIX_BYTES:
            long_enough = size >= k + 1
            # 56 bits of letters at most, a length, and an even number: never the hash of a word.
            found.append((code[long_enough] << np.uint64(4)) | np.uint64(2 * (k + 1 - min(PREFIX_BYTES))))
            owners.append(text[long_enough])
    pairs = np.unique(np.rec.fromarrays([np.concatenate(owners), np.concatenate(found)], names="t,f"))
    return pairs.t, pairs.f, words.counts


def _lookup(sorted_features: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``f`` are known, and their places."""
    if not len(sorted_features):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_features, f), len(sorted_features) - 1)
    known = np.flatnonzero(sorted_features[at] == f)
    return known, at[known]


def votes(texts: list[str | None], voters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, voter number) of the voters that fire, each once; ``voters`` is sorted."""
    words = split_words(texts, ALNUM, True)
    flat = np.frombuffer(words.data, np.uint8)
    text = np.repeat(np.arange(len(texts)), words.counts)
    if not len(text) or not len(voters):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    size = words.ends - words.starts
    seen = np.zeros(1 << 16, bool)
    seen[_low(voters)] = True
    owner, voter, code = [], [], np.zeros(len(size), np.uint64)

    def look(f: np.ndarray, of: np.ndarray) -> None:
        maybe = np.flatnonzero(seen[_low(f)])
        known, at = _lookup(voters, f[maybe])
        owner.append(of[maybe[known]])
        voter.append(at)

    look(words.hashes | np.uint64(1), text)
    for k in range(max(PREFIX_BYTES)):
        code = (code << np.uint64(8)) | flat[np.minimum(words.starts + k, len(flat) - 1)].astype(np.uint64)
        if k + 1 in PREFIX_BYTES:
            long_enough = np.flatnonzero(size >= k + 1)
            look((code[long_enough] << np.uint64(4)) | np.uint64(2 * (k + 1 - min(PREFIX_BYTES))), text[long_enough])
    both = np.unique(np.concatenate(owner) * len(voters) + np.concatenate(voter))
    return both // len(voters), both % len(voters)


def _low(f: np.ndarray) -> np.ndarray:
    return ((f ^ (f >> np.uint64(23)) ^ (f >> np.uint64(41))) & np.uint64(0xFFFF)).astype(np.int64)


def g2_column(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """How surely a feature goes with toxic texts: the log-likelihood ratio of its counts, 0 if it goes with the others."""
    share = (pos + neg) / F.lit(float(n_pos + n_neg))

    def part(x: Column, n: int) -> Column:
        p = x / F.lit(float(n))
        return x * F.log(F.greatest(p, F.lit(1e-12)) / share) + (n - x) * F.log(F.greatest(1 - p, F.lit(1e-12)) / F.greatest(1 - share, F.lit(1e-12)))

    return F.when(pos * n_neg > neg * n_pos, 2 * (part(pos, n_pos) + part(neg, n_neg))).otherwise(0.0)


@dataclass
class Labelling:
    """What the label model found: posterior labels, rates of firing in toxic and other texts, each voter's
    group, and how often the given labels say toxic in toxic and in other texts."""

    posterior: np.ndarray
    fires_toxic: np.ndarray
    fires_other: np.ndarray
    group: np.ndarray
    told_toxic: float
    told_other: float


@dataclass
class Model:
    """Sorted voters, their weights and the bias of the classifier; what the label model found beside it."""

    voters: np.ndarray
    weights: np.ndarray
    bias: float
    labelling: Labelling | None

    def score(self, texts: list[str | None]) -> np.ndarray:
        t, v = votes(texts, self.voters)
        z = self.bias + np.bincount(t, self.weights[v], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def label_model(matrix: np.ndarray, labels: np.ndarray, rounds: int = 50) -> Labelling:
    """A generative model of votes, by EM: each text is toxic or not, each voter fires at a rate of its own in either kind.

    In either kind of text so many voters fire with some probability (by bins of FIRED), and which ones with
    the voters' own rates; that all are silent is the first bin. The given ``labels`` (0 or 1) set the first
    rates and are one more voter, whose accuracy is estimated from how it agrees with what all other votes
    say, without bounds: labels that the votes contradict are put right. Voters that agree more than their
    accuracy explains are a group and count as one vote.
    """
    n, m = matrix.shape
    q = labels.astype(float)
    group, weight = np.arange(m), np.ones(m)
    fired = np.searchsorted(FIRED, matrix.sum(1), "right")
    a = b = np.full(m, 0.1)
    told = (0.9, 0.1)
    for step in range(rounds):
        toxic, other = q.sum(), n - q.sum()
        odds = np.log((toxic + 1) / (other + 1))
        a = (q.astype(np.float32) @ matrix + 0.5) / (toxic + 1)
        b = ((1 - q).astype(np.float32) @ matrix + 0.5) / (other + 1)
        if step == 3 and m > 1:
            group = _correlated(matrix, q)
            weight = 1 / np.bincount(group, minlength=m)[group]
        how_many = [np.bincount(fired, w, len(FIRED) + 1) + 0.5 for w in (q, 1 - q)]
        how_many = np.log(how_many[0] / how_many[0].sum()) - np.log(how_many[1] / how_many[1].sum())
        which = np.log(a / a.sum()) - np.log(b / b.sum())
        # Log odds less their error, which is large where a voter fired seldom.
        which = np.sign(which) * np.maximum(0, np.abs(which) - np.sqrt(1 / (a * (toxic + 1)) + 1 / (b * (other + 1))))
        votes_say = odds + how_many[fired] + matrix @ (weight * which).astype(np.float32)
        by_votes = 1 / (1 + np.exp(-np.clip(votes_say, -30, 30)))
        # Against the other votes only: judged by posteriors that it decides itself, a label is always right.
        told = tuple(float((w @ labels + 10 * prior) / (w.sum() + 10)) for w, prior in ((by_votes, 0.95), (1 - by_votes, 0.05)))
        z = votes_say + np.where(labels == 1, np.log(told[0] / told[1]), np.log((1 - told[0]) / (1 - told[1])))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        settled = step > 3 and np.abs(new - q).max(initial=0) < 1e-4
        q = new
        if settled:
            break
    return Labelling(q, a, b, group, *told)


def _correlated(matrix: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest voter of each voter's group: those joined by correlations given the label."""
    m, found = matrix.shape[1], np.zeros((matrix.shape[1],) * 2)
    for w in (q.astype(np.float32), (1 - q).astype(np.float32)):
        total = max(w.sum(), 1e-9)
        mean = (w @ matrix) / total
        cov = (matrix.T * w) @ matrix / total - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        found += cov / np.outer(sd, sd) * total / len(q)
    root = list(range(m))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(found > CORRELATED, 1)), strict=True):
        x, y = top(int(i)), top(int(j))
        root[max(x, y)] = min(x, y)
    return np.array([top(x) for x in range(m)])


def linear_classifier(matrix: np.ndarray, target: np.ndarray, ridge: float = 0.3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by gradient steps with momentum."""
    n, m = matrix.shape
    x = np.hstack([matrix, np.ones((n, 1), np.float32)])
    w = np.zeros(m + 1)
    w[-1] = np.log((target.sum() + 1) / (n - target.sum() + 1))
    reg = np.append(np.full(m, ridge / n), 0.0)
    rate, first, second = 0.1, np.zeros(m + 1), np.zeros(m + 1)
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(float), -40, 40)))
        grad = x.T @ (p - target).astype(np.float32) / n + reg * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return w[:-1], float(w[-1])


def training_rows(doc_id: Column) -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def _share(rows: DataFrame, share: float) -> DataFrame:
    """A share of ``rows`` by a hash of ``id``, all of them from 1 on."""
    return rows if share >= 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Fit on the labelled training rows: voters are chosen over VOTER_ROWS of them at most, by hash, the
    label model and the classifier take ``rows`` of those.

    Rows without a label or id teach nothing; several labels of one id count as its largest. Without any
    toxic label there are no voters, and every text gets the share of toxic labels as its score.
    """
    small_arrow_batches(docs.sparkSession)
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & training_rows(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    # VOTER_ROWS pairs of numbers at most, give or take chance: texts of any number stay where they are.
    known = _share(known, VOTER_ROWS / max(1, known.count()))
    labelled = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body")).join(F.broadcast(known), "id")
    n_pos, n_all = labelled.agg(F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0)), F.count("*")).first()
    n_neg = n_all - n_pos
    bias = float(np.log((n_pos + 1) / (n_neg + 1))) if n_all else -5.0
    none = np.empty(0)
    nothing = Model(np.empty(0, np.uint64), none, bias, None)
    if not n_pos or not n_neg:
        return nothing

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t, f, _ = features(list(pdf["body"]))
            names, at = np.unique(f, return_inverse=True)
            toxic = np.bincount(at, pdf["y"].to_numpy()[t] == 1, minlength=len(names)).astype(np.int64)
            yield pd.DataFrame({"f": names.view(np.int64), "pos": toxic, "neg": np.bincount(at, minlength=len(names)) - toxic})

    # No least count; what is collected has MOST_VOTERS rows at most.
    counts = labelled.mapInPandas(count, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    strength = g2_column(F.col("pos"), F.col("neg"), n_pos, n_neg)
    odds = (F.col("pos") + 0.5) / F.lit(n_pos) / ((F.col("neg") + 0.5) / F.lit(n_neg))
    best = counts.filter((strength >= LEAST_G2) & (odds >= LEAST_ODDS)).select("f", strength.alias("g2")).orderBy(F.desc("g2"), "f").limit(MOST_VOTERS).toPandas()
    voters = np.sort(best["f"].to_numpy(np.int64).view(np.uint64))
    if not len(voters):
        return nothing
    sample = _share(labelled, rows / n_all)

    def fired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t, v = votes(list(pdf["body"]), voters)
            ends = np.searchsorted(t, np.arange(1, len(pdf)))
            yield pd.DataFrame({"id": pdf["id"].astype(str), "y": pdf["y"], "v": [x.astype(np.int32) for x in np.split(v, ends)]})

    seen = sample.mapInPandas(fired, "id string, y int, v array<int>").toPandas().sort_values("id", kind="stable")
    matrix = np.zeros((len(seen), len(voters)), np.float32)
    for k, v in enumerate(seen["v"]):
        matrix[k, v] = 1
    labelling = label_model(matrix, seen["y"].to_numpy())
    weights, bias = linear_classifier(matrix, labelling.posterior)
    return Model(voters, weights, bias, labelling)


def score_documents(df: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a score from 0 to 1, higher for texts that are likelier toxic, and the new column's name.

    Null and empty texts get the score of a text without votes. Each row is scored from its text alone.
    """
    spark = df.sparkSession
    small_arrow_batches(spark)
    (name,) = unused_names(df, "score")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.copy(deep=False)
            out[name] = shared.value.score(list(pdf[text]))
            yield out

    wide = df.withColumn(name, F.lit(0.0))
    return df.mapInPandas(run, wide.schema), name


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every row of ``documents``; null and empty texts have that of a text without votes, repeated rows the same one."""
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored, score = score_documents(docs, fit(docs, labels))
    return scored.select(
        "doc_id", (~F.coalesce(training_rows(F.col("doc_id")), F.lit(True))).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
