"""Scoring of texts with a causal self-attention model that backs off, word by word, to corpus-wide word counts.

One pass counts words of all training texts, of which the frequent ones become units, one counts unit pairs; the
network is fitted on all training texts too, in tasks whose parameters are averaged round by round;
the last pass scores every text in overlapping windows and sends its words, packed, to ranges of the
word hash, where the corpus counts are added up and each task's words are scored with them.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import attention
from .attention import END, Attention, Tables, Vocabulary
from .common import documents, materialise, release, shuffle_partitions, size_of_texts, small_arrow_batches, text_or_empty
from .substrings import _from_planes, _planes
from .words import SPACED, mix, split_words

#: The network sees every training text once; where these have few windows several times, FIT_SEEN in all if FIT_PASSES allow.
FIT_SEEN, FIT_PASSES = 160_000, 12
#: Windows of one task between two averagings, averagings in a pass, and windows of a text that travel together.
TASK_WINDOWS, FIT_SLICES, ROW_WINDOWS = 24_000, 4, 512
#: Rows of the table of pairs that are summed together.
PAIR_ROWS = 16
#: Rows that the parameters of a round are added up in.
SUMS = 16
#: Words of training texts that become units at most: those that occur twice or, where these are more, more often.
WORDS = 1 << 15
#: What ``fit_windows`` takes: one in FIT_ONE_IN texts, or FIT_TEXTS where that is more.
FIT_ONE_IN, FIT_TEXTS = 8, 4000
#: Share of the corpus-wide word counts in the probability of each word; the network has the rest.
UNIGRAM_SHARE = 0.5
#: Bytes of text for one range of words or so.
RANGE_BYTES = 32 << 20


def training_rows(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def frequent_words(docs: DataFrame, most: int = WORDS) -> np.ndarray:
    """Hashes of the words of ``docs`` (body) that occur ``least`` times or more, the smallest number from 2 on that ``most`` words reach at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, n = np.unique(split_words(list(pdf["body"]), SPACED, True).hashes, return_counts=True)
            yield pd.DataFrame({"word": names.view(np.int64), "n": n})

    counted = materialise(docs.select("body").mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "word-counts")
    # Numbers from 2**10 on by their two leading digits or so: a bounded number of rows.
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise((F.lit(960) + F.floor(F.log2("n") * 64) - 576).cast("long"))
    levels = sorted(((r.level, r.words, r.least) for r in counted.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()), reverse=True)
    held, least = 0, None
    for _, words, n in levels:
        held += words
        if held > most:
            break
        least = n
    if least is None:
        return np.empty(0, np.uint64)
    return np.array([r.word for r in counted.filter(F.col("n") >= least).select("word").collect()], np.int64).view(np.uint64)


def count_units(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int, int]:
    """How often each unit id occurs in all of ``docs`` (body), the number of their words and ends, and of windows to train on."""
    size = vocabulary.size

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n_words, n_windows = np.zeros(size, np.int64), 0, 0
        for pdf in batches:
            texts = list(pdf["body"])
            for piece in attention.pieces(texts):
                ids, counts, words = attention.units(texts[piece], vocabulary)
                total += np.bincount(ids, minlength=size)
                n_words += len(words.hashes) + len(counts)
                n_windows += int((-(-counts // attention.WINDOW)).sum())
        own = np.flatnonzero(total)
        yield pd.DataFrame({"unit": np.concatenate([own, [-1, -2]]).astype(np.int32), "n": np.concatenate([total[own], [n_words, n_windows]])})

    # As many rows as the vocabulary has units, and two.
    found = docs.select("body").mapInPandas(count, "unit int, n long").groupBy("unit").agg(F.sum("n").alias("n")).toPandas()
    totals = dict(zip(found["unit"], found["n"], strict=True))
    found = found[found["unit"] >= 0]
    counts = np.zeros(size, np.float64)
    counts[found["unit"].to_numpy(np.int64)] = found["n"]
    return counts, int(totals.get(-1, 0)), int(totals.get(-2, 0))


def count_pairs(docs: DataFrame, vocabulary: Vocabulary, number: np.ndarray, size: int) -> np.ndarray:
    """How often each unit number (``number`` of a unit id, below ``size``) follows each other in all of ``docs`` (body).

    Each task adds up in one array, and arrays are summed by blocks of their rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, number))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, number = sent.value
        total = np.zeros(size * size, np.uint32)
        for pdf in batches:
            texts = list(pdf["body"])
            for piece in attention.pieces(texts):
                ids, counts, _ = attention.units(texts[piece], vocabulary)
                at = number[ids]
                before = np.empty_like(at)
                before[1:] = at[:-1]
                before[np.cumsum(counts) - counts] = number[END]
                code, n = np.unique(before * np.int32(size) + at, return_counts=True)
                total[code] += n.astype(np.uint32)
        for first in range(0, size, PAIR_ROWS):
            own = total[first * size : (first + PAIR_ROWS) * size]
            if len(code := np.flatnonzero(own)):
                yield pd.DataFrame({"block": [first // PAIR_ROWS], "code": [code.astype(np.uint32).tobytes()], "n": [own[code].tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        total = np.zeros((min(size, (block + 1) * PAIR_ROWS) - block * PAIR_ROWS) * size, np.int64)
        for code, n in zip(rows["code"], rows["n"], strict=True):
            total[np.frombuffer(code, np.uint32)] += np.frombuffer(n, np.uint32)
        return pd.DataFrame({"block": [block], "n": [total.astype(np.float32).tobytes()]})

    pairs = np.zeros(size * size, np.float32)
    # Four bytes for each pair of numbers, however large the input.
    for r in docs.select("body").mapInPandas(count, "block int, code binary, n binary").groupBy("block").applyInPandas(add, "block int, n binary").collect():
        n = np.frombuffer(r.n, np.float32)
        pairs[r.block * PAIR_ROWS * size :][: len(n)] = n
    return pairs.reshape(size, size)


def fit_model(docs: DataFrame, vocabulary: Vocabulary) -> tuple[Vocabulary, Attention, Tables, int]:
    """The vocabulary with the frequent words of ``docs`` (id, body), tables and network from all of them, and the number of words and ends."""
    vocabulary = vocabulary.with_words(frequent_words(docs))
    counts, n_words, n_windows = count_units(docs, vocabulary)
    order = np.argsort(-counts, kind="stable")
    top = np.array([END, *order[(counts[order] > 0) & (order != END)][: attention.KNOWN - 1]], np.int64)
    tables = attention.tables_of(count_pairs(docs, vocabulary, attention.numbers(vocabulary.size, top), len(top) + 1), top, counts)
    model = Attention(len(top) + 1)
    train_network(docs, vocabulary, model, tables, n_windows)
    return vocabulary, model, tables, n_words


def fit_windows(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(h, before, unit): windows of a share of ``docs`` (id, body), under a hash each, for trials. ``train_network`` takes all."""
    total = docs.count()
    share = max(1 / FIT_ONE_IN, FIT_TEXTS / max(1, total))
    chosen = docs if share >= 1 else docs.filter(F.pmod(F.xxhash64("id", "body"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, counts, _ = attention.units(list(pdf["body"]), vocabulary)
            before = np.concatenate([[END], ids[:-1]]).astype(np.int32)
            stops = np.cumsum(counts)
            starts, _ = attention.cut_windows(counts)
            text = np.searchsorted(stops, starts, "right")
            h = mix(pdf["h"].to_numpy(np.int64).view(np.uint64)[text] + starts.astype(np.uint64) - (stops - counts)[text].astype(np.uint64))
            for k in range(0, len(starts), 10_000):
                pieces = [(slice(s, min(s + attention.WINDOW, e))) for s, e in zip(starts[k : k + 10_000], stops[text[k : k + 10_000]], strict=True)]
                yield pd.DataFrame({"h": (h[k : k + 10_000] >> np.uint64(1)).astype(np.int64), "before": [before[x].tobytes() for x in pieces], "unit": [ids[x].tobytes() for x in pieces]})

    return materialise(chosen.select("body", F.xxhash64("id", F.lit(5)).alias("h")).mapInPandas(cut, "h long, before binary, unit binary"), "fit-windows")


def _learner(sent: Broadcast, known: Broadcast, rounds: int, span: tuple[float, float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Trains the model that was sent on the units of a task."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        model, (_, tables) = copy.deepcopy(sent.value), known.value
        rows = rows.sort_values(["h", "numbers"])
        size = attention.WINDOW
        parts = [np.frombuffer(x, np.uint16) for x in rows["numbers"]]
        n = sum(-(-(len(x) - 1) // size) for x in parts)
        before, unit, valid = np.zeros((n, size), np.int32), np.zeros((n, size), np.int32), np.zeros((n, size), bool)
        done = 0
        for x in parts:
            m = len(x) - 1
            for to, values in ((before, x[:-1]), (unit, x[1:]), (valid, True)):
                to.reshape(-1)[done : done + m] = values
            done += -(-m // size) * size
        model.train(before, tables.of_class[unit], valid, tables, rounds, span=span)
        flat = np.concatenate([getattr(model, x).ravel() for x in model.NAMES])
        return pd.DataFrame({"task": rows["task"].iloc[:1].to_numpy(), "n": [n], "parameters": [flat.astype(np.float64).tobytes()]})

    return learn


def _add_parameters(rows: pd.DataFrame) -> pd.DataFrame:
    """The sum of the parameters of some tasks, each as often as it has windows."""
    rows = rows.sort_values("task")
    total = 0.0
    for r in rows.itertuples(index=False):
        total = total + r.n * np.frombuffer(r.parameters, np.float64)
    return pd.DataFrame({"part": rows["part"].iloc[:1].to_numpy(), "n": [int(rows["n"].sum())], "parameters": [total.tobytes()]})


def train_network(docs: DataFrame, vocabulary: Vocabulary, model: Attention, tables: Tables, total: int) -> int:
    """Fit ``model`` on all ``total`` windows of ``docs`` (id, body): tasks train on their texts, and their parameters are averaged.

    Windows follow each other without sharing units, so that a pass sees each unit once. Returns the windows that
    all passes have seen.
    """
    spark = docs.sparkSession
    passes = int(np.clip(-(-FIT_SEEN // max(1, total)), 1, FIT_PASSES))
    slices = FIT_SLICES if total > TASK_WINDOWS else 1
    tasks = -(-total // (slices * TASK_WINDOWS))
    # Without tables.within, which training has no use for.
    known = spark.sparkContext.broadcast((vocabulary, attention.Tables(tables.number, tables.of_class, None, tables.classes, tables.rare)))
    reach = ROW_WINDOWS * attention.WINDOW

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary, tables = known.value
        for pdf in batches:
            texts, h = list(pdf["body"]), pdf["h"].to_numpy(np.int64).view(np.uint64)
            for piece in attention.pieces(texts):
                ids, counts, _ = attention.units(texts[piece], vocabulary)
                numbers, out = tables.number[ids].astype(np.uint16), []
                for text, first, n in zip(h[piece], (np.cumsum(counts) - counts).tolist(), counts.tolist(), strict=True):
                    for k in range(0, n, reach):
                        # The unit before the first one, END (0) at a text's beginning, and the units.
                        before = numbers[first + k - 1 : first + k].tobytes() if k else b"\0\0"
                        out.append((int(text), k // reach, before + numbers[first + k : first + min(n, k + reach)].tobytes()))
                named = np.array([x[0] for x in out], np.uint64) + np.array([x[1] for x in out], np.uint64)
                named = (mix(named) >> np.uint64(1)).astype(np.int64)
                yield pd.DataFrame({"task": (named % tasks).astype(np.int32), "h": named, "numbers": [x[2] for x in out]})

    named = docs.select("body", F.xxhash64("id", "body").alias("h"))
    # Few windows stay in one task for all passes.
    steps = [(s, 1) for _ in range(passes) for s in range(slices)] if slices > 1 else [(0, passes)]
    trained = 0
    for k, (own, rounds) in enumerate(steps if total else []):
        learn = _learner(spark.sparkContext.broadcast(model), known, rounds, (k / len(steps), (k + 1) / len(steps)))
        rows = named.filter(F.pmod("h", F.lit(slices)) == own).mapInPandas(number, "task int, h long, numbers binary")
        dealt = rows.repartition(min(2 * tasks, shuffle_partitions(spark)), "task")
        learned = dealt.groupBy("task").applyInPandas(learn, "task int, n long, parameters binary").withColumn("part", F.col("task") % SUMS)
        sums = learned.repartition(SUMS, "part").groupBy("part").applyInPandas(_add_parameters, "part int, n long, parameters binary").collect()
        if seen := sum(r.n for r in sums):
            model.load((sum(np.frombuffer(r.parameters, np.float64) for r in sorted(sums, key=lambda r: r.part)) / seen).astype(np.float32))
            trained += seen * rounds
    return trained


def token_log10(network: np.ndarray, count: np.ndarray | float, n_train: int) -> np.ndarray:
    """log10 P(word | before) from the network's log P and the word's count among ``n_train``.

    All words that training texts lack are one unknown word for the counts, so that these sum to one. It
    counts as 1 / UNIGRAM_SHARE words: with the share its probability is one in n_train and a little.
    """
    unknown = 1 / UNIGRAM_SHARE
    return np.log10((1 - UNIGRAM_SHARE) * np.exp(network.astype(np.float64)) + UNIGRAM_SHARE * np.where(np.asarray(count) > 0, count, unknown) / (n_train + unknown))


_PACKED = "kind string, p int, batch long, a binary, b binary, c binary, d binary, e binary"


def _pack(batch: int, pdf: pd.DataFrame, words, network: np.ndarray, ends: np.ndarray, score: np.ndarray, parts: int) -> list[tuple]:
    """Rows of a batch: its texts, and by range of the hash its words with training counts, who has them and the network's log P of each."""
    held = pdf["held_out"].to_numpy(bool)
    text = np.repeat(np.arange(len(pdf)), words.counts)
    names, word = np.unique(words.hashes, return_inverse=True)
    taught = np.bincount(word, ~held[text], minlength=len(names)).astype(np.uint32)
    part = ((names >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(names), np.int64)
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    place[order] = np.arange(len(names)) - bounds[part[order]]
    uses = np.argsort(part[word], kind="stable")
    use_bounds = np.searchsorted(part[word][uses], np.arange(parts + 1))
    ids = pdf["id"].astype("Int64")
    rows = [("texts", batch % parts, batch, ids.fillna(0).to_numpy(np.int64).tobytes(), ids.isna().to_numpy().tobytes() + held.tobytes(),
             words.counts.astype(np.int64).tobytes(), score.tobytes(), ends.tobytes())]
    for p in range(parts):
        own, use = order[bounds[p] : bounds[p + 1]], uses[use_bounds[p] : use_bounds[p + 1]]
        if len(own):
            rows.append(("words", p, batch, _planes(names[own], 8), _planes(taught[own], 4), _planes(place[word[use]].astype(np.uint32), 4),
                         _planes(text[use].astype(np.uint32), 4), _planes(network[use].astype(np.float32), 4)))
    return rows


def _answer(rows: pd.DataFrame, n_train: int) -> pd.DataFrame:
    """Corpus counts of one range of words, and for each batch the sums that its texts get from them."""
    out = [tuple(r) for r in rows[rows["kind"] == "texts"].itertuples(index=False)]
    asked = rows[rows["kind"] == "words"]
    names = [_from_planes(a, 8, np.uint64) for a in asked["a"]]
    if names:
        taught = np.concatenate([_from_planes(b, 4, np.uint32) for b in asked["b"]]).astype(np.int64)
        _, at = np.unique(np.concatenate(names), return_inverse=True)
        count = np.bincount(at, taught).astype(np.int64)
        p = int(asked["p"].iloc[0])
        out.append(("total", p, 0, np.array([count.sum(), (count > 0).sum()], np.int64).tobytes(), None, None, None, None))
        first = 0
        for r, own in zip(asked.itertuples(index=False), names, strict=True):
            c = count[at[first : first + len(own)]]
            first += len(own)
            word, owner, network = (_from_planes(x, 4, t) for x, t in ((r.c, np.uint32), (r.d, np.uint32), (r.e, np.float32)))
            texts, inverse = np.unique(owner, return_inverse=True)
            logs = np.bincount(inverse, np.log10(c + 1.0)[word], len(texts))
            known = np.bincount(inverse, c[word] > 0, len(texts)).astype(np.uint32)
            model = np.bincount(inverse, token_log10(network, c[word], n_train), len(texts))
            out.append(("sums", p, r.batch, _planes(texts, 4), logs.tobytes(), _planes(known, 4), model.tobytes(), None))
    return pd.DataFrame(out, columns=[x.split()[0] for x in _PACKED.split(", ")])


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_path: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per row of ``df``: doc_id (whole numbers), held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score.

    Words are runs without white space, A-Z lower-cased, and each text ends with one more token. The base is
    the unigram with one added to each count. score is log10 of the model's probability, in which each word's
    P(word | words before) is the network's with the corpus-wide word counts as back-off (``token_log10``);
    attention_score is that of the network without them.
    Null and empty texts are one end token. A null doc_id is a training row; repeated rows are scored and
    counted each. Without training texts all counts are 0. Words are told apart by 64-bit hashes.
    """
    spark = df.sparkSession
    small_arrow_batches(spark, 2000, "4m")
    kind = df.schema[doc_id].dataType.simpleString()
    if not isinstance(df.schema[doc_id].dataType, T.IntegralType):
        raise TypeError(f"{doc_id} must be a whole number")
    vocabulary = Vocabulary.of_file(vocabulary_path)
    docs = df.select(F.col(doc_id).cast("long").alias("id"), text_or_empty(text).alias("body"), (~training_rows(F.col(doc_id))).alias("held_out"))
    vocabulary, model, tables, taught = fit_model(docs.filter("not held_out").select("id", "body"), vocabulary)
    release(spark)
    shared = spark.sparkContext.broadcast((vocabulary, model, tables))
    # Ranges of words by the size of the data, so that none grows with it.
    parts = max(shuffle_partitions(spark), -(-size_of_texts(docs, "body") // range_bytes))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        vocabulary, model, tables = shared.value
        for k, pdf in enumerate(batches):
            if len(pdf):
                # The same text again, in one batch, has the same score.
                once, again = np.unique(pdf["body"].to_numpy(object), return_inverse=True)
                network, ends, scored = attention.score_words(list(once), vocabulary, model, tables)
                score = np.bincount(np.repeat(np.arange(len(once)), scored), network, len(once)) + ends
                words = split_words(list(pdf["body"]), SPACED, True)
                at = np.repeat((np.cumsum(scored) - scored)[again] - words.firsts[:-1], words.counts) + np.arange(len(words.hashes))
                packed = _pack(TaskContext.get().partitionId() << 32 | k, pdf, words, network[at], ends[again], score[again] / np.log(10), parts)
                yield pd.DataFrame(packed, columns=[x.split()[0] for x in _PACKED.split(", ")])

    answered = materialise(docs.mapInPandas(pack, _PACKED).repartition(parts, "p").groupBy("p").applyInPandas(lambda rows: _answer(rows, taught), _PACKED), "word-answers")
    release(spark)
    # One row of totals for each range of words.
    sums = [np.frombuffer(r.a, np.int64) for r in answered.filter("kind = 'total'").select("a").toLocalIterator()]
    train_texts = docs.filter("not held_out").count()
    n_train = int(sum(s[0] for s in sums)) + train_texts
    distinct = int(sum(s[1] for s in sums)) + (train_texts > 0)
    end = np.log10(train_texts + 1.0)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows[rows["kind"] == "texts"].iloc[0]
        ids, n_words, score = np.frombuffer(texts.a, np.int64), np.frombuffer(texts.c, np.int64), np.frombuffer(texts.d, np.float64)
        missing, held = np.frombuffer(texts.b, bool).reshape(2, -1)
        logs, known = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        model = token_log10(np.frombuffer(texts.e, np.float64), train_texts, taught)
        for r in rows[rows["kind"] == "sums"].sort_values("p").itertuples(index=False):
            at = _from_planes(r.a, 4, np.uint32)
            logs[at] += np.frombuffer(r.b, np.float64)
            known[at] += _from_planes(r.c, 4, np.uint32)
            model[at] += np.frombuffer(r.d, np.float64)
        base = logs + end - (n_words + 1) * np.log10(n_train + distinct + 1.0)
        return pd.DataFrame({
            "id": pd.array(ids, dtype="Int64"), "held_out": held, "n_tokens": n_words + 1, "n_known": known + (train_texts > 0),
            "train_tokens": n_train, "base_score": base, "score": model, "attention_score": score,
        }).assign(id=lambda x: x["id"].mask(missing))

    out = answered.filter("kind <> 'total'").groupBy("batch").applyInPandas(
        finish, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, attention_score double"
    )
    return out.select(F.col("id").cast(kind).alias(doc_id), *out.columns[1:])


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` scored by a model of its training rows; null texts are one end token, repeated rows are scored each."""
    return score_texts(documents(spark, sf_dir))


QUERIES = {"op1_lm": op1_lm}
ORACLES: dict[str, str] = {}
