"""Toxicity of whole texts: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned: words and word beginnings that labelled toxic texts have far more often than others. It is counted
by Spark over a sample of at most TRAIN_ROWS labelled rows in FOLDS folds; a row's own fold never adds to the lexicon that
describes it, and the calibration uses scores of trees that did not see the row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic
from .common import settled, text_of

#: Most labelled rows that the classifier is fitted on (those with the least hash of doc_id), folds, most lexicon entries.
TRAIN_ROWS = 30_000
FOLDS = 5
ENTRIES = 4_000
THRESHOLD = 0.3
#: Words around a second-person word that count as near it.
NEAR = 5

# Second-person words of the languages that the corpus is expected to have.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch tu te toi ton ta tes vous votre vos "
    "tú tu ti usted ustedes vosotros tuyo su".split()
)
# Signs that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
NOT_LETTERS = re.compile(r"[\W\d_]+")
EDGES = ".,;:!?\"'()[]{}<>|#*%&$-_"
RUN = re.compile(r"(.)\1\1")

FEATURES = (
    "lexicon_share", "lexicon_log", "weight_max", "weight_mean", "weight_top_share", "distinct_log", "near_second_person",
    "second_person_share", "caps_share", "caps_lexicon", "exclaims", "questions", "lookalike_share", "inner_sign_share", "stretched_share",
    "single_letters", "n_words_log", "word_length",
)


def core_of(word: str) -> tuple[str, bool, bool]:
    """Letters of a word after undoing look-alikes, whether there were any, and whether signs stood between letters."""
    bare = word.strip(EDGES)
    plain = bare.lower()
    if plain.isalpha():
        return plain, False, False
    some = any(c.isalpha() for c in plain)
    if not some:
        return "", False, False
    seen = plain.translate(LOOKALIKES)
    core = NOT_LETTERS.sub("", seen)
    return core, seen != plain and not plain.isdigit(), NOT_LETTERS.search(seen) is not None


def units(core: str) -> list[str]:
    """What the lexicon may hold of a word: itself and its beginnings of 4 to 6 letters."""
    return [core, *[core[:n] + "~" for n in (4, 5, 6) if len(core) > n]] if len(core) > 2 else []


def _doc_units(text: str, cache: dict[str, list[str]]) -> set[str]:
    out: set[str] = set()
    for w in set(text.split()):
        if (u := cache.get(w)) is None:
            if len(cache) > 500_000:
                cache.clear()
            u = cache[w] = units(core_of(w)[0])
        out.update(u)
    return out


class Words:
    """Facts of each different word, remembered as rows of one matrix: weight, second person, caps, look-alike, inner
    sign, stretched, single letter, length, and the number of its lexicon entry."""

    WIDTH = 9

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.ids = lexicon, {}
        self.facts = np.zeros((1024, self.WIDTH), np.float32)

    def _row(self, word: str) -> list[float]:
        core, lookalike, inner = core_of(word)
        weight, entry = max(((self.lexicon.get(u, 0.0), u) for u in units(core)), default=(0.0, ""))
        caps = len(core) > 2 and word.strip(EDGES).isupper()
        number = xxhash.xxh32_intdigest(entry) % 65521 if weight else 0
        return [weight, core in SECOND_PERSON, caps, lookalike, inner, RUN.search(core) is not None, len(core) == 1, len(word), number]

    def of(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        if len(ids) > 500_000:
            ids.clear()
        found = list(map(ids.get, words))
        if None in found:
            for w in dict.fromkeys(w for w, i in zip(words, found, strict=True) if i is None):
                if len(ids) >= len(self.facts):
                    self.facts = np.concatenate((self.facts, np.zeros_like(self.facts)))
                self.facts[len(ids)] = self._row(w)
                ids[w] = len(ids)
            found = list(map(ids.__getitem__, words))
        return self.facts[np.array(found, np.int64)]

    def features(self, text: str) -> list[float]:
        """FEATURES of a whole text; all zero without words."""
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        x = self.of(words)
        w = x[:, 0]
        hit = np.flatnonzero(w)
        you = np.flatnonzero(x[:, 1])
        near = 0
        if len(hit) and len(you):
            at = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hit), np.abs(you[np.maximum(at - 1, 0)] - hit))
            near = int((gap <= NEAR).sum())
        share = x[:, 1:8].sum(0) / n
        top = w.max()
        return [
            len(hit) / n, np.log1p(len(hit)), float(top), float(w.sum() / n), float((w > 0.8 * top).sum() / n) if top else 0.0,
            np.log1p(len(set(x[hit, 8].tolist()))), near / n, float(share[0]), float(share[1]), float((x[hit, 2]).sum() / n),
            text.count("!") / n, text.count("?") / n, float(share[2]), float(share[3]), float(share[4]), float(share[5]), np.log1p(n), float(share[6]),
        ]


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, toxic, fold) of at most rows labelled documents outside the held-out quarter."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = (
        one.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))
    )
    # At most TRAIN_ROWS narrow rows.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def lexicons(train: DataFrame) -> list[dict[str, float]]:
    """FOLDS + 1 lexicons: entry k leaves out fold k, the last one uses all folds. A weight is the lower bound of the log
    odds that a text with the unit is toxic."""
    spark = train.sparkSession

    def toxic_units(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter = Counter()
        cache: dict[str, list[str]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(_doc_units(text, cache))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])

    first = train.where("toxic = 1").select("text").mapInArrow(toxic_units, "unit string, n long")
    # Units of TRAIN_ROWS texts at most, and of those the most frequent ones.
    named = [r["unit"] for r in first.groupBy("unit").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "unit").limit(20 * ENTRIES).collect()]
    sent = spark.sparkContext.broadcast({u: i for i, u in enumerate(named)})

    def counts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index, cache = sent.value, {}
        n = np.zeros((FOLDS, 2, len(index) + 1), np.int64)
        for batch in batches:
            for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                row = n[fold, toxic]
                row[-1] += 1
                row[[i for u in _doc_units(text, cache) if (i := index.get(u)) is not None]] += 1
        fold, toxic, unit = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fold, toxic, unit, n[fold, toxic, unit])], names=["fold", "toxic", "unit", "n"])

    total = np.zeros((FOLDS, 2, len(named) + 1))
    counted = train.select("text", "toxic", "fold").mapInArrow(counts, "fold long, toxic long, unit long, n long")
    for r in counted.groupBy("fold", "toxic", "unit").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        total[r["fold"], r["toxic"], r["unit"]] = r["n"]
    out = []
    for k in range(FOLDS + 1):
        n = total.sum(0) - (total[k] if k < FOLDS else 0)
        b, a = n[:, :-1]
        none, some = n[:, -1]
        odds = np.log((a + 0.5) / (some + 1)) - np.log((b + 0.5) / (none + 1)) - 1.64 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        best = np.argsort(-odds, kind="stable")[:ENTRIES]
        out.append({named[i]: float(odds[i]) for i in best.tolist() if odds[i] > 1.0})
    return out


class Scorer:
    def __init__(self, lexicon: dict[str, float], trees: Boosted, scale: Isotonic):
        self.lexicon, self.trees, self.scale = lexicon, trees, scale


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Scorer:
    """Learns lexicon, trees and calibration from the sample; its feature rows, bounded by TRAIN_ROWS, reach the driver."""
    train = settled(sample(docs, labels, rows))
    books = lexicons(train)
    sent = train.sparkSession.sparkContext.broadcast(books[:FOLDS])

    def describe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        readers = [Words(b) for b in sent.value]
        for batch in batches:
            ids, texts, toxic, folds = (c.to_pylist() for c in batch.columns)
            x = [readers[f].features(t) for t, f in zip(texts, folds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array(folds, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    found = train.select("doc_id", "text", "toxic", "fold").mapInArrow(describe, "doc_id long, toxic int, fold int, x array<double>").orderBy("doc_id", "fold").toArrow()
    y, fold = found.column("toxic").to_numpy().astype(float), found.column("fold").to_numpy()
    x = np.array(found.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    if len(set(y.tolist())) < 2:  # nothing to tell apart: every text gets the share of label 1
        x, y, fold = np.zeros((2, len(FEATURES))), np.array([0.0, y.mean() if len(y) else 0.0]), np.array([0, 1])
    least = max(2.0, min(20.0, len(y) / 100))
    raw = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            others = fold != k
            raw[~others] = Boosted(least=least).fit(x[others], y[others]).raw(x[~others])
    return Scorer(books[-1], Boosted(least=least).fit(x, y), Isotonic().fit(raw, y))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    docs has doc_id and text, labels has doc_id and toxic; other columns are ignored. Null counts as empty; an empty text
    has a score like any other. Labels without doc_id or toxic are passed over, of repeated labels the largest counts.
    Rows without doc_id are never held out. Without labels every score is near 0. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = sent.value
        reader = Words(scorer.lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = np.array([reader.features(t) for t in part.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
                score = scorer.scale.of(scorer.trees.raw(x))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(task, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
