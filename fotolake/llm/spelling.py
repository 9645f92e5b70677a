"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A replaced letter takes one count down and another one up; an inserted or deleted letter changes one count by one. So all
near words of a word lie in a small box around its letter counts: one up and one down among the words of its length, one up
among those a letter longer, one down among those a letter shorter. For each of the three pairs of lengths a word is sent to the
cells of a k-d tree that meet its box; the task of a cell builds a tree over the cell's own points, prunes it by the same box
and compares the letters of what is left. Only counts and the best near word leave a task, never pairs.

The upper levels, which deal words to cells, are cut at medians of about SAMPLE words, twice as many at most; they decide which task compares what, and
nothing else. A word is near at most about 90 * (2 * length + 1) words, one for each possible edit, so no group of words grows
without bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, tidy

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run loses a letter when this divides its crc32.
DAMAGE = 97
#: Words that a cell of the upper levels is meant to hold, and words that they are cut by.
CELL, SAMPLE = 32_768, 100_000
#: Points of a leaf in a cell's own tree; pairs of letters compared at a time.
LEAF, PAIRS = 48, 1 << 22
#: Axes: a to z, and the other letters folded into six. Folding only brings counts nearer.
AXES = 32
_AXIS = np.zeros(256, np.int64)
_AXIS[97:123] = np.arange(26)
_AXIS[192:256] = 26 + np.arange(64) % 6
#: By how much shorter the points are than the asking word: counts that may go up, and down, on the way to a point.
BOX = {0: (1, 1), 1: (0, 1), -1: (1, 0)}


# -- words --------------------------------------------------------------------------------------------------------------


def damaged_runs(docs: DataFrame) -> DataFrame:
    """word: every run of letters, A-Z in lower case; where 97 divides h, the crc32 of doc_id:run, the letter h % length is gone.
    A null doc_id is empty in that key."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    cut = (h % F.length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), cut), F.col("run").substr(cut + 2, F.length("run")))
    return runs.select(F.when(h % DAMAGE == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least: int = 3) -> DataFrame:
    """word, n: the different words of enough letters and occurrences."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# -- points -------------------------------------------------------------------------------------------------------------


def letters(words: list[str], length: int) -> np.ndarray:
    """One row per word; all words have that many letters, of one byte each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def counts(codes: np.ndarray) -> np.ndarray:
    """The letter counts of each row, in the smallest type that holds the length."""
    n, length = codes.shape
    kind = np.int8 if length < 120 else np.int16 if length < 32_000 else np.int64
    flat = np.bincount(np.repeat(np.arange(n) * AXES, length) + _AXIS[codes].ravel(), minlength=n * AXES)
    return flat.reshape(n, AXES).astype(kind)


def meets(low: np.ndarray, high: np.ndarray, asking: np.ndarray, shorter: int) -> np.ndarray:
    """Which of the asking points can reach the box from low to high by one edit."""
    up, down = BOX[shorter]
    return (np.maximum(low - asking, 0).sum(1, dtype=np.int64) <= up) & (np.maximum(asking - high, 0).sum(1, dtype=np.int64) <= down)


class Tree:
    """A k-d tree over rows of points: inner nodes are boxes, leaves lists of rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, depth: int = 99):
        self.points, self.leaves = points, []
        self.root = self._build(np.arange(len(points)), leaf, depth)

    def _build(self, rows: np.ndarray, leaf: int, depth: int):
        own = self.points[rows]
        low, high = own.min(0), own.max(0)
        if len(rows) > leaf and depth and (high > low).any():
            axis = int(np.argmax(own.var(0)))
            order = np.sort(own[:, axis])
            cut = order[(len(rows) - 1) // 2]
            if cut == order[-1]:
                cut = order[np.searchsorted(order, cut) - 1]
            left = own[:, axis] <= cut
            return low, high, (axis, int(cut)), self._build(rows[left], leaf, depth - 1), self._build(rows[~left], leaf, depth - 1)
        self.leaves.append(rows)
        return low, high, len(self.leaves) - 1, None, None

    def visits(self, asking: np.ndarray, shorter: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of a leaf, rows of asking that may be near one of them), leaf by leaf."""
        stack = [(self.root, np.arange(len(asking)))]
        while stack:
            (low, high, what, left, right), rows = stack.pop()
            rows = rows[meets(low, high, asking[rows], shorter)]
            if not len(rows):
                continue
            if left is None:
                yield self.leaves[what], rows
            else:
                stack += [(left, rows), (right, rows)]


def one_edit(asking: np.ndarray, points: np.ndarray, shorter: int) -> np.ndarray:
    """For rows of letters, which (asking, point) pairs are exactly one replaced, deleted or inserted letter apart."""
    if shorter == 0:
        differing = np.zeros((len(asking), len(points)), np.int16 if asking.shape[1] < 32_000 else np.int64)
        for j in range(asking.shape[1]):
            differing += asking[:, j, None] != points[None, :, j]
        return differing == 1
    # The longer word without one letter is the shorter one: letters that agree from the left and from the right meet.
    longer, other = (asking, points) if shorter == 1 else (points, asking)
    n, shape = other.shape[1], (len(longer), len(other))
    reach = np.zeros(shape, np.int16 if n < 16_000 else np.int64)
    for side in (range(n), range(n - 1, -1, -1)):
        same, shift = np.ones(shape, bool), 0 if side.start == 0 else 1
        for j in side:
            same &= longer[:, j + shift, None] == other[None, :, j]
            if not same.any():
                break
            reach += same
    near = reach >= n
    return near if shorter == 1 else near.T


def near_words(points: list[str], n: np.ndarray, asking: list[str], length: int, shorter: int) -> tuple[np.ndarray, np.ndarray]:
    """For each asking word: how many of the points (all of that length) are near, and the row of the best of them, -1 if none:
    the one of largest n, the first in code-point order of equals."""
    codes, ask = letters(points, length), letters(asking, length + shorter)
    ranks = np.empty(len(points), np.int64)
    ranks[sorted(range(len(points)), key=lambda i: (-n[i], points[i]))] = np.arange(len(points))
    by_rank = np.argsort(ranks)
    found, best = np.zeros(len(asking), np.int64), np.full(len(asking), len(points), np.int64)
    ask_counts = counts(ask)
    for rows, some in Tree(counts(codes)).visits(ask_counts, shorter):
        step = max(1, PAIRS // (len(rows) * max(1, length)))
        for i in range(0, len(some), step):
            part = some[i : i + step]
            near = one_edit(ask[part], codes[rows], shorter)
            found[part] += near.sum(1)
            best[part] = np.minimum(best[part], np.where(near, ranks[rows][None, :], len(points)).min(1))
    return found, np.where(best < len(points), by_rank[np.minimum(best, len(points) - 1)], -1)


# -- cells --------------------------------------------------------------------------------------------------------------

_PLACED = "size int, cell int, asks int, word string, n bigint"


def upper_trees(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, Tree]:
    """Trees that deal the words of a length to cells, for lengths of more than cell words; cut by the sample of least hashes."""
    sizes = words.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    many = {r["size"]: r["n"] for r in sizes.collect()}  # lengths that many words have: their number is small by nature
    if not many:
        return {}
    # Words of least hashes: about sample of them, and never more than twice as many.
    share = min(1.0, sample / sum(many.values()))
    least = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    chosen = words.where(F.col("size").isin(*many) & least).limit(2 * sample).select("word", "size").collect()
    trees = {}
    for size, n in many.items():
        own = [r["word"] for r in chosen if r["size"] == size]
        if own:
            trees[size] = Tree(counts(letters(own, size)), leaf=1, depth=int(np.ceil(np.log2(n / cell))))
    return trees


def _cell_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The cell where each point lies."""
    out, stack = np.zeros(len(points), np.int64), [(tree.root, np.arange(len(points)))]
    while stack:
        (_, _, what, left, right), rows = stack.pop()
        if left is None:
            out[rows] = what
        elif len(rows):
            axis, cut = what
            low = points[rows, axis] <= cut
            stack += [(left, rows[low]), (right, rows[~low])]
    return out


def _cells_near(tree: Tree, asking: np.ndarray, shorter: int) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, rows of asking whose box meets it): cells are the half-spaces between the cuts, whatever the sample's boxes were."""
    bound = np.iinfo(asking.dtype)
    stack = [(tree.root, np.full(AXES, 0, asking.dtype), np.full(AXES, bound.max, asking.dtype), np.arange(len(asking)))]
    while stack:
        (_, _, what, left, right), low, high, rows = stack.pop()
        rows = rows[meets(low, high, asking[rows], shorter)]
        if not len(rows):
            continue
        if left is None:
            yield what, rows
            continue
        axis, cut = what
        below, above = high.copy(), low.copy()
        below[axis], above[axis] = min(below[axis], cut), max(above[axis], cut + 1)
        stack += [(left, low, below, rows), (right, above, high, rows)]


def _place(trees: dict[int, Tree]):
    """Words as points of their cell (asks 2) and as askers of cells of their own and the neighbouring lengths (asks -1, 0, 1)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
            lengths = np.array([len(w) for w in words], np.int64)
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                points = counts(letters(list(words[rows]), int(length)))
                out = []  # (size, cell or cells, asks, rows)
                own = trees.get(int(length))
                out.append((length, _cell_of(own, points) if own else 0, 2, rows))
                for shorter in BOX:
                    size = int(length) - shorter
                    if size in trees:
                        out += [(size, cell, shorter, rows[some]) for cell, some in _cells_near(trees[size], points, shorter)]
                    else:
                        out.append((size, 0, shorter, rows))
                total = np.concatenate([r for *_, r in out])
                column = lambda i: np.concatenate([np.broadcast_to(np.asarray(o[i], np.int32), len(o[3])) for o in out])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column(0)), pa.array(column(1)), pa.array(column(2)), pa.array(words[total], pa.string()), pa.array(n[total], pa.int64())],
                    names=["size", "cell", "asks", "word", "n"],
                )

    return place


_NEAR = "word string, n bigint, n_near bigint, form_n bigint, form string"
_NEAR_ARROW = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _compare(table: pa.Table) -> pa.Table:
    """A cell's points and askers: for each asker that has near words here, their number and the best one."""
    asks = table.column("asks").to_numpy()
    words, n = np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
    points = np.flatnonzero(asks == 2)
    out: list[list] = [[], [], [], [], []]
    if len(points):
        size = int(table.column("size")[0].as_py())
        for shorter in BOX:
            asking = np.flatnonzero(asks == shorter)
            if not len(asking):
                continue
            found, best = near_words(list(words[points]), n[points], list(words[asking]), size, shorter)
            some = np.flatnonzero(found)
            form = points[best[some]]
            for column, values in zip(out, (words[asking[some]], n[asking[some]], found[some], n[form], words[form]), strict=True):
                column.extend(values)
    return pa.table([pa.array(c, t) for c, t in zip(out, _NEAR_ARROW.types, strict=True)], schema=_NEAR_ARROW)


def _spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Cells cost far more time than bytes: they are dealt to all the partitions that the session has, not merged by size."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def variants(words: DataFrame, cell: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary of word and n, each word once.

    form is the near word of largest n, the first in code-point order of equals, if that n is at least twice the word's;
    else null, with form_n. root is the last of the forms that follow each other from word, which at least double n at every
    step; word itself if there is none. Words of any length are compared; an empty table gives no rows.
    """
    words = settled(words.select("word", "n", F.length("word").alias("size")))
    trees = upper_trees(words, cell)
    placed = words.select("word", "n").mapInArrow(_place(trees), _PLACED)
    with tidy(words.sparkSession):
        near = settled(_spread(placed, "size", "cell").groupBy("size", "cell").applyInArrow(_compare, _NEAR))
    # The most frequent near word, then the first one.
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    formed = words.select("word", "n").join(best, "word", "left")
    enough = -F.col("best.less") >= 2 * F.col("n")
    found = settled(
        formed.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    return found.join(_roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(found: DataFrame) -> DataFrame:
    """word, root for words that have a form: ways are doubled until they all end. As n doubles along a way, there are few rounds."""
    ways = settled(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = settled(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ways = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            return ways


def spelling_report(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """variants() of the words of docs, after the contract's damage.

    docs has doc_id and text; other columns are ignored. Null and empty texts have no words, whole texts count, repeated
    rows count again, and rows without doc_id count with an empty one. An empty table gives no rows.
    """
    return variants(vocabulary(damaged_runs(docs)), cell)
