"""Masked pseudo-likelihood of whole texts under a bidirectional window network that is trained here, in numpy.

Words are numbers: frequent words have their own, others stand for their shape (see quality.py). The network predicts each
number from SIDE words to its left and to its right: an embedding per place and number, summed and squashed, then a softmax
over classes of numbers and one within the class. A word with a number of its own, or equal to the one before it, is known
by its number; any other has the share of its occurrences among those of its shape, over all texts, so each word of the
corpus has a probability of its own. Its count is looked up by a join on hashed words, not from a table in every task.

Training runs in rounds of parameter averaging. Each task's texts are dealt to the rounds, so each place is predicted in one
round; the tasks' parameters are summed in Spark by stretches of the parameter vector, weighted by their windows, so
the driver sees one vector however many tasks there are.
A document's score is the sum over all its words of log p(word | both sides).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, text_of, tidy
from .quality import _hash

SIDE = 2
HIDDEN = 16
CLASSES = 16
ROUNDS = 3
#: Most and least words of a training step; steps grow with the words that a task has seen in a round.
BATCH, LEAST_BATCH = 8192, 512
RATE = 0.1
#: Occurrences from which a word has a number of its own: this share of all words, or their square root if that is less,
#: so that the vocabulary grows with the corpus.
WORD_SHARE = 2e-3
#: Texts of a packed row, and words from which a text ends one.
TEXTS, LONG = 256, 100_000
STRETCHES = 16
#: Words held before a task sends them on, and most words that a worker remembers.
HELD = 1_500_000
CACHE_ITEMS = 400_000
#: Numbers: 0 lies beyond the ends of a text, then shapes, words equal to the one or the two before, then frequent words.
BEYOND = 0
AGAIN, STILL, SHAPE_NUMBERS = 254, 255, 256
#: What stands for a null doc_id in packed arrays.
NO_ID = np.iinfo(np.int64).min


class Network:
    """Parameters in one float32 vector: embeddings by place and number, hidden bias, and a softmax in two steps, first over
    classes (number modulo their number, CLASSES or the root of size) and then over the numbers of the class. Slots of
    numbers that do not exist have a bias so low that their share is zero."""

    def __init__(self, size: int, vector: np.ndarray | None = None):
        self.size, self.classes = size, max(CLASSES, isqrt(size))
        many, wide = self.classes, -(-size // self.classes)
        shapes = [(2 * SIDE, size, HIDDEN), (HIDDEN,), (HIDDEN, many), (many,), (many, HIDDEN, wide), (many, wide)]
        cuts = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
        fresh = vector is None
        if fresh:
            vector = np.random.default_rng(0).normal(0, 0.1, cuts[-1]).astype(np.float32)
            for i in (1, 3, 5):
                vector[cuts[i] : cuts[i + 1]] = 0
        self.vector, self.slopes = vector, None
        self.embed, self.bias, self.top, self.top_bias, self.low, self.low_bias = (vector[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], shapes, strict=False))
        if fresh:
            self.low_bias[np.arange(many)[:, None] + many * np.arange(wide) >= size] = -1e4

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.bias + self.embed[0, context[:, 0]]
        for place in range(1, 2 * SIDE):
            h += self.embed[place, context[:, place]]
        return np.tanh(h)

    def _by_class(self, word: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]:
        """Order by class, (class, from, to) of its stretches, and the slots in the classes in that order."""
        group = word % self.classes
        order = _in_order(group, self.classes)
        cuts = np.searchsorted(group[order], np.arange(self.classes + 1)).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b], word[order] // self.classes

    def log_p(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        order, stretches, slot = self._by_class(word)
        h = self.hidden(context[order])
        z = h @ self.top + self.top_bias
        found = z[np.arange(len(z)), word[order] % self.classes] - _log_sum(z)
        for c, a, b in stretches:
            z = h[a:b] @ self.low[c] + self.low_bias[c]
            found[a:b] += z[np.arange(b - a), slot[a:b]] - _log_sum(z)
        out = np.empty(len(word), np.float32)
        out[order] = found
        return out

    def train(self, context: np.ndarray, word: np.ndarray, rate: float) -> None:
        """One step down the mean log loss of a batch, each parameter's step scaled by its past slopes."""
        if self.slopes is None:
            self.slopes = Network(self.size, np.full(len(self.vector), 1e-6, np.float32))
        n, past = len(word), self.slopes
        order, stretches, slot = self._by_class(word)
        context = context[order]
        h = self.hidden(context)
        p = _slope(h @ self.top + self.top_bias, word[order] % self.classes, n)
        back = p @ self.top.T
        steps = [(self.top, past.top, h.T @ p), (self.top_bias, past.top_bias, p.sum(0))]
        for c, a, b in stretches:
            q = _slope(h[a:b] @ self.low[c] + self.low_bias[c], slot[a:b], n)
            back[a:b] += q @ self.low[c].T
            steps += [(self.low[c], past.low[c], h[a:b].T @ q), (self.low_bias[c], past.low_bias[c], q.sum(0))]
        back *= 1 - h * h
        for value, sums, slope in [*steps, (self.bias, past.bias, back.sum(0))]:
            sums += slope * slope
            value -= rate * slope / np.sqrt(sums)
        for place in range(2 * SIDE):
            by = _in_order(context[:, place], self.size)
            c = context[by, place]
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            slope, at = np.add.reduceat(back[by], first, axis=0), c[first]
            sums = past.embed[place, at] + slope * slope
            past.embed[place, at] = sums
            self.embed[place, at] -= rate * slope / np.sqrt(sums)


def _top(z: np.ndarray) -> np.ndarray:
    """The greatest of each row. Rows are short, so halves of all of them are compared at once."""
    while (n := z.shape[1]) > 1:
        half = n + 1 >> 1
        z = np.maximum(z[:, :half], z[:, n - half :])
    return z[:, 0]


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = _top(z)
    return top + np.log(np.exp(z - top[:, None]).sum(1))


def _slope(z: np.ndarray, hit: np.ndarray, n: int) -> np.ndarray:
    """Slope of the log loss by scores, over a batch of n."""
    z -= _top(z)[:, None]
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    z[np.arange(len(z)), hit] -= 1
    z /= n
    return z


#: Where the words of a window lie from the one it predicts.
AROUND = np.array([d for d in range(-SIDE, SIDE + 1) if d])


def laid(sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in a row with BEYOND around each, and the places of their words; numbers are those of all words."""
    begin = np.cumsum(sizes + 2 * SIDE) - sizes - SIDE
    flat = np.full(int(sizes.sum()) + 2 * SIDE * len(sizes), BEYOND, np.int32)
    places = np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
    flat[places] = numbers
    return flat, places


def _in_order(x: np.ndarray, below: int) -> np.ndarray:
    """A stable order; small numbers are sorted by digits."""
    return np.argsort(x.astype(np.uint16) if below <= 1 << 16 else x, kind="stable")


def windows(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The 2 * SIDE numbers around each place."""
    return flat[places[:, None] + AROUND]


class _Keys(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = _hash(0, word)
        return found


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (ids, sizes, keys) of some texts each: doc_ids, words of each text, and the keys of all their words (56 bits of a
    word's hash, and its shape). Texts are cut into words here, once; later passes read the keys."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = _Keys()
        ids: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            row = np.array(ids, np.int64), np.array([len(x) for x in held], np.int64), np.concatenate(held)
            ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=["ids", "sizes", "keys"])

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if len(cache) > CACHE_ITEMS:
                        cache.clear()
                    words = text.split()
                    # A null doc_id is the least number.
                    ids.append(NO_ID if i is None else i)
                    held.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
                    if len(ids) == TEXTS or len(words) > LONG:
                        yield flush()
        if ids:
            yield flush()

    return _rows(docs).mapInArrow(task, "ids binary, sizes binary, keys binary")


def repeats(sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which words equal the one before them in their text."""
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    again[starts] = False
    return again


class Numbers:
    """Numbers of words, from the sorted keys of the frequent ones."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = np.append(frequent, np.uint64(0xFFFFFFFFFFFFFFFF))

    def of(self, keys: np.ndarray, again: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.frequent, keys)
        ids = np.where(self.frequent[at] == keys, at + SHAPE_NUMBERS, 1 + (keys & np.uint64(255)).astype(np.int64))
        ids[again] = AGAIN
        ids[1:][again[1:] & again[:-1]] = STILL
        return ids


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)


def _stretches(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places where it stands."""
    order = np.argsort(by, kind="stable")
    cuts = np.flatnonzero(np.diff(by[order], prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(by[order[a]]), order[a:b]


def _read(batches: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The arrays of each row of keyed()."""
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield tuple(np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int64, np.uint64), strict=True))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and the text's bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))


def word_counts(texts: DataFrame, parts: int) -> DataFrame:
    """Rows (part, keys, counts), one per part: all words of all texts (as keyed), without those that equal the one before."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part, x, y = zip(*((p, keys[at].tobytes(), n[at].astype(np.int64).tobytes()) for p, at in _stretches(_part(keys, parts))), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["part", "keys", "counts"])

        for _, sizes, keys in _read(batches):
            if len(keys):
                held.append(keys[~repeats(sizes, keys)])
                size += len(held[-1])
            if size > HELD:
                yield flush()
                size = 0
        if held:
            yield flush()

    def reduce(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[int, list] = {}
        for batch in batches:
            for part, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(part, []).append((np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64)))
        for part, rows in found.items():
            keys, n = map(np.concatenate, zip(*rows, strict=True))
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order][:1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([keys[order][first].tobytes()], pa.binary()), pa.array([np.add.reduceat(n[order], first).tobytes()], pa.binary())],
                names=["part", "keys", "counts"],
            )

    schema = "part int, keys binary, counts binary"
    return texts.mapInArrow(count, schema).repartitionById(parts, "part").mapInArrow(reduce, schema)


def vocabulary(counted: DataFrame) -> tuple[Numbers, np.ndarray]:
    """Numbers of the frequent words, and the occurrences of all others by shape."""

    def sums(batches: Iterator, least: float = np.inf) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for x, y in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                keys, n = np.frombuffer(x, np.uint64), np.frombuffer(y, np.int64)
                own = n >= least
                by_shape = np.bincount((keys[~own] & np.uint64(255)).astype(np.int64), n[~own], 256).astype(np.int64)
                some = np.flatnonzero(by_shape)
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(some) + [1] * int(own.sum()), pa.int32()), pa.array(np.concatenate((some, keys[own].view(np.int64))), pa.int64()), pa.array(np.concatenate((by_shape[some], n[own])), pa.int64())], names=["kind", "key", "n"])

    schema = "kind int, key long, n long"
    total = counted.mapInArrow(sums, schema).agg(F.sum("n")).first()[0] or 0
    least = max(1.0, min(WORD_SHARE * total, sqrt(total)))
    found = counted.mapInArrow(lambda batches: sums(batches, least), schema).groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kind, key, n = (found.column(i).to_numpy() for i in range(3))
    others = np.zeros(256)
    others[key[kind == 0]] = n[kind == 0]
    return Numbers(np.sort(key[kind == 1].astype(np.int64).view(np.uint64))), others


def step(seen: int) -> int:
    return min(BATCH, max(LEAST_BATCH, seen // 8))


def fit(texts: DataFrame, numbers: Numbers, rounds: int = ROUNDS) -> Network:
    """Trains the network on every place of all texts (as keyed), each in one of the rounds."""
    spark = texts.sparkSession
    network = Network(SHAPE_NUMBERS + len(numbers.frequent) - 1)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((numbers, network.vector, network.size))

        def learn(batches: Iterator, turn=turn, sent=sent) -> Iterator:
            import pyarrow as pa
            from pyspark import TaskContext

            known, vector, size = sent.value
            own, seen = Network(size, vector.copy()), 0
            held: list[tuple[np.ndarray, np.ndarray]] = []
            waiting = 0
            for row, (_, sizes, keys) in enumerate(_read(batches)):
                if row % rounds != turn:
                    continue
                flat, places = laid(sizes, known.of(keys, repeats(sizes, keys)))
                held.append((windows(flat, places), flat[places]))
                waiting += len(places)
                if waiting >= step(seen):
                    context, word = map(np.concatenate, zip(*held, strict=True))
                    at = 0
                    while waiting - at >= (n := step(seen)):
                        own.train(context[at : at + n], word[at : at + n], RATE / (1 + turn))
                        at, seen = at + n, seen + n
                    held, waiting = [(context[at:], word[at:])], waiting - at
            if waiting:
                context, word = map(np.concatenate, zip(*held, strict=True))
                own.train(context, word, RATE / (1 + turn) * waiting / step(seen))
                seen += waiting
            if seen:
                cuts = np.linspace(0, len(vector), STRETCHES + 1).astype(int)
                me = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(STRETCHES, dtype=np.int32)), pa.array([me] * STRETCHES, pa.int64()), pa.array([seen] * STRETCHES, pa.int64()), pa.array([own.vector[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                    names=["stretch", "task", "n", "vector"],
                )

        def add(batches: Iterator) -> Iterator:
            import pyarrow as pa

            sums: dict[int, np.ndarray] = {}
            weights: dict[int, int] = {}
            for batch in batches:
                for stretch, _, n, vector in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    sums[stretch] = sums.get(stretch, 0) + n * np.frombuffer(vector, np.float32).astype(np.float64)
                    weights[stretch] = weights.get(stretch, 0) + n
            for stretch, total in sums.items():
                mean = (total / weights[stretch]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([stretch], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["stretch", "vector"])

        # In the order of tasks, so that sums of floats agree from run to run.
        met = texts.mapInArrow(learn, "stretch int, task long, n long, vector binary").repartitionById(STRETCHES, "stretch")
        with tidy(spark):
            found = met.sortWithinPartitions("stretch", "task").mapInArrow(add, "stretch int, vector binary").orderBy("stretch").collect()
        if found:
            network = Network(network.size, np.concatenate([np.frombuffer(r["vector"], np.float32) for r in found]).copy())
    return network


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, log_prob (sum of ln p over all words), per_token (their mean).

    docs has doc_id and text; other columns are ignored. Null counts as empty: no tokens, log_prob 0, per_token null. All
    texts are scored whole, repeated rows each. An empty table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = settled(keyed(docs))
    counted = settled(word_counts(texts, parts))
    numbers, others = vocabulary(counted)
    sent = docs.sparkSession.sparkContext.broadcast((numbers, fit(texts, numbers, rounds), np.log(np.maximum(others, 1))))

    def score(batches: Iterator) -> Iterator:
        """Rows (block, part, x, y, z): the texts of a block (part -1: doc_id, words, ln p so far), and by part the keys of
        words that stand for their shape with the text of each."""
        import pyarrow as pa
        from pyspark import TaskContext

        known, network, shapes = sent.value
        task, turn, size = TaskContext.get().partitionId(), 0, 0
        texts_held: list[tuple] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids, sizes, total = (np.concatenate(x) for x in zip(*texts_held, strict=True))
            keys, owner = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order], owner[order].astype(np.uint32)
            rows = [(-1, ids.tobytes(), sizes.tobytes(), total.tobytes())]
            rows += [(p, keys[at].tobytes(), owner[at].tobytes(), b"") for p, at in _stretches(_part(keys, parts))]
            part, x, y, z = zip(*rows, strict=True)
            texts_held.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | turn] * len(rows), pa.int64()), pa.array(part, pa.int32()), *[pa.array(c, pa.binary()) for c in (x, y, z)]], names=["block", "part", "x", "y", "z"])

        for ids, sizes, key in _read(batches):
            flat, places = laid(sizes, known.of(key, repeats(sizes, key)))
            lots = [places[at : at + BATCH] for at in range(0, len(places), BATCH)]
            p = np.concatenate([network.log_p(windows(flat, x), flat[x]) for x in lots] or [np.empty(0)]).astype(float)
            owner, number = np.repeat(np.arange(len(ids)), sizes), flat[places]
            open_ = number < AGAIN
            p[open_] -= shapes[number[open_] - 1]
            texts_held.append((ids, sizes, np.bincount(owner, p, len(ids))))
            held.append((key[open_], owner[open_] + size))
            size += len(ids)
            if sum(len(x[0]) for x in held) > HELD or size > HELD:
                yield flush()
                turn, size = turn + 1, 0
        if texts_held:
            yield flush()

    def look(batches: Iterator) -> Iterator:
        """Sums of ln n by text, for each block and part; the counts of a part come before what asks for them."""
        import pyarrow as pa

        for batch in batches:
            for block, part, x, y, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.frombuffer(x, np.uint64)
                if block < 0:
                    there, log_n = keys, np.log(np.frombuffer(y, np.int64))
                    continue
                text, at = np.unique(np.frombuffer(y, np.uint32), return_inverse=True)
                sums = np.bincount(at, log_n[np.searchsorted(there, keys)], len(text))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([text.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["block", "part", "x", "y", "z"])

    def total(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(ids: np.ndarray, sizes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            sums = np.minimum(sums, 0)
            mean = pa.array(sums / np.maximum(sizes, 1), pa.float64(), mask=sizes == 0)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(sizes), pa.array(sums), mean], names=["doc_id", "n_tokens", "log_prob", "per_token"])

        held = None
        for batch in batches:
            for part, x, y, z in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if part < 0:
                    if held:
                        yield rows(*held)
                    held = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), np.frombuffer(z, np.float64).copy()
                else:
                    held[2][np.frombuffer(x, np.uint32)] += np.frombuffer(y, np.float64)
        if held:
            yield rows(*held)

    schema = "block long, part int, x binary, y binary, z binary"
    scored = settled(texts.mapInArrow(score, schema))
    counts = counted.select(F.lit(-1).cast("long").alias("block"), "part", F.col("keys").alias("x"), F.col("counts").alias("y"), F.lit(b"").alias("z"))
    asked = counts.unionByName(scored.where("part >= 0")).repartitionById(parts, "part").sortWithinPartitions("part", "block")
    met = scored.where("part < 0").unionByName(asked.mapInArrow(look, schema))
    return met.repartition(parts, "block").sortWithinPartitions("block", "part").mapInArrow(total, "doc_id long, n_tokens long, log_prob double, per_token double")
