"""Quality rules: surface counts of a text, and a perplexity band per language from a modified Kneser-Ney trigram model.

The model is counted by Spark in two passes over all documents. The first counts words and names those with a share of
at least WORD_SHARE; any other word is one of the words of its shape (case, kind of signs, length), all alike, and a word
equal to the one before it is the sign AGAIN. The second counts trigrams and bigrams of these. All texts teach the model, copies
too; a text that is not prose by its surface (menus, shouting, symbol noise, word runs, which would otherwise explain themselves)
teaches each of its n-grams once. Trigrams and bigrams that occur less than LEAST_COUNT times, as often as one text and a few
copies have them, fall back to lower orders with their whole share, so that probabilities still sum to 1. That bound does not
grow with the corpus, so the stored n-grams do; they stay dealt to the parts in which they were counted.

A third pass scores every text, by lots that ask the parts for the bits of their trigrams: bits per word, by all orders and by the lowest one alone. A language's band reaches from the
median by the lowest order less a width up to the median by all orders plus a width; widths follow the spread and grow for
short texts. Documents outside are rejected. The lower limit looks at the lowest order because a clean text with many near
copies is predictable by the higher ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, settled, text_of
from .shingles import mixed

#: Share of all words from which a word has a number of its own.
WORD_SHARE = 1e-5
#: Occurrences from which a word of a language has a number in any case, and below which it has none; occurrences of an n-gram
#: that is stored.
WORD_COUNT = 300
LEAST_COUNT = 5
#: Share of all words from which an n-gram is stored: none, whatever the corpus LEAST_COUNT alone decides.
NGRAM_SHARE = 0.0
#: Share of documents from which a language has a model of its own; rarer ones share one.
LANG_SHARE = 1e-3
#: Base rules.
LEAST_WORDS = 20
MOST_REPEATED = 0.30
WINDOW = 8
#: Band: median +- (SPREADS * spread + SLACK + SHORT / sqrt(words)), in bits per word.
SPREADS, SLACK, SHORT = 3.0, 0.35, 9.0
#: Bin of the score histogram from which medians and spreads are read, in bits.
BIN = 0.01
#: Words counted before a task sends its counts, texts worked on at once, and most words of all languages that a worker remembers.
HELD = 5_000_000
TEXTS = 256
#: Words of a lot of texts that are scored together.
LOT = 1_000_000
CACHE_ITEMS = 300_000
#: Parts of a count's share of all trigrams that one middle word may fill before its trigrams are dealt to several parts.
PER_PART = 4

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
#: Bytes within a character, after its first.
INNER = bytes(range(128, 192))
ID_BITS = 21
#: Numbers below SHAPES stand for shapes, in each language.
SHAPES = 256
START, AGAIN, STILL = 253, 254, 255


def surface(raw: bytes, words: list[bytes]) -> dict[str, int]:
    """The counts of the base rules, over the bytes of the whole text and its words."""
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    return {
        "n_words": len(words),
        "word_chars": len(raw.translate(None, SPACES + INNER)),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
    }


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows that occur twice or more; equal hashes are compared word by word."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    x = h[:n]
    for j in range(1, window):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
    in_order = np.sort(x)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(x, twice)).tolist()
    seen = Counter(tuple(words[i : i + window]) for i in at)
    cover = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if seen[tuple(words[i : i + window])] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def prose(raw: bytes, words: list[bytes]) -> bool:
    """Whether a text's surface is that of running prose, in any language: few symbols, capitals and repeats, some length."""
    n = len(words)
    if n < LEAST_WORDS or 20 * (len(raw) - len(raw.translate(None, SYMBOLS))) > n:
        return False
    if 4 * (len(raw) - len(raw.translate(None, UPPER))) > len(raw):
        return False
    return 20 * sum(map(eq, words, words[1:])) <= n


def _taught(raw: bytes, words: list[bytes], grams: np.ndarray) -> np.ndarray:
    """What a text teaches: all of its n-grams, or the different ones where its surface is not that of prose. That depends on
    the text alone, not on how rows lie."""
    return grams if prose(raw, words) else np.unique(grams)


def shape(word: str) -> int:
    """Number of a word's shape, below START."""
    core = word.rstrip(".,;:!?")
    tail = min(len(word) - len(core), 2)
    if core.isalpha():
        kind = 0 if core.islower() or not core.isupper() and core[:1].islower() and core[1:].islower() else 1 if core[1:].islower() or len(core) == 1 else 2 if core.isupper() else 3
        if not (core.islower() or core.isupper() or core[:1].isupper()):
            kind = 0
    elif any(c in "#*$%&|<>" for c in core):
        kind = 4
    elif any(c.isdigit() for c in core):
        kind = 5
    else:
        kind = 6
    return (kind * 3 + tail) * 10 + min(len(word) // 2, 9)


def _shape(word: bytes) -> int:
    """shape() of a word's bytes; ASCII is not decoded, and lower-case letters alone are not looked at further."""
    if word.isalpha() and word.islower():
        return min(len(word) // 2, 9)
    if not word.isascii():
        text = word.decode("utf-8", "replace")
        return min(len(text) // 2, 9) if text.isalpha() and text.islower() else shape(text)
    core = word.rstrip(b".,;:!?")
    if not core.isalpha():
        kind = 4 if len(core.translate(None, SYMBOLS)) < len(core) else 5 if len(core.translate(None, DIGITS)) < len(core) else 6
    elif core.islower() or not (core.isupper() or core[:1].isupper()):
        kind = 0
    else:
        kind = 1 if core[1:].islower() or len(core) == 1 else 2 if core.isupper() else 3
    return (kind * 3 + min(len(word) - len(core), 2)) * 10 + min(len(word) // 2, 9)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.col("lang").cast("string").alias("lang"))


def _raw(rows: DataFrame) -> DataFrame:
    """Rows with the bytes of their texts."""
    return rows.withColumn("text", F.col("text").cast("binary"))


def _read(batches: Iterator) -> Iterator[tuple[bytes, str | None]]:
    """(bytes of the text, lang) of each row, some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            yield from zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)


def _hash(lang: int, word: bytes) -> int:
    """56 bits of a hash, and the number of the word's shape."""
    return xxhash.xxh3_64_intdigest(word, lang) & ~255 | _shape(word)


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes before all second ones, and so on, compressed."""
    return zstandard.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 3)


def _of_planes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _coded(order: int, keys: np.ndarray) -> bytes:
    """Sorted keys: of words the steps between them, of n-grams their numbers, each as steps while those before it stay."""
    if order == 1:
        return _planes(np.diff(keys, prepend=keys.dtype.type(0)))
    fields = []
    new = np.arange(len(keys)) == 0
    for i in range(order - 1, -1, -1):
        x = (keys >> i * ID_BITS) & ((1 << ID_BITS) - 1)
        step = np.diff(x, prepend=0)
        fields.append(np.where(new, x, step))
        new = new | (step != 0)
    return _planes(np.concatenate(fields).astype(np.uint32))


def _decoded(order: int, raw: bytes) -> np.ndarray:
    if order == 1:
        return np.cumsum(_of_planes(raw, np.int64))
    steps = _of_planes(raw, np.uint32).astype(np.int64).reshape(order, -1)
    keys = np.zeros(steps.shape[1], np.int64)
    new = np.arange(len(keys)) == 0
    for step in steps:
        # Sums from the last row on at which a number before this one changed.
        summed, first = np.cumsum(step), np.flatnonzero(new)
        x = summed - np.repeat(summed[first] - step[first], np.diff(np.append(first, len(keys))))
        keys = (keys << ID_BITS) | x
        new = new | (np.diff(x, prepend=-1) != 0)
    return keys


def _packed(part: np.ndarray, order: int, keys: np.ndarray, *sums: np.ndarray):
    """One row per part: the steps between the keys of n-grams of an order, and up to two counts of each."""
    import pyarrow as pa

    # Numbers of two bytes are sorted by digits.
    by = np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[by], prepend=-1, append=-1))
    rows = [
        (int(part[by[s]]), order, _coded(order, keys[by[s:e]]), *[_planes(c[by[s:e]].astype(np.int64 if len(sums) > 1 else np.uint32)) for c in sums])
        for s, e in zip(cuts, cuts[1:], strict=False)
    ]
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * (1 + len(sums)))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "size", "keys", "counts", "raw"][: len(kinds)])


PACKED = "part int, size int, keys binary, counts binary"


def _grouped(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys with the sums of their counts, or how often they occur."""
    by = np.argsort(keys, kind="stable") if counts else None
    keys = keys[by] if counts else np.sort(keys)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[first], *([np.add.reduceat(c[by], first) for c in counts] or [np.diff(np.append(first, len(keys)))])


def _met(batches: Iterator, *kinds: type) -> tuple[np.ndarray, ...] | None:
    """The different keys of a part and their counts."""
    rows = [
        [_decoded(row[0], row[1]), *[_of_planes(x, t) for x, t in zip(row[2:], kinds, strict=True)]]
        for batch in batches
        for row in zip(*(batch.column(i).to_pylist() for i in range(1, 3 + len(kinds))), strict=True)
    ]
    if not rows:
        return None
    keys, *counts = map(np.concatenate, zip(*rows, strict=True))
    return _grouped(keys, *(c.astype(np.int64) for c in counts))


class _WordHashes(dict):
    def __init__(self, lang: int):
        self.lang = lang

    def __missing__(self, word: bytes) -> int:
        found = self[word] = _hash(self.lang, word)
        return found


class _WordNumbers(dict):
    def __init__(self, lang: int, vocabulary: dict[int, int]):
        self.lang, self.vocabulary = lang, vocabulary

    def __missing__(self, word: bytes) -> int:
        key = _hash(self.lang, word)
        own = self.vocabulary.get(key)
        found = self[word] = self.lang * SHAPES + (key & 255) if own is None else own
        return found


class _Known:
    """Values of words by language, from dictionaries that fill themselves; they hold CACHE_ITEMS words in all, then start over."""

    def __init__(self, make):
        self.make, self.by_lang, self.held = make, {}, 0

    def of(self, lang: int, words: list[bytes], kind: type) -> np.ndarray:
        if self.held > CACHE_ITEMS:
            self.by_lang.clear()
            self.held = 0
        if (known := self.by_lang.get(lang)) is None:
            known = self.by_lang[lang] = self.make(lang)
        before = len(known)
        found = np.fromiter(map(known.__getitem__, words), kind, len(words))
        self.held += len(known) - before
        return found


class Numbers:
    """Numbers of words in a language: its own where the word is frequent, else that of its shape. shares: of all words, by
    number, or more where that isn't known; only how trigrams are dealt to tasks follows them."""

    def __init__(self, langs: dict, vocabulary: dict[int, int], shares: np.ndarray | None = None):
        self.langs, self.vocabulary, self.shares = langs, vocabulary, shares
        self.known = _Known(self._numbers)

    def _numbers(self, lang: int) -> _WordNumbers:
        return _WordNumbers(lang, self.vocabulary)

    def lang(self, name: str | None) -> int:
        return self.langs.get(name, 0)

    def of(self, lang: int, words: list[bytes]) -> np.ndarray:
        ids = self.known.of(lang, words, np.int64)
        if len(ids) > 1:
            again = np.fromiter(map(eq, words, words[1:]), bool, len(words) - 1)
            ids[1:][again] = lang * SHAPES + AGAIN
            ids[2:][again[1:] & again[:-1]] = lang * SHAPES + STILL
        return ids

    def spread(self, parts: int) -> np.ndarray:
        """By number, over how many parts the trigrams around a word are dealt: by its share, so that none fills a part."""
        if self.shares is None:
            return np.full((len(self.langs) + 1) * SHAPES + len(self.vocabulary), parts, np.uint64)
        return np.clip(np.ceil(PER_PART * parts * self.shares.astype(float)), 1, parts).astype(np.uint64)


def languages(docs: DataFrame) -> dict:
    """Number of each language with a share of at least LANG_SHARE; 0 is for all others."""
    counts = docs.groupBy(F.col("lang").cast("string").alias("lang")).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    own = counts.where(F.col("count") >= LANG_SHARE * total).orderBy(F.col("lang").asc_nulls_last()).collect()  # 1 / LANG_SHARE rows at most
    return {r["lang"]: i + 1 for i, r in enumerate(own)}


def vocabulary(docs: DataFrame, langs: dict, parts: int, share: float = WORD_SHARE) -> tuple[dict[int, int], int, np.ndarray, np.ndarray]:
    """Numbers of the words with at least a share, by hash, the number of words counted, by shape how many different words
    have no number, and the shares of Numbers."""

    def count(batches: Iterator) -> Iterator:
        known = _Known(_WordHashes)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator:
            keys, n = _grouped(np.concatenate(held))
            held.clear()
            if len(keys):
                yield _packed((keys % np.uint64(parts)).astype(np.int64), 1, keys, n)

        for raw, lang in _read(batches):
            words = raw.split()
            held.append(_taught(raw, words, known.of(langs.get(lang, 0), words, np.uint64)))
            size += len(words)
            if size > HELD:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def reduce(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if found := _met(batches, np.uint32):
            keys, c = found
            # Words that occur once are summed up by shape, in rows of key null.
            some = c > 1
            once = np.bincount(keys[~some] & 255, minlength=SHAPES)
            shapes = np.flatnonzero(once)
            keys = pa.array(np.concatenate((keys[some], shapes)), mask=np.arange(some.sum() + len(shapes)) >= some.sum())
            rest = np.concatenate((np.zeros(some.sum(), np.int64), shapes))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate((c[some], once[shapes])), pa.int64()), pa.array(rest, pa.int64())], names=["key", "n", "shape"])

    counted = settled(_raw(_rows(docs)).mapInArrow(frugal(count), PACKED).repartitionById(parts, "part").mapInArrow(frugal(reduce), "key long, n long, shape long"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    first = (len(langs) + 1) * SHAPES
    frequent = counted.where((F.col("key").isNotNull()) & (F.col("n") >= max(LEAST_COUNT, min(share * total, WORD_COUNT))))
    # ID_BITS hold so many numbers; beyond them the rarest words stand for their shape.
    frequent = frequent.orderBy(F.desc("n"), "key").limit((1 << ID_BITS) - first).select("key", "n").toArrow()
    # The most frequent come first: small numbers make packed keys short.
    keys, n = (frequent.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    # How many different words have each shape, but for those with numbers.
    by_shape = F.when(F.col("key").isNull(), F.col("shape")).otherwise(F.col("key").bitwiseAND(255))
    words = counted.groupBy(by_shape.alias("s")).agg(F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(1)).alias("n"), F.sum("n").alias("every")).collect()  # 256 rows at most
    others, rare = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for r in words:
        others[r["s"]], rare[r["s"]] = r["n"], r["every"]
    others -= np.bincount(keys & 255, minlength=SHAPES)
    rare -= np.bincount(keys & 255, n, SHAPES).astype(np.int64)
    # Of a shape only what all languages have together is known, of the signs nothing.
    rare[START:] = total
    shares = (np.concatenate((np.tile(rare, len(langs) + 1), n)) / max(total, 1)).astype(np.float32)
    return {int(k): first + i for i, k in enumerate(keys.view(np.uint64))}, total, others, shares


def dealt(keys: np.ndarray, spread: np.ndarray, parts: int) -> np.ndarray:
    """The parts of turned trigrams: they meet with their context, and those of a word that is not frequent all in one part, which
    so counts its bigrams."""
    word, before = keys >> 2 * ID_BITS, (keys >> ID_BITS) & ((1 << ID_BITS) - 1)
    return _part(word, mixed(before.astype(np.uint64)) % spread[word], parts)


def _part(word: np.ndarray, side: np.ndarray, parts: int) -> np.ndarray:
    return (mixed((word << ID_BITS).astype(np.uint64) + side) % np.uint64(parts)).astype(np.int64)


def ngram_counts(docs: DataFrame, numbers, parts: int, low: float) -> DataFrame:
    """Rows (kind, key, n, total): trigrams (3) by occurrence and bigrams (2) by the different words before them, with the
    sum over their context, for at least low occurrences; words (1) by the different words before them; and counts of
    counts (kind 10 + order, key 1 to 4)."""

    def count(batches: Iterator) -> Iterator:
        known: Numbers = numbers.value
        spread = known.spread(parts)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator:
            keys, n = _grouped(np.concatenate(held))
            held.clear()
            if not len(keys):
                return
            yield _packed(dealt(keys, spread, parts), 3, keys, n)

        for raw, lang in _read(batches):
            g = known.lang(lang)
            words = raw.split()
            held.append(_taught(raw, words, turned(trigrams(known.of(g, words), g))))
            size += len(words)
            if size > HELD:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    def of_context(keys: np.ndarray) -> np.ndarray:
        return (mixed((keys >> ID_BITS).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)

    def rows(kind: int, key: np.ndarray, n: np.ndarray, total: np.ndarray | None = None):
        import pyarrow as pa

        columns = [np.full(len(key), kind, np.int32), key, n, n if total is None else total]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 3), strict=True)], names=["kind", "key", "n", "total"])

    def model_rows(order: int, k: np.ndarray, c: np.ndarray, raw: np.ndarray) -> Iterator:
        _, context = np.unique(k >> ID_BITS, return_inverse=True)
        total = np.bincount(context, c).astype(np.int64)[context]
        # What occurs a few times, perhaps in the text that is judged alone, does not explain that text.
        kept = raw >= low
        yield rows(order, turned(k[kept]) if order == 3 else k[kept], c[kept], total[kept])
        yield rows(10 + order, np.arange(1, 5), np.array([(c == i).sum() for i in range(1, 5)]))

    def reduce(batches: Iterator) -> Iterator:
        """The trigrams of a part, and packed by part their bigrams: each trigram is one word before its bigram."""
        import pyarrow as pa

        def padded(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(i) if (i := batch.schema.get_field_index(f.name)) >= 0 else pa.nulls(batch.num_rows, f.type) for f in fields], schema=fields)

        fields = pa.schema([(x, pa.int32() if x in ("kind", "part", "size") else pa.int64() if x in ("key", "n", "total") else pa.binary()) for x in ("kind", "key", "n", "total", "part", "size", "keys", "counts", "raw")])
        if found := _met(batches, np.uint32):
            k, c = found
            yield from map(padded, model_rows(3, k, c, c))
            pairs, different, raw = _grouped((k >> 2 * ID_BITS << ID_BITS) | (k & ((1 << ID_BITS) - 1)), np.ones(len(k), np.int64), c)
            yield padded(_packed(of_context(pairs), 2, pairs, different, raw))

    def lower(batches: Iterator) -> Iterator:
        if found := _met(batches, np.int64, np.int64):
            k, c, raw = found
            yield from model_rows(2, k, c, raw)
            yield rows(1, *np.unique(k & ((1 << ID_BITS) - 1), return_counts=True))

    plain = "kind int, key long, n long, total long"
    packed = "part int, size int, keys binary, counts binary, raw binary"
    upper = settled(_raw(_rows(docs)).mapInArrow(frugal(count), PACKED).repartitionById(parts, "part").mapInArrow(frugal(reduce), f"{plain}, {packed}"))
    pairs = upper.where("size = 2").select("part", "size", "keys", "counts", "raw")
    return upper.where("kind is not null").select("kind", "key", "n", "total").unionByName(pairs.repartitionById(parts, "part").mapInArrow(frugal(lower), plain))


def trigrams(ids: np.ndarray, lang: int) -> np.ndarray:
    """Packed numbers of each word with the two before it; texts begin with two START signs."""
    full = np.concatenate(([lang * SHAPES + START] * 2, ids))
    return (full[:-2] << 2 * ID_BITS) | (full[1:-1] << ID_BITS) | full[2:]


def turned(tri: np.ndarray) -> np.ndarray:
    """Trigrams with their first two words exchanged, and back: with the middle word first they sort by their bigrams' context."""
    one = (1 << ID_BITS) - 1
    return ((tri >> ID_BITS) & one) << 2 * ID_BITS | (tri >> 2 * ID_BITS) << ID_BITS | tri & one


def _discounts(counts: dict[int, int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (max(counts.get(i, 0), 1) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0] + [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d[1:], 1)])


class Model:
    """log2 p(word | two before), interpolated over three orders. N-grams are sorted by the hash of their packed numbers;
    what belongs to one number is an array by number."""

    def __init__(self, size: int):
        self.uniform = 1.0 / size
        self.p1, self.rest1, self.rest2 = np.zeros(size, np.float32), 1.0, np.ones(size, np.float32)
        self.within = np.zeros(size, np.float32)
        self.arrays: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}

    def store(self, name: str, keys: np.ndarray, values: np.ndarray) -> None:
        h = mixed(keys.astype(np.uint64))
        by = np.argsort(h)
        h = np.append(h[by], np.uint64(0xFFFFFFFFFFFFFFFF))
        # Where the hashes begin that share their first bits: about as many beginnings as hashes.
        bits = max(len(h).bit_length(), 1)
        starts = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        self.arrays[name] = h, np.append(values[by], 0).astype(np.float32), starts, 64 - bits

    def learn(self, order: int, d: np.ndarray, key: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
        """Stores the n-grams of an order with discounts d; all of a context that are stored are among them."""
        # Sums in one order whatever task wrote what, so bits agree to the last digit.
        by = np.argsort(key)
        key, n, total = key[by], n[by], total[by]
        p = (n - d[np.minimum(n, 3)]) / np.maximum(total, 1)
        self.store(f"p{order}", key, p)
        contexts, at = np.unique(key >> ID_BITS, return_inverse=True)
        rest = np.maximum(1 - np.bincount(at, p, len(contexts)), 1e-6)
        if order == 3:
            self.store("rest3", contexts, rest)
        else:
            self.rest2[contexts] = rest

    def lowest(self) -> Model:
        """A model of the same words that has no n-grams yet."""
        new = Model(len(self.p1))
        new.p1, new.rest1, new.within = self.p1, self.rest1, self.within
        return new

    def get(self, name: str, keys: np.ndarray, default: float) -> np.ndarray:
        h, values, starts, shift = self.arrays[name]
        asked = mixed(keys.astype(np.uint64))
        at = starts[(asked >> np.uint64(shift)).astype(np.int64)].astype(np.int64)
        # The last hash is the greatest there is, so each search ends.
        ahead = np.flatnonzero(h[at] < asked)
        while len(ahead):
            at[ahead] += 1
            ahead = ahead[h[at[ahead]] < asked[ahead]]
        return np.where(h[at] == asked, values[at], np.float32(default))

    def plain_bits(self, tri: np.ndarray) -> np.ndarray:
        """By the lowest order alone, whose counts are of different contexts: copies and near copies do not add to it."""
        word = tri & ((1 << ID_BITS) - 1)
        return self.within[word] - np.log2(self.p1[word] + self.rest1 * self.uniform)

    def bits(self, tri: np.ndarray) -> np.ndarray:
        one = (1 << ID_BITS) - 1
        p1 = self.p1[tri & one] + self.rest1 * self.uniform
        p2 = self.get("p2", tri & ((1 << 2 * ID_BITS) - 1), 0.0) + self.rest2[(tri >> ID_BITS) & one] * p1
        rest = self.get("rest3", tri >> ID_BITS, 1.0)
        p3 = rest * p2
        # Only contexts that are stored have stored trigrams.
        known = np.flatnonzero(rest != 1.0)
        p3[known] += self.get("p3", tri[known], 0.0)
        return self.within[tri & one] - np.log2(np.maximum(p3, 1e-12))


def counted(docs: DataFrame, parts: int) -> tuple[Numbers, Model, dict[int, np.ndarray], DataFrame]:
    """Counts the whole corpus: numbers, a model of the lowest order, the discounts of the others, and their counts (kind, key, n,
    total), which stay in the shared folder."""
    langs = languages(docs)
    words, total, others, shares = vocabulary(docs, langs, parts)
    numbers = Numbers(langs, words, shares)
    sent = docs.sparkSession.sparkContext.broadcast(numbers)
    counts = settled(ngram_counts(docs, sent, parts, max(LEAST_COUNT, NGRAM_SHARE * total)))
    summed = counts.where("kind > 10 or kind = 1").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    model = Model((len(langs) + 1) * SHAPES + len(words))
    # A word without a number is one of those of its shape.
    alike = np.log2(np.maximum(others, 1)).astype(np.float32)
    alike[START:] = 0
    model.within[: (len(langs) + 1) * SHAPES] = np.tile(alike, len(langs) + 1)
    word = np.array([r["key"] for r in summed if r["kind"] == 1], np.int64)
    n = np.array([r["n"] for r in summed if r["kind"] == 1], float)
    d = _discounts({i: int((n == i).sum()) for i in range(1, 5)})
    model.p1[word] = (n - d[np.minimum(n, 3).astype(np.int64)]) / max(n.sum(), 1)
    model.rest1 = max(1 - float(model.p1.sum(dtype=float)), 1e-6)
    discounts = {order: _discounts({r["key"]: r["n"] for r in summed if r["kind"] == 10 + order}) for order in (2, 3)}
    return numbers, model, discounts, counts.where("kind in (2, 3)")


def fit(docs: DataFrame, parts: int) -> tuple[Numbers, Model]:
    """The whole model in one place, for corpora whose n-grams fit there; judged() leaves them where they were counted."""
    numbers, model, discounts, counts = counted(docs, parts)
    for order in (2, 3):
        kept = counts.where(F.col("kind") == order).select("key", "n", "total").toArrow()
        model.learn(order, discounts[order], *(kept.column(i).to_numpy() for i in range(3)))
    return numbers, model


#: The surface counts of a text.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORES = "doc_id long, h long, lang_no long, " + ", ".join(f"{x} long" for x in COUNTS) + ", bits double, plain_bits double"


def scored(docs: DataFrame, numbers: Numbers, model: Model, discounts: dict[int, np.ndarray], counts: DataFrame, parts: int) -> DataFrame:
    """One row per input row: doc_id, h (a hash of text and language), lang_no, the surface counts and bits per word (null
    without words).

    N-grams stay in the parts that they were dealt to. A lot of texts sends its different trigrams there, each once, and gets their
    bits back; what is held at once is a part's n-grams, or a lot.
    """
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast((numbers, model))

    def mean(x: np.ndarray, sizes: np.ndarray) -> pa.Array:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return pa.array(np.bincount(owner, x, len(sizes)) / np.maximum(sizes, 1), pa.float64(), mask=sizes == 0)

    def ask(batches: Iterator) -> Iterator:
        """The different trigrams of lots, packed by part, and for each lot its texts' own columns and the order of their words."""
        from pyspark import TaskContext

        known, lm = sent.value
        spread = known.spread(parts)
        lot = TaskContext.get().partitionId() << 32
        tri, own = [], []

        def flush() -> Iterator:
            sizes = np.array([len(x) for x in tri], np.int64)
            every = np.concatenate(tri)
            keys, order = np.unique(turned(every), return_inverse=True)
            to = dealt(keys, spread, parts)
            by = np.argsort(to, kind="stable")
            place = np.empty(len(keys), np.uint32)
            place[by] = np.arange(len(keys), dtype=np.uint32)
            columns = [*(pa.array(x, pa.int64()) for x in zip(*own, strict=True)), pa.array(sizes), mean(lm.plain_bits(every), sizes)]
            texts = pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "lang_no", *COUNTS, "size", "plain_bits"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema) as out:
                out.write_batch(texts)
            cuts = np.append(np.flatnonzero(np.diff(to[by], prepend=-1)), len(keys))
            rows = [(int(to[by[s]]), lot, _coded(3, keys[by[s:e]]), None) for s, e in zip(cuts, cuts[1:], strict=False)]
            rows.append((-1, lot, _planes(place[order]), sink.getvalue().to_pybytes()))
            tri.clear()
            own.clear()
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "lot", "keys", "texts"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                for doc, raw, lang, h in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    words, g = raw.split(), known.lang(lang)
                    own.append((doc, h, g, *surface(raw, words).values()))
                    tri.append(trigrams(known.of(g, words), g))
                    size += len(words)
                if size > LOT:
                    yield from flush()
                    lot, size = lot + 1, 0
        if own:
            yield from flush()

    def place(batches: Iterator) -> Iterator:
        """N-grams with the parts in which they are asked for: bigrams in all that have trigrams around their first word."""
        spread = sent.value[0].spread(parts)
        for batch in batches:
            kind, key, n, total = (batch.column(i).to_numpy() for i in range(4))
            for order in (2, 3):
                k, c, t = (x[kind == order] for x in (key, n, total))
                if order == 3:
                    to = dealt(turned(k), spread, parts)
                else:
                    times = spread[k >> ID_BITS].astype(np.int64)
                    side = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    k, c, t = (np.repeat(x, times) for x in (k, c, t))
                    to = _part(k >> ID_BITS, side.astype(np.uint64), parts)
                    # Two sides of a word may lie in one part.
                    by = np.lexsort((k, to))
                    by = by[(np.diff(to[by], prepend=-1) != 0) | (np.diff(k[by], prepend=-1) != 0)]
                    to, k, c, t = to[by], k[by], c[by], t[by]
                yield pa.RecordBatch.from_arrays([pa.array(x, u) for x, u in zip((to, np.full(len(k), order), k, c, t), (pa.int32(), pa.int32(), *[pa.int64()] * 3), strict=True)], names=["part", "kind", "key", "n", "total"])

    def answer(batches: Iterator) -> Iterator:
        """Bits of the trigrams that lots ask a part for; its n-grams come first."""
        lm, held = sent.value[1].lowest(), []
        ready = False
        for batch in batches:
            lots = batch.column(5)
            here = lots.null_count
            if here:
                held.append([batch.column(i).slice(0, here).to_numpy() for i in range(1, 5)])
            if here == batch.num_rows:
                continue
            if not ready:
                kind, key, n, total = map(np.concatenate, zip(*held, strict=True)) if held else [np.zeros(0, np.int64)] * 4
                for order in (2, 3):
                    lm.learn(order, discounts[order], *(x[kind == order] for x in (key, n, total)))
                held.clear()
                ready = True
            for part, lot, raw in zip(*(batch.column(i).slice(here).to_pylist() for i in (0, 5, 6)), strict=True):
                bits = lm.bits(turned(_decoded(3, raw))).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, lot, _planes(bits), None), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "lot", "keys", "texts"])

    def gather(batches: Iterator) -> Iterator:
        """Bits per word of a lot's texts; a lot's own row comes before its answers."""
        texts, order, bits = None, None, []

        def flush() -> Iterator:
            sizes = texts.column(len(COUNTS) + 3).to_numpy()
            every = np.concatenate(bits)[order] if bits else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([*(texts.column(i) for i in range(len(COUNTS) + 3)), mean(every, sizes), texts.column(len(COUNTS) + 4)], names=["doc_id", "h", "lang_no", *COUNTS, "bits", "plain_bits"])

        for batch in batches:
            for part, raw, own in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if part >= 0:
                    bits.append(_of_planes(raw, np.float32))
                    continue
                if texts is not None:
                    yield from flush()
                bits.clear()
                texts = pa.ipc.open_stream(own).read_next_batch()
                order = _of_planes(raw, np.uint32)
        if texts is not None:
            yield from flush()

    packed = "part int, lot long, keys binary, texts binary"
    asked = settled(_raw(_rows(docs).withColumn("h", F.xxhash64("text", "lang"))).mapInArrow(frugal(ask), packed))
    null = lambda kind: F.lit(None).cast(kind)
    ngrams = counts.select("kind", "key", "n", "total").mapInArrow(frugal(place), "part int, kind int, key long, n long, total long")
    ngrams = ngrams.select("*", null("long").alias("lot"), null("binary").alias("keys"))
    questions = asked.where("part >= 0").select("part", null("int").alias("kind"), *[null("long").alias(c) for c in ("key", "n", "total")], "lot", "keys")
    answers = ngrams.unionByName(questions).repartitionById(parts, "part").sortWithinPartitions(F.col("lot").asc_nulls_first()).mapInArrow(frugal(answer), packed)
    lots = answers.unionByName(asked.where("part < 0")).repartition(parts, "lot").sortWithinPartitions("lot", "part")
    return lots.mapInArrow(frugal(gather), SCORES)


def bands(scores: DataFrame) -> DataFrame:
    """lang_no, middle and spread of the bits per word of documents that pass the base rules, by all orders and by the lowest.

    Read from a histogram of BIN bits, so they cover all documents and do not depend on the order of rows; equal texts of a
    language, which the model knows the better the more there are, count as one: the median,
    and the distance to the quartile below (the side that noise of most kinds leaves alone) as a normal deviation.
    """
    from pyspark.sql import Window

    both = F.explode(F.create_map(F.lit("bits"), F.col("bits"), F.lit("plain_bits"), F.col("plain_bits"))).alias("which", "x")
    different = scores.where("not base_failed").groupBy("lang_no", "h").agg(F.min("bits").alias("bits"), F.min("plain_bits").alias("plain_bits"))
    bins = different.select("lang_no", both).groupBy("lang_no", "which", F.floor(F.col("x") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("lang_no", "which").orderBy("bin")
    total = F.sum("n").over(Window.partitionBy("lang_no", "which"))
    share = bins.withColumn("share", F.sum("n").over(up) / total)
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("bin"))) * BIN
    found = share.groupBy("lang_no", "which").agg(at(0.5).alias("middle"), ((at(0.5) - at(0.25)) / 0.6745).alias("spread"))
    of = lambda which, column: F.max(F.when(F.col("which") == which, F.col(column)))
    return found.groupBy("lang_no").agg(of("bits", "middle").alias("middle"), of("bits", "spread").alias("spread"), of("plain_bits", "middle").alias("plain_middle"), of("plain_bits", "spread").alias("plain_spread"))


def judged(docs: DataFrame) -> DataFrame:
    """What quality() returns, and h, a hash of text and language: rows that agree in it are judged alike."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scores = scored(docs, *counted(docs, parts), parts).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MOST_REPEATED) * F.col("n_words"))
    )
    scores = settled(scores)
    width = lambda spread: SPREADS * F.col(spread) + SLACK + SHORT / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    # As many bands as languages with a model: LANG_SHARE bounds them.
    found = (
        scores.join(F.broadcast(bands(scores)), "lang_no", "left")
        .withColumn("low", F.col("plain_middle") - width("plain_spread"))
        .withColumn("high", F.col("middle") + width("spread"))
    )
    kept = ~F.col("base_failed") & F.coalesce((F.col("plain_bits") >= F.col("low")) & (F.col("bits") <= F.col("high")), F.lit(False))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "bits", "plain_bits", "low", "high", "h"
    )


def quality(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and bits, plain_bits (bits per word by all orders and by the lowest), low, high (the least plain_bits and most bits).

    docs has doc_id, text and lang; other columns are ignored. Null counts as an empty text, which fails the base rules
    as every text under LEAST_WORDS does. Null or rare languages share one model and band. Repeated rows are judged
    each. An empty table gives no rows.
    """
    return judged(docs).drop("h")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that quality() rejects, each row judged by its own text, with or without a doc_id."""
    gone = judged(docs).where("not kept").select("doc_id", "h").distinct().toDF("gone_id", "gone_h")
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")), docs["lang"].cast("string"))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (own == gone["gone_h"]), "left_anti")
