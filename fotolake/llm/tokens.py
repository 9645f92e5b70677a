"""Token ids of whole texts with a word cache: each distinct pre-token is merged once per worker."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np

from .merging import RankMerger

#: Below this code point the split patterns' classes can be written out for Python's own regular expressions.
PLAIN_LIMIT = 0x180
#: Most pre-tokens that a worker remembers before it starts over.
CACHE_ITEMS = 1_000_000
#: English endings, which stand apart; they are looked for where no letter or number begins a pre-token.
ENDINGS = "'(?:[stmd]|re|ve|ll)"


def letters_and_numbers() -> tuple[str, str]:
    """The letters and the numbers below PLAIN_LIMIT, as the inside of a character class."""
    kinds = {c: unicodedata.category(c)[0] for c in map(chr, range(PLAIN_LIMIT))}
    return tuple("".join(re.escape(c) for c, k in kinds.items() if k == kind) for kind in "LN")


class _Pieces:
    """Pre-tokens of a text. Plain Latin texts are cut here, all others by the library's own normalisation and pre-tokens,
    as bytes; None for a text that holds the string of an added token, which only the library's encoder handles."""

    def __init__(self, merger: RankMerger, pattern: str, lower: bool):
        self.library, self.lower = merger.library, lower
        self.plain = re.compile(pattern).findall
        self.other = re.compile("[^\t\n\r -~\xa1-ſ‐-‧€]").search
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added), re.IGNORECASE if lower else 0).search if added else lambda text: None
        self.byte_of = merger.byte_of

    def of(self, text: str) -> list | None:
        if self.added(text):
            return None
        if not self.other(text):
            return self.plain(text.lower() if self.lower else text)
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        byte_of = self.byte_of
        return [bytes([byte_of[c] for c in piece]) for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]


def _bytes(pieces: list) -> list[bytes]:
    return [p if isinstance(p, bytes) else p.encode() for p in pieces]


def _learn(split: list, cache: dict, merged: Callable[[list], list]) -> None:
    """Each different pre-token of some texts that the cache lacks is merged and kept there."""
    if len(cache) > CACHE_ITEMS:
        cache.clear()
    fresh = [w for w in set(chain.from_iterable(filter(None, split))) if w not in cache]
    if fresh:
        cache.update(zip(fresh, merged(fresh), strict=True))


class CachedByteBpe:
    """Ids of a tokenizers file with byte-level pre-tokens, as little-endian unsigned 32-bit bytes.

    Pre-tokens never influence each other, so the ids of a text are those of its pre-tokens in a row, each merged in the
    ragged arrays once.
    """

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        letters, numbers = letters_and_numbers()
        # Fixed value: the split pattern of this family of vocabularies.
        pattern = rf" ?[{letters}]+| ?[{numbers}]+|{ENDINGS}| ?[^\t\n\r {letters}{numbers}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
        self.pieces = _Pieces(self.merger, pattern, False)
        self.cache: dict[str | bytes, bytes] = {}

    def merged(self, words: list) -> list[bytes]:
        flat, counts = self.merger.merge(_bytes(words))
        raw, ends = flat.astype("<u4").tobytes(), np.cumsum(4 * counts).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces.of(t) for t in texts]
        _learn(split, self.cache, self.merged)
        whole, known = self.merger.library.encode, self.cache.__getitem__
        return [
            np.array(whole(t, add_special_tokens=False).ids, "<u4").tobytes() if words is None else b"".join(map(known, words))
            for t, words in zip(texts, split, strict=True)
        ]


class CachedWordCounts:
    """Token counts of a tokenizers file with lower-cased words that carry an end-of-word sign, white space dropped.

    As CachedByteBpe; plain texts are lower-cased here, others by the library's normalisation.
    """

    def __init__(self, path: str):
        self.merger = RankMerger(path)
        letters, numbers = letters_and_numbers()
        # Fixed value: the split pattern of this family of vocabularies.
        self.pieces = _Pieces(self.merger, rf"[{letters}]+|[{numbers}]|{ENDINGS}|[^\t\n\r {letters}{numbers}]+", True)
        self.cache: dict[str | bytes, int] = {}

    def merged(self, words: list) -> list[int]:
        return self.merger.merge(_bytes(words))[1].tolist()

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pieces.of(t) for t in texts]
        _learn(split, self.cache, self.merged)
        whole, known = self.merger.library.encode, self.cache.__getitem__
        return [
            len(whole(t, add_special_tokens=False).ids) if words is None else sum(map(known, words))
            for t, words in zip(texts, split, strict=True)
        ]
