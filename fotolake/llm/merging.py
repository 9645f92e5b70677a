"""Byte-pair merging of many words at once: ragged numpy arrays, one lowest-rank pair per word and round.

All words' symbols lie in one array. Every round finds each word's pair of the lowest rank, merges it wherever it stands in
the word (from the left where it overlaps itself), in all words simultaneously, and looks up the ranks of the new
neighbours; words without a known pair left drop out. A tokenizer merges the leftmost pair of the lowest rank; that comes
to the same as long as no symbol is part of a pair of a lower rank than the one that makes it, which is looked up once per
vocabulary: where it does not hold, a round merges one pair a word.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.iinfo(np.int32).max

def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte: itself where printable, else 256 and on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Merges of a byte-level BPE model in a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.signs = byte_signs()
        self.inner = np.array([vocab[s] for s in self.signs], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in self.signs], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        to = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.to = to
        # Pairs lie at the slot of their hash or, where that is taken, at the next free one.
        self.bits = (4 * len(keys)).bit_length()
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.rank_of = np.full(len(self.slots), NONE, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free][::-1]] = keys[left[free]][::-1]
            own = self.slots[at] == keys[left]
            self.rank_of[at[own][::-1]] = left[own][::-1]
            left, at = left[~own], self._next(at[~own])
        used = np.full(self.width, NONE, np.int64)
        for side in (keys // self.width, keys % self.width):
            np.minimum.at(used, side, np.arange(len(keys)))
        self.at_once = bool((used[to] > np.arange(len(to))).all())
        # Ranks of all pairs of bytes, within a word and at its end.
        self.of_bytes, self.of_last = (self.ranks(np.repeat(self.inner, 256), np.tile(right, 256)).reshape(256, 256) for right in (self.inner, self.last))
        self.byte_of = {c: i for i, c in enumerate(self.signs)}

    def _slot(self, asked: np.ndarray) -> np.ndarray:
        return ((asked.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        asked = left * self.width + right
        at = self._slot(asked)
        found = self.slots[at]
        out = np.where(found == asked, self.rank_of[at], NONE)
        # Slots of other pairs: theirs may be one of the next, up to a free one.
        open_ = np.flatnonzero((found != asked) & (found >= 0))
        asked, at = asked[open_], at[open_]
        while len(open_):
            at = self._next(at)
            found = self.slots[at]
            hit = found == asked
            out[open_[hit]] = self.rank_of[at[hit]]
            on = ~hit & (found >= 0)
            open_, asked, at = open_[on], asked[on], at[on]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many belong to each. Words are not empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        counts = np.zeros(len(words), np.int64)
        done_word: list[np.ndarray] = []
        done_sym: list[np.ndarray] = []
        # Words of like length go together, so that a long one does not hold many short ones.
        size_class = np.frexp(np.maximum(lengths, 32))[1]
        for c in np.unique(size_class):
            usual = np.flatnonzero(size_class == c)
            raw = np.frombuffer(b"".join([words[i] for i in usual.tolist()] if len(usual) < len(words) else words), np.uint8)
            sizes = lengths[usual]
            ends = np.cumsum(sizes) - 1
            sym = self.inner[raw]
            sym[ends] = self.last[raw[ends]]
            word = np.repeat(usual, sizes)
            rank = np.append(self.of_bytes[raw[:-1], raw[1:]], np.int32(NONE))
            before = ends[sizes > 1] - 1
            rank[before] = self.of_last[raw[before], raw[before + 1]]
            rank[ends] = NONE
            while True:
                first = np.flatnonzero(np.diff(word, prepend=-1))
                best = np.minimum.reduceat(rank, first)
                # Words without a pair to merge are finished: their symbols leave the arrays.
                over = best == NONE
                sizes = np.diff(np.append(first, len(word)))
                if over.any():
                    gone = np.repeat(over, sizes)
                    done_word.append(word[gone])
                    done_sym.append(sym[gone])
                    stay = ~gone
                    word, sym, rank = word[stay], sym[stay], rank[stay]
                    if not len(word):
                        break
                    best, sizes = best[~over], sizes[~over]
                    first = np.cumsum(sizes) - sizes
                hits = np.flatnonzero(rank == np.repeat(best, sizes))
                if self.at_once:
                    # Of pairs that overlap their like, every second one from the left.
                    run = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
                    at = hits[(np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits))))) % 2 == 0]
                else:
                    at = hits[np.diff(word[hits], prepend=-1) != 0]
                sym[at] = self.to[rank[at]]
                rank[at] = NONE
                keep = np.ones(len(word), bool)
                keep[at + 1] = False
                nxt = at + 2
                joined = (nxt < len(word)) & (word[np.minimum(nxt, len(word) - 1)] == word[at])
                rank[at[joined]] = self.ranks(sym[at[joined]], sym[nxt[joined]])
                before = at - 1
                led = (at > 0) & (word[before] == word[at]) & keep[before]
                rank[before[led]] = self.ranks(sym[before[led]], sym[at[led]])
                word, sym, rank = word[keep], sym[keep], rank[keep]
        if not done_word:
            return np.empty(0, np.int64), counts
        word, sym = np.concatenate(done_word), np.concatenate(done_sym)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))
