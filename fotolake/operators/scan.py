"""Many needles in many texts at once: windows of texts are hashed and looked up among the needles' longest runs, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Signs of a run that are hashed, and the shortest run beside wildcards that tells enough to look at each place it stands at.
WIDEST, TELLING = 8, 3
#: Signs of texts looked at together, pairs compared at once, and most needle ids of a list that is handed on.
SIGNS, PAIRS, HANDED = 1 << 18, 1 << 20, 1 << 20
#: Bits of the table that tells most windows apart from all runs.
BITS = 20
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _signs(text: str) -> np.ndarray:
    """Code points, ASCII letters in lower case."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    signs[(signs >= 65) & (signs <= 90)] += 32
    return signs


def _text(signs: np.ndarray) -> str:
    return signs.tobytes().decode("utf-32-le", "surrogatepass")


def _windows(signs: np.ndarray, width: int, before: np.ndarray | None = None) -> np.ndarray:
    """A hash of each width signs in a row; before is that of width - 1."""
    if width == 1:
        return signs * STEP
    return (before[:-1] + signs[width - 1 :]) * STEP


def _spread(counts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... for counts[i] numbers each, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - counts), counts)


class _Runs:
    """The runs of one width, sorted by hash, and the needles that are known by each: their signs from its place on, and before it."""

    def __init__(self, width: int, needles: list[tuple[int, np.ndarray, int]]):
        self.width = width
        signs = np.array([n[at : at + width] for _, n, at in needles], np.uint32)
        keys = signs[:, 0] * STEP
        for i in range(1, width):
            keys = (keys + signs[:, i]) * STEP
        keys = keys * MIX
        by = np.argsort(keys, kind="stable")
        self.keys, first, self.n = np.unique(keys[by], return_index=True, return_counts=True)
        self.begin = first
        self.number = np.array([needles[i][0] for i in by], np.int64)
        self.at = np.array([needles[i][2] for i in by], np.int64)
        self.size = np.array([len(needles[i][1]) for i in by], np.int64)
        # 0 stands for any sign.
        self.signs = np.zeros((len(needles), int(self.size.max())), np.uint32)
        for row, i in enumerate(by):
            self.signs[row, : self.size[row]] = needles[i][1]
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[self.keys >> np.uint64(64 - BITS)] = True

    def found(self, hashes: np.ndarray, signs: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, number of a needle that it holds), some several times."""
        hashes = hashes * MIX
        places = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - BITS)])
        key = np.searchsorted(self.keys, hashes[places])
        key[key == len(self.keys)] = 0
        same = self.keys[key] == hashes[places]
        places, key = places[same], key[same]
        text = np.searchsorted(ends, places, "right")
        starts = np.concatenate(([0], ends))[text]
        if (self.size == self.width).all() and len(ends) * len(self.keys) <= PAIRS:
            # Where the run is all there is, one of its places in a text will do.
            whole = places + self.width <= ends[text]
            first = np.full(len(ends) * len(self.keys), -1)
            first[text[whole] * len(self.keys) + key[whole]] = np.flatnonzero(whole)
            one = first[first >= 0]
            places, key, text, starts = places[one], key[one], text[one], starts[one]
        counts = self.n[key]
        at, total = 0, np.cumsum(counts)
        while at < len(places):
            to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS // self.signs.shape[1], "right")), at + 1)
            part = slice(at, to)
            rows = _spread(counts[part], self.begin[key[part]])
            of = np.repeat(np.arange(at, to), counts[part])
            begin = places[of] - self.at[rows]
            inside = (begin >= starts[of]) & (begin + self.size[rows] <= ends[text[of]])
            rows, of, begin = rows[inside], of[inside], begin[inside]
            for i in range(self.signs.shape[1]):
                want = self.signs[rows, i]
                held = np.flatnonzero((want == 0) | (signs[np.minimum(begin + i, len(signs) - 1)] == want))
                rows, of, begin = rows[held], of[held], begin[held]
            yield text[of], self.number[rows]
            at = to


class Finder:
    """Needles (asks, needle) to be found in texts: anywhere, ASCII case ignored, with % for anything and _ for one sign."""

    def __init__(self, asks: np.ndarray, needles: list[str]):
        different: dict[str, list[int]] = {}
        for i, needle in enumerate(needles):
            different.setdefault(_text(_signs(needle)), []).append(i)
        self.n = np.array([len(x) for x in different.values()], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        self.asks = np.asarray(asks)[np.array([i for x in different.values() for i in x], np.int64)]
        by_width: dict[int, list] = {}
        self.patterns = []
        for number, needle in enumerate(different):
            runs = [(m.end() - m.start(), -m.start()) for m in re.finditer("[^_]+", needle)]
            size, at = max(runs, default=(0, 0))
            if needle and "%" not in needle and "\0" not in needle and (size >= TELLING or size == len(needle)) and len(needle) <= 64:
                signs = _signs(needle)
                signs[signs == ord("_")] = 0
                by_width.setdefault(min(size, WIDEST), []).append((number, signs, -at))
            else:
                self.patterns.append((number, re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in needle), re.S)))
        self.runs = {width: _Runs(width, found) for width, found in by_width.items()}

    def _pairs(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ends = np.cumsum([len(t) for t in texts])
        signs = _signs("".join(texts))
        hashes = None
        for width in range(1, max(self.runs, default=0) + 1):
            if len(signs) < width:
                break
            hashes = _windows(signs, width, hashes)
            if width in self.runs:
                yield from self.runs[width].found(hashes, signs, ends)
        if self.patterns:
            whole = _text(signs)
            folded = [whole[e - len(t) : e] for t, e in zip(texts, ends.tolist(), strict=True)]
            for number, pattern in self.patterns:
                held = np.flatnonzero([pattern.search(t) is not None for t in folded])
                yield held, np.full(len(held), number)

    def held(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, sizes, asks): of some texts, by their places in the list, how many needles they hold, and which."""
        if not len(self.n):
            return
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at + len(part) < len(texts) and (not part or size < SIGNS):
                part.append(texts[at + len(part)].decode("utf-8", "replace"))
                size += len(part[-1])
            pairs = [t * len(self.n) + number for t, number in self._pairs(part)]
            pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            text, number = np.divmod(pairs, len(self.n))
            total = np.cumsum(self.n[number])
            i = 0
            while i < len(text):
                # As many lists as HANDED ids make; a long list of a text is parted.
                to = max(int(np.searchsorted(total, (total[i - 1] if i else 0) + HANDED, "right")), i + 1)
                counts = self.n[number[i:to]]
                rows, first = np.unique(text[i:to], return_index=True)
                yield at + rows, np.add.reduceat(counts, first), self.asks[_spread(counts, self.begin[number[i:to]])]
                i = to
            at += len(part)
