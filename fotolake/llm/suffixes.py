"""Suffix arrays by induced sorting and permuted longest common prefixes, over shards of many short strings, in numpy.

The strings of a shard lie in a row, each behind a separator of its own; separators sort before all bytes and among
themselves by place, so no comparison passes the end of a string. Suffixes are classed as larger (L) or smaller (S) than
the next one. The leftmost smaller ones (LMS) of each run are sorted first: their substrings by induction, and equal
substrings by what follows them, in steps that double. One more induction, a sweep over the buckets of first bytes
upwards for L and one downwards for S, orders all suffixes. A sweep moves a whole bucket per step.
"""

from __future__ import annotations

import numpy as np


def shard(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, starts): separators are 0 .. m-1, bytes m + value; starts are the strings' first places."""
    m = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, m)
    starts = np.cumsum(sizes + 1) - sizes
    text = np.empty(int(sizes.sum()) + m + 1, np.int32)
    spot = np.ones(len(text), bool)
    seps = starts - 1
    spot[seps] = False
    spot[-1] = False
    text[spot] = np.frombuffer(b"".join(strings), np.uint8)
    text[spot] += m + 1
    # The last separator ends the last string and is the least of all.
    text[seps] = np.arange(1, m + 1, dtype=np.int32)
    text[-1] = 0
    return text, starts


def _classes(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. Within a run of equal symbols all have the class of the run's last one."""
    n = len(text)
    last = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    small = np.empty(len(last), bool)
    small[-1] = True
    small[:-1] = text[last[:-1]] < text[last[:-1] + 1]
    return np.repeat(small, np.diff(last, prepend=-1))[:n]


def _induce(tag: np.ndarray, lms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Suffix array in which LMS suffixes stand in the given order within their buckets. tag holds a suffix's bucket, below
    zero for L; bucket 0 holds all separators."""
    n, buckets = len(tag), len(first) - 1
    sa = np.full(n, -1, np.int32)
    # LMS suffixes at the ends of their buckets.
    owner = tag[lms]
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=buckets)
    ends = np.cumsum(counts)
    at = np.arange(len(lms)) + np.repeat(first[1:] - ends, counts)
    sa[at] = lms[order]
    lms_at = first[1:] - counts

    def move(found: np.ndarray, wanted: bool, edge: np.ndarray, up: bool) -> None:
        """Puts the suffixes before found that are of the wanted class at the edges of their buckets, in order."""
        before = found[found > 0] - 1
        b = tag[before]
        use = np.flatnonzero(b > 0 if wanted else b < 0)
        if not len(use):
            return
        before, b = before[use], np.abs(b[use])
        # Sorts of 16-bit numbers go by digits.
        by = np.argsort(b, kind="stable")
        sizes = np.bincount(b, minlength=buckets)
        begin = np.cumsum(sizes) - sizes
        within = np.arange(len(b))
        if up:
            sa[within + np.repeat(edge - begin, sizes)] = before[by]
            edge += sizes
        else:
            sa[np.repeat(edge - 1 + begin, sizes) - within] = before[by]
            edge -= sizes

    edge = first[:-1].copy()
    for c in range(buckets):
        done = first[c]
        if c:
            while done < edge[c]:
                new = edge[c]
                move(sa[done:new], False, edge, True)
                done = new
        move(sa[lms_at[c] : first[c + 1]], False, edge, True)
    # S suffixes are placed anew, from above; the separators keep their order.
    ceiling = first[1:].copy()
    stop = edge.copy()
    for c in range(buckets - 1, 0, -1):
        done = first[c + 1]
        while done > ceiling[c]:
            new = ceiling[c]
            move(sa[new:done][::-1], True, ceiling, False)
            done = new
        move(sa[first[c] : stop[c]][::-1], True, ceiling, False)
    return sa


def _single(text: np.ndarray) -> np.ndarray:
    """True where a symbol occurs but once, as all separators do."""
    return (np.bincount(text) == 1)[text]


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on, by their lowest eight bits, in which bytes differ whatever was added to them."""
    raw = np.append(text.astype(np.uint8), np.zeros(8, np.uint8))
    return np.ndarray(len(text), "<u8", raw, strides=(1,))


def _lms_names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(LMS substrings in order, by place in lms; which of them equal the one before), given the order of their places."""
    n = len(text)
    index = np.empty(n, np.int32)
    index[lms] = np.arange(len(lms), dtype=np.int32)
    size = np.diff(np.append(lms, np.int32(n))) + 1
    size[-1] = 1
    # Separators are leftmost ones themselves, so they stand only at the ends of a substring.
    single = _single(text)
    size[single[lms] | single[lms + size - 1]] = 0
    i = index[ordered]
    size, eights = size[i], _eights(text)
    same = np.concatenate(([False], (size[1:] == size[:-1]) & (size[1:] > 0)))
    live = np.flatnonzero(same)
    a, b, left = ordered[live - 1], ordered[live], size[live]
    while len(live):
        other = (eights[a] ^ eights[b]) << (8 * np.maximum(8 - left, 0)).astype(np.uint64)
        same[live[other != 0]] = False
        on = np.flatnonzero((other == 0) & (left > 8))
        a, b, live, left = a[on] + 8, b[on] + 8, live[on], left[on] - 8
    return i, same


def _sorted_names(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, given the order of the names and which of them equal the one before:
    names that are still equal are told apart by the ranks of what follows 1, 2, 4 ... names on, until all differ."""
    n = len(order)
    order = order.copy()
    place = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(same, 0, place))
    # Places in order that share their rank with a neighbour; only these are sorted anew.
    tied = np.flatnonzero(same | np.append(same[1:], False))
    step = 1
    while len(tied):
        own = order[tied]
        after = own + step
        key = rank[own] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[tied] = own
        equal = np.concatenate(([False], key[1:] == key[:-1]))
        rank[own] = np.maximum.accumulate(np.where(equal, 0, tied))
        tied = tied[equal | np.append(equal[1:], False)]
        step *= 2
    return order


def suffix_array(text: np.ndarray, separators: int) -> np.ndarray:
    """Places of all suffixes in order. Symbols below separators each occur once; the least of all stands last."""
    small = _classes(text)
    # The first separator has nothing before it and counts as leftmost too.
    lms = np.flatnonzero(small & np.append(True, ~small[:-1])).astype(np.int32)
    # One bucket for all separators, then one for each byte.
    bucket = np.maximum(text - (separators - 1), 0).astype(np.int16)
    first = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=257))))
    tag = np.where(small, bucket, -bucket)
    # Separators need their final order in any induction; LMS among them come first.
    apart = text[lms] < separators
    start = np.concatenate((lms[apart][np.argsort(text[lms[apart]])], lms[~apart]))
    rough = _induce(tag, start, first)
    flag = np.zeros(len(text), bool)
    flag[lms] = True
    rough = rough[rough >= 0]
    names = _lms_names(text, lms, rough[flag[rough]])
    return _induce(tag, lms[_sorted_names(*names)], first)


def permuted_lcp(text: np.ndarray, sa: np.ndarray, least: int = 1) -> np.ndarray:
    """Common prefix of each suffix, by place, with the one before it in order; what is below least may be any number below.

    A prefix is one shorter than that of the place before unless the symbols before both suffixes differ; only those
    places are compared, eight bytes at a time, and no further than to the next symbol of either that occurs but once, as
    all separators do.
    """
    n = len(text)
    before = np.empty(n, np.int32)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    place = np.arange(n, dtype=np.int32)
    fresh = np.ones(n, bool)
    inner = np.flatnonzero(before[1:] > 0) + 1
    fresh[inner] = text[inner - 1] != text[before[inner] - 1]
    a = np.flatnonzero(fresh & (before >= 0))
    b, at = before[a], a
    ends = np.flatnonzero(_single(text))
    last = np.repeat(ends, np.diff(ends, prepend=-1))
    most = np.minimum(last[a] - a, last[b] - b)
    eights = _eights(text)
    lcp = np.zeros(n, np.int32)
    live, k = np.flatnonzero(most >= least), 0
    at, a, b, most = at[live], a[live], b[live], most[live]
    while len(at):
        other = eights[a + k] ^ eights[b + k]
        on = (other == 0) & (most > k + 8)
        over, on = np.flatnonzero(~on), np.flatnonzero(on)
        # The lowest bit that differs lies in the first byte that does; of equal words all eight are.
        bit = other[over]
        bit &= ~bit + np.uint64(1)
        equal = np.where(bit, np.frexp(bit.astype(np.float64))[1] - 1 >> 3, 8)
        lcp[at[over]] = np.minimum(k + equal, most[over])
        at, a, b, most = at[on], a[on], b[on], most[on]
        k += 8
    source = np.maximum.accumulate(np.where(fresh, place, 0))
    return np.where(before >= 0, np.maximum(lcp[source] - (place - source), 0), 0)
