"""Removal of long byte strings that an earlier document already has, by suffix arrays over shards.

1. Every window of LENGTH bytes has an anchor, the GRAM bytes in it with the least hash (the leftmost of equals), so equal
   windows have equal anchors. Neighbouring windows with one anchor form a segment. Tasks send the hashes of anchors and
   segments and learn which anchors occur in two documents or more, and which of the different segments with such an
   anchor they are to supply: each is supplied once.
2. Those segments' bytes go to the anchor's part, with the least and the greatest doc_id that each part of the documents
   has for them; how often a segment occurs does not matter. An anchor with very many different segments is spread by
   sending its windows one by one, to the parts of their own hashes.
3. A part lays its segments in shards, builds each shard's suffix array by induced sorting and reads off the permuted
   common prefixes: windows that share LENGTH bytes stand together, and the least doc_id among them is known.
4. These go back to the parts of the documents that can lose bytes by them, where windows of a greater doc_id are marked
   and the bytes under any mark removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, text_of
from .shingles import mixed
from .suffixes import permuted_lcp, shard, suffix_array

#: Bytes of a window and of an anchor; different segments from which an anchor's windows are sent singly.
LENGTH = 50
GRAM = 16
HOT = 4096
#: Bytes worked on at once, segments and bytes held before they are sent, bytes of a shard.
PIECE = 1 << 17
HELD_SEGMENTS = 1_500_000
HELD_BYTES = 6_000_000
SHARD = 800_000
NEVER = np.iinfo(np.int64).max

PACKED = "part int, src int, a binary, b binary, c binary, d binary, e binary"


#: Powers of an odd number and of its inverse modulo 2^64, for hashes of stretches of a piece.
BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(2 * PIECE + LENGTH, base, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, window after the last, anchor's hash, segment's hash) of all segments of some texts."""
    out: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int, bytes]] = []
    size = 0

    def work() -> None:
        raw = np.frombuffer(b"".join([p[2] for p in pieces]), np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        h, step, power = raw.astype(np.uint64) + np.uint64(1), 1, BASE
        up, down = _powers()
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])))
        while step < GRAM:
            h = h[:-step] * np.uint64(power) + h[step:]
            power = power * power % (1 << 64)
            step *= 2
        h = mixed(h)
        low = np.uint64((1 << 20) - 1)
        least, step, wide = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, LENGTH - GRAM + 1
        while 2 * step <= wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < wide:
            least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
        anchor = (least & low).astype(np.int64)
        begin = np.cumsum(sizes) - sizes
        # Windows that cross into the next piece count for nothing; they stand between those of two pieces.
        inside = np.ones(len(raw), bool)
        inside[(begin + sizes)[:, None] - np.arange(1, LENGTH)] = False
        inside = inside[: len(anchor)]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        after = np.append(first[1:], len(anchor))
        use = inside[first]
        first, after = first[use], after[use]
        o = np.searchsorted(begin, first, side="right") - 1
        shift = np.array([p[1] for p in pieces])[o] - begin[o]
        f = h[anchor[first]]
        whole = (sums[after + LENGTH - 1] - sums[first]) * down[first]
        out.append((np.array([p[0] for p in pieces])[o], first + shift, after + shift, f, mixed(whole + (after - first).astype(np.uint64) + (f ^ np.uint64(BASE)))))

    for i, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, PIECE):
            piece = text[at : at + PIECE + LENGTH - 1]
            pieces.append((i, at, piece))
            size += len(piece)
            if size >= PIECE:
                work()
                pieces, size = [], 0
    if pieces:
        work()
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _emit(part: np.ndarray, src: int | np.ndarray, *columns: np.ndarray) -> Iterator:
    """One packed row per part (and src, where that is an array)."""
    import pyarrow as pa

    if not len(part):
        return
    order = np.lexsort((src, part)) if isinstance(src, np.ndarray) else np.argsort(part, kind="stable")
    src = src[order] if isinstance(src, np.ndarray) else np.full(len(part), src)
    p = part[order]
    cuts = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (src[1:] != src[:-1]), [True])))
    rows = [(int(p[s]), int(src[s]), *[c[order[s:e]].tobytes() for c in columns], *[b""] * (5 - len(columns))) for s, e in zip(cuts, cuts[1:], strict=False)]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "src", *"abcde"])


def _texts(docs: DataFrame, parts: int) -> DataFrame:
    return docs.select(
        F.coalesce(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(parts)), F.lit(0)).cast("int").alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
    )


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def shared_segments(texts: DataFrame, parts: int) -> DataFrame:
    """Packed rows: for each part of the documents (part) the segments (a) whose anchor other documents share, with what
    to do about them (b): 1 the part supplies the bytes, 2 the anchor is shared by very many."""

    def send(batches: Iterator) -> Iterator:
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator:
            f, doc, q, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((doc, f))
            f, doc, q, x = f[order], doc[order], q[order], x[order]
            group = _changes(f)
            many = np.add.reduceat(_changes(f, doc), np.flatnonzero(group)) > 1
            level = many.astype(np.uint8)[np.cumsum(group) - 1]
            order = np.lexsort((x, f, q))
            f, q, x, level = f[order], q[order], x[order], level[order]
            use = _changes(q, f, x)
            f, q, x, level = f[use], q[use], x[use], level[use]
            yield from _emit((f % np.uint64(parts)).astype(np.int64), 0, f, x, q.astype(np.uint32), level)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                part, doc, text = (rows.column(i).to_pylist() for i in range(3))
                own, _, _, f, x = segments([b"" if d is None else t.encode("utf-8", "surrogatepass") for d, t in zip(doc, text, strict=True)])
                doc = np.array([-1 if d is None else d for d in doc], np.int64)
                held.append((f, doc[own], np.array(part, np.int64)[own], x))
                n += len(f)
                if n > HELD_SEGMENTS:
                    yield from flush()
                    n = 0
        if n:
            yield from flush()

    def meet(batches: Iterator) -> Iterator:
        kinds = (np.uint64, np.uint64, np.uint32, np.uint8)
        found = [tuple(np.frombuffer(c, t) for c, t in zip(row, kinds, strict=True)) for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True)]
        if not found:
            return
        f, x, q, level = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((q, x, f))
        f, x, q, level = f[order], x[order], q[order], level[order]
        first = np.flatnonzero(_changes(f))
        rows = np.diff(np.append(first, len(f)))
        # Two rows of an anchor may still be one document's; that costs a look at the bytes, no more.
        many = np.add.reduceat(_changes(f, x), first) >= HOT
        level = np.repeat(np.maximum(np.maximum.reduceat(level, first), rows > 1) + many, rows)
        use = (level > 0) & _changes(f, x, q)
        f, x, q, level = f[use], x[use], q[use], level[use]
        task = np.where(level > 1, 2, _changes(f, x)).astype(np.uint8)
        order = np.lexsort((x, q))
        yield from _emit(q[order].astype(np.int64), 0, x[order], task[order])

    return texts.mapInArrow(send, PACKED).repartitionById(parts, "part").mapInArrow(meet, PACKED)


def _beside(texts: DataFrame, packed: DataFrame, parts: int) -> DataFrame:
    """Texts in their parts, each part's packed rows first."""
    nothing = [F.lit(None).cast("binary").alias(c) for c in "abcde"]
    rows = texts.select("part", F.lit(1).alias("turn"), "doc_id", "text", *nothing)
    lists = packed.select("part", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *"abcde")
    return lists.unionByName(rows).repartitionById(parts, "part").sortWithinPartitions("part", "turn")


def _by_part(batches: Iterator) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """(part, its packed rows, some of its texts), again and again; packed rows come with every lot of texts."""
    part, packed, texts, size = None, [], [], 0
    for batch in batches:
        for p, turn, doc, text, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                if texts:
                    yield part, packed, texts
                part, packed, texts, size = p, [], [], 0
            if not turn:
                packed.append(tuple(rest))
                continue
            raw = text.encode("utf-8", "surrogatepass")
            texts.append((doc, raw))
            size += len(raw)
            if size > HELD_BYTES:
                yield part, packed, texts
                texts, size = [], 0
    if texts:
        yield part, packed, texts


class _Known:
    """What a part knows about segments: sorted hashes and what to do about each."""

    def __init__(self, packed: list[tuple]):
        keys = np.concatenate([np.frombuffer(r[0], np.uint64) for r in packed]) if packed else np.empty(0, np.uint64)
        what = np.concatenate([np.frombuffer(r[1], np.uint8) for r in packed]) if packed else np.empty(0, np.uint8)
        order = np.argsort(keys)
        self.keys, self.what = keys[order], what[order]
        self.given = np.zeros(len(keys), bool)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of x are known, their places)."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        use = np.flatnonzero(self.keys[at] == x)
        return use, at[use]


def _windows_of(raws: list[bytes], own: list[int], first: list[int], after: list[int]) -> tuple[dict[bytes, int], np.ndarray]:
    """Different windows of some segments, and rows (window, text, place)."""
    seen: dict[bytes, int] = {}
    rows = [(seen.setdefault(raws[o][j : j + LENGTH], len(seen)), o, j) for o, s, e in zip(own, first, after, strict=True) for j in range(s, e)]
    return seen, np.array(rows, np.int64).reshape(-1, 3)


def supplied(texts: DataFrame, known: DataFrame, parts: int) -> DataFrame:
    """Packed rows (anchor's part, documents' part): segments (a: anchors, b: hashes, c: sizes of their bytes or 0 where
    another part supplies them, d: bytes, e: least and greatest doc_ids)."""

    def task(batches: Iterator) -> Iterator:
        known_part, table = None, None
        for part, packed, texts in _by_part(batches):
            if part != known_part:
                known_part, table = part, _Known(packed)
            texts = [(d, t) for d, t in texts if d is not None]
            raws, docs = [t for _, t in texts], np.array([d for d, _ in texts], np.int64)
            own, first, after, f, x = segments(raws)
            use, at = table.find(x)
            own, first, after, f, x = own[use], first[use], after[use], f[use], x[use]
            hot = table.what[at] == 2
            cold = np.flatnonzero(~hot)
            order = cold[np.lexsort((docs[own[cold]], x[cold], f[cold]))]
            new = _changes(f[order], x[order])
            low = order[new]
            high = order[np.append(new[1:], True)[: len(order)]]
            give = (table.what[at[low]] == 1) & ~table.given[at[low]]
            table.given[at[low]] = True
            pieces = [raws[o][s : e + LENGTH - 1] if g else b"" for o, s, e, g in zip(own[low].tolist(), first[low].tolist(), after[low].tolist(), give.tolist(), strict=True)]
            anchors, hashes, least, most = f[low], x[low], docs[own[low]], docs[own[high]]
            if hot.any():
                seen, rows = _windows_of(raws, own[hot].tolist(), first[hot].tolist(), after[hot].tolist())
                single = np.array([xxhash.xxh3_64_intdigest(w) for w in seen], np.uint64)
                owner = docs[rows[:, 1]]
                lows, highs = np.full(len(seen), NEVER), np.full(len(seen), -1)
                np.minimum.at(lows, rows[:, 0], owner)
                np.maximum.at(highs, rows[:, 0], owner)
                pieces += list(seen)
                anchors, hashes = np.concatenate((anchors, single)), np.concatenate((hashes, single))
                least, most = np.concatenate((least, lows)), np.concatenate((most, highs))
            yield from _supply(part, pieces, anchors, hashes, least, most, parts)

    return _beside(texts, known, parts).mapInArrow(task, PACKED)


def _supply(part: int, pieces: list[bytes], anchors: np.ndarray, hashes: np.ndarray, least: np.ndarray, most: np.ndarray, parts: int) -> Iterator:
    """Packed rows of segments by the part of the anchor."""
    import pyarrow as pa

    if not pieces:
        return
    to = (anchors % np.uint64(parts)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[by], np.arange(parts + 1))
    rows = []
    for p in np.unique(to).tolist():
        mine = by[cuts[p] : cuts[p + 1]]
        strings = [pieces[i] for i in mine.tolist()]
        rows.append((p, part, anchors[mine].tobytes(), hashes[mine].tobytes(), np.array([len(x) for x in strings], np.uint8).tobytes(), b"".join(strings), least[mine].tobytes() + most[mine].tobytes()))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "src", *"abcde"])


def least_owners(strings: list[bytes], owners: np.ndarray) -> np.ndarray:
    """For each window of each string in turn, the least owner of a string of the shard that has the window."""
    text, starts = shard(strings)
    sa = suffix_array(text, len(strings) + 1)
    lcp = permuted_lcp(text, sa, LENGTH)
    windows = np.array([len(s) - LENGTH + 1 for s in strings])
    place = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    owner = np.full(len(text), NEVER)
    owner[place] = np.repeat(owners, windows)
    # Between equal windows stand none but their equals, so other suffixes may leave the order.
    is_window = np.zeros(len(text), bool)
    is_window[place] = True
    ordered = sa[is_window[sa]]
    first = np.flatnonzero((lcp < LENGTH)[ordered])
    least = np.minimum.reduceat(owner[ordered], first)
    owner[ordered] = np.repeat(least, np.diff(first, append=len(ordered)))
    return owner[place]


def first_owners(packed: DataFrame, parts: int) -> DataFrame:
    """Packed rows per part of the documents: segments (a: hashes) by runs of windows with one least doc_id (c) from a
    window on (b); only segments of which the part has a greater doc_id than some least one."""

    def answers(rows: list[tuple]) -> Iterator:
        f, x = (np.concatenate([np.frombuffer(r[i], np.uint64) for r in rows]) for i in (1, 2))
        src = np.concatenate([np.full(len(r[3]), r[0]) for r in rows])
        low = np.concatenate([np.frombuffer(r[5], np.int64)[: len(r[3])] for r in rows])
        high = np.concatenate([np.frombuffer(r[5], np.int64)[len(r[3]) :] for r in rows])
        order = np.lexsort((x, f))
        new = _changes(f[order], x[order])
        number = np.empty(len(f), np.int64)
        number[order] = np.cumsum(new) - 1
        anchor = f[order][new]
        strings: list[bytes] = [b""] * len(anchor)
        base = 0
        for _, _, _, c, d, _ in rows:
            own = number[base : base + len(c)]
            base += len(own)
            sizes = np.frombuffer(c, np.uint8)
            ends = np.cumsum(sizes, dtype=np.int64)
            have = np.flatnonzero(sizes)
            for k, end, size in zip(own[have].tolist(), ends[have].tolist(), sizes[have].tolist(), strict=True):
                strings[k] = d[end - size : end]
        owner = np.full(len(strings), NEVER)
        np.minimum.at(owner, number, low)
        windows = np.maximum(np.fromiter(map(len, strings), np.int64, len(strings)) - LENGTH + 1, 0)
        begin = np.cumsum(windows) - windows
        least = np.empty(int(windows.sum()), np.int64)
        # Shards end between anchors, so equal windows share a shard.
        lot: list[int] = []
        size = 0
        for i in np.flatnonzero(windows).tolist():
            if size > SHARD and anchor[i] != anchor[lot[-1]]:
                _solve(lot, strings, owner, begin, windows, least)
                lot, size = [], 0
            lot.append(i)
            size += len(strings[i])
        if lot:
            _solve(lot, strings, owner, begin, windows, least)
        # Runs of windows with one least owner.
        which = np.repeat(np.arange(len(strings)), windows)
        starts = np.flatnonzero(_changes(which, least)) if len(least) else np.empty(0, np.int64)
        value, offset, of = least[starts], (starts - begin[which[starts]]).astype(np.uint8), which[starts]
        runs = np.bincount(of, minlength=len(strings))
        first_run = np.cumsum(runs) - runs
        lowest = np.full(len(strings), NEVER)
        np.minimum.at(lowest, of, value)
        ask = np.flatnonzero(lowest[number] < high)
        n = runs[number[ask]]
        at = np.repeat(first_run[number[ask]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        to = np.repeat(src[ask], n)
        yield from _emit(to.astype(np.int64), 0, np.repeat(x[ask], n), offset[at], value[at], np.ones(len(at), np.uint8))

    def task(batches: Iterator) -> Iterator:
        part, rows = None, []
        for batch in batches:
            for p, *row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if p != part and rows:
                    yield from answers(rows)
                    rows = []
                part = p
                rows.append(tuple(row))
        if rows:
            yield from answers(rows)

    return packed.repartitionById(parts, "part").sortWithinPartitions("part", "src").mapInArrow(task, PACKED)


class _Owners:
    """The answers of a part, by segment."""

    def __init__(self, packed: list[tuple]):
        kinds = (np.uint64, np.uint8, np.int64)
        x, offset, least = (np.concatenate([np.frombuffer(r[i], t) for r in packed]) if packed else np.empty(0, t) for i, t in enumerate(kinds))
        order = np.lexsort((offset, x))
        self.x, self.offset, self.least = x[order], offset[order].astype(np.int64), least[order]
        self.first = np.flatnonzero(_changes(self.x))
        self.keys, self.runs = self.x[self.first], np.diff(np.append(self.first, len(self.x)))

    def marks(self, x: np.ndarray, doc: np.ndarray, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, first byte, byte after the last) of the stretches of segments whose windows an earlier doc_id has."""
        if not len(self.keys) or not len(x):
            return (np.empty(0, np.int64),) * 3
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        use = np.flatnonzero(self.keys[at] == x)
        n = self.runs[at[use]]
        seg = np.repeat(use, n)
        run = np.repeat(self.first[at[use]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        last = _changes(seg[::-1])[::-1]
        begin = first[seg] + self.offset[run]
        end = np.where(last, after[seg], first[seg] + np.append(self.offset[run][1:], 0))
        gone = self.least[run] < doc[seg]
        return seg[gone], begin[gone], end[gone] + LENGTH - 1


def _solve(lot: list[int], strings: list[bytes], owner: np.ndarray, begin: np.ndarray, windows: np.ndarray, least: np.ndarray) -> None:
    found = least_owners([strings[i] for i in lot], owner[lot])
    n = windows[lot]
    least[np.repeat(begin[lot] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = found


def cut_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (start and end of each maximal removed run), kept (remaining bytes).

    docs has doc_id and text; other columns are ignored. A byte goes when a string of LENGTH bytes over it also starts in a
    document with a smaller doc_id; the input decides, not what is left of it. Null counts as empty, shorter texts stay
    whole. Repeated rows are cut alike, and texts under one doc_id do not cut each other. A row without doc_id neither
    cuts nor is cut. An empty table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs, parts)
    known = settled(shared_segments(texts, parts))
    found = settled(first_owners(supplied(texts, known, parts), parts))

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known_part, owners, table = None, None, None
        for part, packed, texts in _by_part(batches):
            if part != known_part:
                known_part = part
                owners, table = _Owners([r for r in packed if r[3]]), _Known([r for r in packed if not r[3]])
            raws = [t for _, t in texts]
            docs = np.array([-1 if d is None else d for d, _ in texts], np.int64)
            own, first, after, _, x = segments(raws)
            seg, a, b = owners.marks(x, docs[own], first, after)
            who = own[seg]
            use, at = table.find(x)
            use = use[table.what[at] == 2]
            if len(use):
                seen, rows = _windows_of(raws, own[use].tolist(), first[use].tolist(), after[use].tolist())
                single = np.array([xxhash.xxh3_64_intdigest(w) for w in seen], np.uint64)[rows[:, 0]]
                seg, c, d = owners.marks(single, docs[rows[:, 1]], rows[:, 2], rows[:, 2] + 1)
                who, a, b = np.concatenate((who, rows[seg, 1])), np.concatenate((a, c)), np.concatenate((b, d))
            order = np.lexsort((a, who))
            who, a, b = who[order], a[order], b[order]
            cuts = np.searchsorted(who, np.arange(len(raws) + 1)).tolist()
            out = []
            for i, (d, raw) in enumerate(zip([d for d, _ in texts], raws, strict=True)):
                spans = []
                if d is not None and cuts[i] < cuts[i + 1]:
                    s, e = a[cuts[i] : cuts[i + 1]], np.maximum.accumulate(b[cuts[i] : cuts[i + 1]])
                    new = np.concatenate(([True], s[1:] > e[:-1]))
                    spans = list(zip(s[new].tolist(), e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)].tolist(), strict=True))
                kept = b"".join([raw[x:y] for x, y in zip([0, *[y for _, y in spans]], [*[x for x, _ in spans], len(raw)], strict=True)])
                out.append((d, len(raw), [{"start": x, "end": y} for x, y in spans], kept))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "spans", "kept"])

    return _beside(texts, known.unionByName(found), parts).mapInArrow(task, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def repeats_report(docs: DataFrame) -> DataFrame:
    """cut_repeats() with a digest instead of the bytes."""
    return cut_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
