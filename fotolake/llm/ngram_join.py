"""N-gram Jaccard self-join by count vectors in R-trees, and the groups that its links form.

1. Map tasks turn each text into its set of shingle hashes. For candidates, the hashes are dealt into more cells than two
   linked sets can differ in, so some cells with content agree wholly; a cell's content is a signature. A set is also a
   point: how many of its hashes fall into each of its axes (more for larger sets); the sum of the lesser coordinates
   bounds an overlap.
2. Within a task, equal sets hang on their least document, and sets with a common signature whose bound allows a link are
   one box: the greatest coordinates and the least size of its sets, named by its least document. Boxes send their
   signatures in packed arrays, so a hot group of copies or near copies sends one box per task. A box loses no link.
3. Boxes that meet in a signature are compared with the least of them by the bound, and those that pass are joined. A
   signature under which boxes of different groups met all the same (a passage that many texts share) has them compared
   with each other in an R-tree.
4. The texts of groups with two different sets or more move. Within a group, an R-tree over the points prunes by the same
   bound, and pairs that pass are counted exactly. Groups beyond a chunk are split; what the chunks leave unjoined is
   compared with every chunk.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolake.operators.graph import blocked
from fotolake.operators.graph import components as connected

from .common import frugal, settled, text_of
from .shingles import Shingler, mixed

#: Cells beyond those in which two linked sets can differ.
SPARE = 4
#: Axes of the count vectors, points of a leaf or node, hashes and points of a chunk, signatures that a task combines at a
#: time.
AXES, PER_AXIS = 64, 16
FANOUT = 32
CHUNK = 600_000
POINTS = 8_000
HELD = 1_000_000
#: Kinds of what map and reduce tasks hand on.
SIZES, SIZES_NO_ID, COPY_HERE, COPY, SIGNATURE, LINK, BOX, MET = range(8)


class Cells:
    """Size classes and, for each, the number of cells; min_num / min_den is the least Jaccard similarity."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.borders = num, den, [1]

    def size_class(self, n: int) -> int:
        while self.borders[-1] <= n:
            b = self.borders[-1]
            self.borders.append(max(b + 1, -(-b * self.den // self.num)))
        return bisect_right(self.borders, n) - 1

    def apart(self, c: int) -> int:
        """Most members of the symmetric difference of a linked pair whose smaller set is of class c."""
        while len(self.borders) < c + 2:
            self.size_class(self.borders[-1])
        most = self.borders[c + 1] - 1
        return (self.den - self.num) * (most + most * self.den // self.num) // (self.den + self.num)

    def cells(self, c: int) -> int:
        """Cells for such pairs: at least cells - apart of them agree, more than are empty in nearly every set."""
        return self.apart(c) + SPARE + self.apart(c) // 7

    def prefix(self, n: int) -> int:
        """Least hashes of a set of which any linked set has one among its own."""
        return n - -(-n * self.num // self.den) + 1


def signatures(sets: list[np.ndarray], cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) for all sets that are not empty, each as the smaller and as the larger of a pair.

    The content of a cell that is not empty is a signature. A set with so many empty cells that those alone could be what
    agrees is thin; two thin sets meet by their least hashes, any other pair by a cell with content.
    """
    sigs, owners = [], []
    index = [i for i, s in enumerate(sets) if len(s)]
    if not index:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    classes = [cells.size_class(len(sets[i])) for i in index]
    hashes = np.concatenate([sets[i] for i in index])
    sizes = np.array([len(sets[i]) for i in index])
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high = (hashes >> np.uint64(32)).astype(np.float64)
    spread = mixed(hashes + np.uint64(1)) >> np.uint64(16)
    for step in (0, 1):
        use = np.array([c - step >= 0 for c in classes])
        n_cells = np.array([cells.cells(c - step) if c - step >= 0 else 1 for c in classes], np.uint64)
        first = np.concatenate(([0], np.cumsum(n_cells.astype(np.int64))))
        cell = np.repeat(first[:-1], sizes) + (spread % np.repeat(n_cells, sizes)).astype(np.int64)
        count = np.bincount(cell, minlength=first[-1])
        # Sums of up to 2^21 values of 32 bits are exact in doubles; beyond that they still agree for equal cells
        # because equal sets are summed in the same order.
        a = np.bincount(cell, low, first[-1]).astype(np.uint64)
        b = np.bincount(cell, high, first[-1]).astype(np.uint64)
        owner = np.repeat(np.arange(len(index)), n_cells.astype(np.int64))
        within = np.arange(first[-1]) - first[:-1][owner]
        tag = np.array(classes, np.int64)[owner] - step
        sig = mixed(a + mixed(b + mixed((tag * 2_000_003 + within).astype(np.uint64))))
        full = (count > 0) & use[owner]
        sigs.append(sig[full])
        owners.append(owner[full])
        empty = np.bincount(owner[count == 0], minlength=len(index))
        for i in np.flatnonzero(use).tolist():
            c = classes[i] - step
            if empty[i] >= cells.cells(c) - cells.apart(c):
                least = sets[index[i]][: cells.prefix(int(sizes[i]))]
                sigs.append(mixed(least ^ mixed(np.full(len(least), c + 7_000_000_019, np.uint64))))
                owners.append(np.full(len(least), i))
    return np.concatenate(sigs), np.array(index)[np.concatenate(owners)]


def _star(keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with equal keys: the position of each run's least document first, and for every row its run's position."""
    order = np.lexsort((docs, *keys[::-1]))
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
    run = np.cumsum(new) - 1
    head = order[np.flatnonzero(new)]
    of = np.empty(len(order), np.int64)
    of[order] = head[run]
    return head, of


def _unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    differ = a != b
    a, b = a[differ], b[differ]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n reaches over pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _allowed(points: list[np.ndarray], least: np.ndarray, others: list[np.ndarray], other_least: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the bound of boxes, row by row, allows a similarity of num / den; each pair at the coarser axes of the two."""
    axes = np.array([min(len(p), len(q)) for p, q in zip(points, others, strict=True)], np.int64)
    out = np.zeros(len(axes), bool)
    for n in np.unique(axes):
        for at in np.array_split(rows := np.flatnonzero(axes == n), len(rows) * n // 4_000_000 + 1):
            both = np.minimum(np.stack([folded(points[i], n) for i in at]), np.stack([folded(others[i], n) for i in at]))
            out[at] = (num + den) * both.sum(1, dtype=np.int64) >= num * (least[at] + other_least[at])
    return out


def fingerprints(docs: DataFrame, k: int, num: int, den: int, parts: int) -> DataFrame:
    """Packed rows (part, kind, x, y, z): sizes, copies, boxes, signatures and links of each map task."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler, cells = Shingler(k), Cells(num, den)
        held: dict[str, list] = {"doc": [], "n": [], "k1": [], "k2": [], "sig": [], "owner": []}
        points: list[np.ndarray] = []
        docs_held = 0

        def emit(kind: int, part: np.ndarray, *columns: np.ndarray) -> Iterator:
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
            rows = []
            for s, e in zip(cuts, cuts[1:], strict=False):
                at = order[s:e]
                packed = [_squeezed(c[at]) for c in columns] + [b""] * (3 - len(columns))
                rows.append((int(part[at[0]]), kind, *packed))
            if rows:
                p, kd, x, y, z = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p, pa.int32()), pa.array(kd, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary()), pa.array(z, pa.binary())],
                    names=["part", "kind", "x", "y", "z"],
                )

        def flush() -> Iterator:
            nonlocal docs_held
            if not docs_held:
                return
            doc, n, k1, k2, sig, owner = (np.concatenate(held[c]) for c in held)
            point = list(points)
            points.clear()
            for c in held.values():
                c.clear()
            docs_held = 0
            to = lambda x: (x.astype(np.uint64) % np.uint64(parts)).astype(np.int64)
            of_doc = lambda x: to(mixed(x.astype(np.uint64)))
            yield from emit(SIZES, of_doc(doc), doc, n)
            some = np.flatnonzero(n > 0)
            head, of = _star([k1[some], k2[some]], doc[some])
            head, of = some[head], some[of]
            a, b = _unique_pairs(doc[some], doc[of])
            yield from emit(COPY_HERE, of_doc(a), a, b)
            yield from emit(COPY, to(k1[head]), k1[head], k2[head], doc[head])
            first = np.zeros(len(doc), bool)
            first[head] = True
            use = first[owner]
            sig, by = sig[use], owner[use]
            head, of = _star([sig], doc[by])
            a, b = _unique_pairs(by, by[of])
            near = _allowed([point[i] for i in a], n[a], [point[i] for i in b], n[b], num, den)
            label = _labels(len(doc), a[near], b[near])
            # Boxes: the documents of a label, named by the least doc_id.
            firsts = np.flatnonzero(first)
            order = firsts[np.lexsort((doc[firsts], label[firsts]))]
            new = np.flatnonzero(np.diff(label[order], prepend=-1))
            least = np.minimum.reduceat(n[order], new) if len(new) else n[:0]
            ends = np.append(new, len(order))[1:]
            tops = [point[order[x]] if y == x + 1 else _top([point[i] for i in order[x:y]]) for x, y in zip(new.tolist(), ends.tolist(), strict=True)]
            name = np.zeros(len(doc), np.int64)
            name[order] = np.repeat(doc[order[new]], np.diff(np.append(new, len(order))))
            a, b = _unique_pairs(doc[firsts], name[firsts])
            yield from emit(LINK, of_doc(a), a, b)
            for axes in {len(t) for t in tops}:
                at = np.array([i for i, t in enumerate(tops) if len(t) == axes])
                yield from emit(BOX, of_doc(doc[order[new[at]]]), doc[order[new[at]]], least[at], np.stack([tops[i] for i in at]))
            order = np.lexsort((name[by], sig))
            sig, by = sig[order], name[by[order]]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (by[1:] != by[:-1])
            yield from emit(SIGNATURE, to(sig[new]), sig[new], by[new])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column(0).to_pylist()
                sets = shingler.sets(part.column(1).to_pylist())
                lost = [i for i, x in enumerate(ids) if x is None]
                if lost:
                    yield from emit(SIZES_NO_ID, np.zeros(len(lost), np.int64), np.array([len(sets[i]) for i in lost], np.int64))
                    sets = [s for s, x in zip(sets, ids, strict=True) if x is not None]
                    ids = [x for x in ids if x is not None]
                sig, owner = signatures(sets, cells)
                held["sig"].append(sig)
                held["owner"].append(owner + docs_held)
                held["doc"].append(np.array(ids, np.int64))
                held["n"].append(np.array([len(s) for s in sets], np.int64))
                points += [point_of(s) for s in sets]
                held["k1"].append(np.array([np.bitwise_xor.reduce(mixed(s)) if len(s) else 0 for s in sets], np.uint64))
                held["k2"].append(np.array([np.add.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D))) if len(s) else 0 for s in sets], np.uint64))
                docs_held += len(ids)
                if sum(map(len, held["sig"])) > HELD:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(frugal(task), "part int, kind int, x binary, y binary, z binary")


def _top(points: list[np.ndarray]) -> np.ndarray:
    """The greatest coordinates, at the coarsest axes of all."""
    axes = min(map(len, points))
    return np.max([folded(p, axes) for p in points], axis=0)


def _squeezed(x: np.ndarray) -> bytes:
    """The array's bytes, all first ones before all second ones and so on, compressed."""
    flat = np.ascontiguousarray(x).reshape(-1)
    return zstandard.compress(flat.view(np.uint8).reshape(len(flat), -1).T.tobytes(), 1)


def _unsqueezed(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def met(packed: DataFrame, parts: int) -> DataFrame:
    """Rows (kind, a, b, c, top) from packed rows that meet in their part: sizes, copies, links and boxes of the whole table,
    and what met in a signature: MET with document, least document and the signature (of those with the same documents, one)."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(kind: int, a, b, c: np.ndarray | None = None, tops: np.ndarray | None = None) -> Iterator:
            if len(a):
                top = pa.nulls(len(a), pa.binary()) if tops is None else pa.array([t.tobytes() for t in tops], pa.binary())
                third = pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), third, top], names=["kind", "a", "b", "c", "top"])

        copies: list[tuple] = []
        sigs: list[tuple] = []
        whole = lambda x, t=np.int64: _unsqueezed(x, t)
        for batch in batches:
            for kind, x, y, z in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                if kind == SIZES_NO_ID:
                    n = whole(x)
                    yield from rows(SIZES, [None] * len(n), n)
                elif kind == COPY:
                    copies.append((whole(x, np.uint64), whole(y, np.uint64), whole(z)))
                elif kind == SIGNATURE:
                    sigs.append((whole(x, np.uint64), whole(y)))
                elif kind == BOX:
                    ids = whole(x)
                    yield from rows(BOX, ids, whole(y), None, whole(z, np.uint32).reshape(len(ids), -1))
                else:
                    yield from rows(kind, whole(x), whole(y))
        if copies:
            k1, k2, doc = map(np.concatenate, zip(*copies, strict=True))
            yield from rows(COPY, *_unique_pairs(doc, doc[_star([k1, k2], doc)[1]]))
        if sigs:
            sig, doc = map(np.concatenate, zip(*sigs, strict=True))
            sigs.clear()
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
            sig, doc = sig[new], doc[new]
            start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(start, len(sig)))
            # Signatures under which the same documents meet say the same: one of them stands for all.
            members = np.add.reduceat(mixed(doc.astype(np.uint64)), start) + size.astype(np.uint64)
            several = np.flatnonzero(size > 1)
            _, one = np.unique(members[several], return_index=True)
            start, size = start[several[one]], size[several[one]]
            at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield from rows(MET, doc[at], np.repeat(doc[start], size), sig[at].view(np.int64))

    return packed.repartition(parts, "part").mapInArrow(frugal(task), "kind int, a long, b long, c long, top binary")


def axes_for(n: int) -> int:
    """A power of two, AXES at least: few hashes fall into one axis, so that unrelated large sets differ in most."""
    return max(AXES, 1 << (n // PER_AXIS).bit_length())


def point_of(hashes: np.ndarray, axes: int | None = None) -> np.ndarray:
    """Hashes per axis; an axis is a hash's first bits, so that coarser axes are sums of finer ones."""
    axes = axes or axes_for(len(hashes))
    return np.bincount((hashes >> np.uint64(65 - axes.bit_length())).astype(np.int64), minlength=axes).astype(np.uint32)


def folded(point: np.ndarray, axes: int) -> np.ndarray:
    return point if len(point) == axes else point.reshape(axes, -1).sum(1, dtype=np.uint32)


class CountTree:
    """An R-tree over count vectors; only the upper corners of its boxes and the least sizes matter to the bound."""

    def __init__(self, sizes: list[int], points: list[np.ndarray]):
        self.sizes, self.points = np.array(sizes, np.int64), np.stack(points).astype(np.int64)
        # Neighbours in this order share leaves: by size, then along the axes.
        self.order = np.lexsort((*self.points.T[:AXES][::-1], self.sizes))
        self.levels = [(self.points[self.order], self.sizes[self.order])]
        while len(self.levels[-1][0]) > FANOUT:
            tops, least = self.levels[-1]
            cuts = np.arange(0, len(tops), FANOUT)
            self.levels.append((np.maximum.reduceat(tops, cuts, axis=0), np.minimum.reduceat(least, cuts)))

    def within(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Indices of sets whose bound allows a similarity of num / den with a set of this point and size."""
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            tops, least = self.levels[level]
            most = np.minimum(tops[at], point).sum(axis=1)
            # Jaccard >= num / den means overlap * (num + den) >= num * (size + other size).
            at = at[(num + den) * most >= num * (size + np.maximum(least[at], -(-size * num // den)))]
            if level:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[level - 1][0])]
        return self.order[at]


class Items:
    """Some sets with their tree: as hashes, or as boxes alone, where every pair that the bound allows counts as joined."""

    def __init__(self, payloads: list, sizes: list[int], shingler: Shingler | None, num: int, den: int, axes: int | None = None):
        self.num, self.den = num, den
        if shingler is None:
            self.sets, self.sizes = None, sizes
            points = [np.frombuffer(p, np.uint32) for p in payloads]
            axes = min(map(len, points))
            points = [folded(p, axes) for p in points]
        else:
            self.sets = shingler.sets(payloads)
            self.sizes = [len(s) for s in self.sets]
            axes = axes or axes_for(sum(self.sizes) // max(len(self.sizes), 1))
            points = [point_of(s, axes) for s in self.sets]
        self.axes = axes
        self.tree = CountTree(self.sizes, points)

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        return self.tree.within(point, size, self.num, self.den)

    def joined(self, i: int, other: Items, j: int) -> bool:
        if self.sets is None:
            return True
        a, b = self.sets[i], other.sets[j]
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * both >= self.num * (len(a) + len(b) - both)


def classes_within(items: Items) -> np.ndarray:
    """Label of each set: the least index that links reach. Pairs that are joined already are not compared again."""
    n = len(items.sizes)
    label = np.arange(n)
    for i in range(1, n):
        near = items.near(items.tree.points[i], items.sizes[i])
        near = near[near < i]
        near = near[label[near] != label[i]]
        while len(near):
            j, near = near[0], near[1:]
            if items.joined(i, items, j):
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
                near = near[label[near] != label[i]]
    return label


def _groups(batches: Iterator, keys: int) -> Iterator:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, members in groupby(rows, key=lambda row: row[:keys]):
        yield key, [row[keys:] for row in members]


def _chunked(rows: DataFrame, keys: list[str], task, schema: str) -> DataFrame:
    """Runs task over each group of rows, in a partition's order of keys."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, "doc").mapInArrow(frugal(task), schema)


def _within_chunks(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc, top) from rows (grp, chunk, doc, n, payload): the least document of the same chunk that links reach."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler(k)
        for _, members in _groups(batches, 2):
            docs, sizes, payloads = zip(*members, strict=True)
            label = classes_within(Items(list(payloads), list(sizes), shingler, num, den))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([docs[j] for j in label], pa.int64())], names=["doc", "top"])

    return _chunked(rows.select("grp", "chunk", "doc", "n", "payload"), ["grp", "chunk"], task, "doc long, top long")


def _across_chunks(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between tops, from rows (grp, chunk, turn, ask, doc, top, n, payload): the asking against the others."""

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler(k)
        for _, members in _groups(batches, 3):
            sides = [[m for m in members if m[0] == ask] for ask in (False, True)]
            if not all(sides):
                continue
            asked = Items([m[4] for m in sides[0]], [m[3] for m in sides[0]], shingler, num, den)
            asking = Items([m[4] for m in sides[1]], [m[3] for m in sides[1]], shingler, num, den, asked.axes)
            tops = np.array([m[2] for m in sides[0]])
            found = set()
            for i, (_, _, top, _, _) in enumerate(sides[1]):
                near = asked.near(asking.tree.points[i], asking.sizes[i])
                near = near[tops[near] != top]
                while len(near):
                    j, near = near[0], near[1:]
                    if asking.joined(i, asked, j):
                        found.add((top, int(tops[j])))
                        near = near[tops[near] != tops[j]]
            if found:
                a, b = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _chunked(rows.select("grp", "chunk", "turn", "ask", "doc", "top", "n", "payload"), ["grp", "chunk", "turn"], task, "a long, b long")


def _n_chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """grp, chunks: how many chunks each group's weight fills."""
    return rows.groupBy("grp").agg(F.ceil(F.sum("weight") / chunk).cast("int").alias("chunks"))


def _dealt(rows: DataFrame, salt: int) -> DataFrame:
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc", F.lit(salt)), F.col("chunks")).cast("int"))


def jaccard_groups(docs: DataFrame, k: int = 3, num: int = 9, den: int = 10, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    docs has doc_id and text; other columns are ignored. Words are split at ASCII white space and A-Z lower-cased; a
    document's set holds its distinct k-word shingles (with fewer words the whole sequence). Two documents link when
    the Jaccard similarity of their sets is at least num / den; component_id is the least doc_id that links reach,
    itself included. Null or empty texts have no shingles and stay alone. Repeated rows count as one document; texts
    under one doc_id are one node. A row without doc_id has no component_id. An empty table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = settled(met(fingerprints(docs, k, num, den, parts), parts))
    of = lambda kind, a, b: facts.where(F.col("kind") == kind).select(F.col("a").alias(a), F.col("b").alias(b))
    copies = settled(of(COPY, "doc", "first").groupBy("doc").agg(F.min("first").alias("first")))
    sizes = of(SIZES, "doc", "n")
    here = settled(of(COPY_HERE, "doc", "here").groupBy("doc").agg(F.min("here").alias("here")))
    edges = of(LINK, "a", "b").unionByName(copies.toDF("a", "b"))
    groups = candidates(facts, edges, num, den)
    # Only the first of equal sets takes part; its copies hang on it.
    distinct = groups.join(copies.select("doc"), "doc", "left_anti").join(here.select("doc"), "doc", "left_anti")
    several = distinct.groupBy("grp").count().where("count > 1").select("grp")
    finer = settled(distinct.join(several, "grp"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_of().alias("payload"))
    sized = finer.join(sizes.groupBy("doc").agg(F.max("n").alias("n")), "doc").withColumn("weight", F.col("n"))
    tops = settled(_classes(settled(sized.join(texts, "doc")), k, num, den, chunk))
    # Copies of a task hang on its first one, those on the first of all, and that on the top of its class.
    nodes = copies.select(F.col("doc").alias("node"), "first").unionByName(tops.select(F.col("doc").alias("node"), F.col("doc").alias("first")))
    roots = (
        nodes.join(tops.withColumnRenamed("doc", "first"), "first", "left")
        .groupBy("node")
        .agg(F.min(F.coalesce("top", "first")).alias("root"))
    )
    return (
        sizes.join(here, "doc", "left")
        .withColumn("node", F.coalesce("here", "doc"))
        .join(roots, "node", "left")
        .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("component_id"))
    )


def candidates(facts: DataFrame, edges: DataFrame, num: int, den: int, block: int = POINTS) -> DataFrame:
    """(doc, grp): documents that edges or boxes within the bound join; documents that nothing joins are not in it."""
    boxes = facts.where(F.col("kind") == BOX).select(F.col("a").alias("doc"), F.col("b").alias("least"), "top")
    seen = facts.where(F.col("kind") == MET).select(F.col("a").alias("doc"), F.col("b").alias("head"), F.col("c").alias("sig"))
    side = lambda name: boxes.withColumnsRenamed({"doc": name, "least": f"{name}_least", "top": f"{name}_top"})
    pairs = seen.where("doc <> head").select("doc", "head").distinct().join(side("doc"), "doc").join(side("head"), "head")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            tops = [[np.frombuffer(x, np.uint32) for x in batch.column(i).to_pylist()] for i in (3, 5)]
            least = [batch.column(i).to_numpy() for i in (2, 4)]
            ok = pa.array(_allowed(tops[0], least[0], tops[1], least[1], num, den), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ok], names=["doc", "head", "ok"])

    compared = settled(pairs.select("doc", "head", "doc_least", "doc_top", "head_least", "head_top").mapInArrow(frugal(compare), "doc long, head long, ok boolean"))
    joined = settled(edges.unionByName(compared.where("ok").select(F.col("doc").alias("a"), F.col("head").alias("b"))))
    first = settled(connected(joined))
    # Signatures under which documents met that the bound keeps apart, if they are of different groups.
    apart = seen.join(compared.where("not ok"), ["doc", "head"], "left_semi").select("sig").distinct()
    placed = seen.join(apart, "sig", "left_semi").join(first.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    several = placed.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("sig")
    met_again = settled(seen.join(several, "sig", "left_semi").select("sig", "doc"))
    if not met_again.isEmpty():
        rows = blocked(met_again.join(boxes, "doc").withColumnRenamed("doc", "id"), None, ["sig"], block)

        def within_signature(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for (_, i, j), members in _groups(batches, 3):
                own = [m for m in members if i != j or m[0] == 0]
                ids = [m[1] for m in own]
                label = classes_within(Items([m[3] for m in own], [m[2] for m in own], None, num, den))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([ids[x] for x in label], pa.int64())], names=["a", "b"])

        keys = ["sig", "i", "j"]
        found = rows.select(*keys, "side", "id", "least", "top").repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(frugal(within_signature), "a long, b long")
        more = settled(found.where("a <> b").distinct())
        first = connected(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return first.select(F.col("node").alias("doc"), F.col("root").alias("grp"))


def _classes(rows: DataFrame, k: int, num: int, den: int, chunk: int) -> DataFrame:
    """(doc, top) of rows (grp, doc, n, weight, payload): the least document that exact links within a group reach."""
    rows = _dealt(rows.join(_n_chunks(rows, chunk), "grp"), 0)
    first = settled(_linked_rows(_within_chunks(rows, k, num, den)))
    large = rows.where("chunks > 1")
    if large.isEmpty():
        return first
    # The chunks' tops among themselves, then whatever is outside its group's main class against all chunks.
    heads = large.join(first.where("doc = top").select("doc"), "doc", "left_semi").drop("chunks", "chunk")
    heads = _dealt(heads.join(_n_chunks(heads, chunk), "grp"), 1)
    over = settled(_linked_rows(_within_chunks(heads, k, num, den)).select(F.col("doc").alias("top"), F.col("top").alias("higher")))
    second = settled(first.join(over, "top", "left").select("doc", F.coalesce("higher", "top").alias("top")))
    place = large.select("grp", "doc").distinct().join(second, "doc")
    main = place.groupBy("grp", "top").count().groupBy("grp").agg(F.max_by("top", F.struct("count", "top")).alias("main"))
    outside = settled(place.join(main, "grp").where("top <> main").select("grp", "doc", "top"))
    if outside.isEmpty():
        return second
    asking = large.drop("chunk", "chunks").join(outside, ["grp", "doc"])
    turns = asking.groupBy("grp").agg(F.ceil(F.sum("weight") / chunk).cast("int").alias("turns"))
    asked = large.join(turns, "grp").join(second, "doc").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    asking = (
        asking.join(turns, "grp")
        .withColumn("turn", F.pmod(F.xxhash64("doc", F.lit(2)), F.col("turns")).cast("int"))
        .join(_n_chunks(large, chunk), "grp")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    )
    columns = ["grp", "chunk", "turn", "ask", "doc", "top", "n", "payload"]
    pairs = asked.withColumn("ask", F.lit(False)).select(columns).unionByName(asking.withColumn("ask", F.lit(True)).select(columns))
    across = settled(_across_chunks(pairs, k, num, den))
    merged = connected(across).select(F.col("node").alias("top"), "root")
    return second.join(merged, "top", "left").select("doc", F.coalesce("root", "top").alias("top"))


def _linked_rows(found: DataFrame) -> DataFrame:
    """One row per doc: rows of one doc_id are one node."""
    return found.groupBy("doc").agg(F.min("top").alias("top"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without near copies: of each group of links the document with the least doc_id stays; no row without doc_id goes."""
    groups = jaccard_groups(docs, k, num, den)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
