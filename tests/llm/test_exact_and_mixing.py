import hashlib
import re
from collections import Counter, defaultdict

from fotolake.llm.exact_dedup import drop_copies, exact_dedup
from fotolake.llm.mixing import mix, mix_report, take_mix

RUN = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_dedup_is_brute_force(make, awkward):
    groups = defaultdict(list)
    for i, t in awkward:
        groups[RUN.sub(" ", t or "")].append(i)
    want = Counter()
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, spent = min(known, default=None), False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and not spent
            spent |= kept
            want[(i, keep, len(ids), kept, hashlib.sha256(body.encode()).hexdigest())] += 1
    for salts in (1, 7, 64):  # however many salts, the groups are the same
        assert Counter(map(tuple, exact_dedup(make(awkward), salts).collect())) == want


def test_drop_copies_keeps_columns_and_one_row(make, awkward):
    kept = drop_copies(make(awkward))
    assert kept.columns == make(awkward).columns
    bodies = [RUN.sub(" ", r["text"] or "") for r in kept.collect()]
    assert len(bodies) == len(set(bodies)) == len({RUN.sub(" ", t or "") for _, t in awkward})


def test_a_digest_of_two_texts_is_told_apart(make, monkeypatch):
    from pyspark.sql import functions as F

    from fotolake.llm import exact_dedup as ed

    plain = ed.with_digest
    monkeypatch.setattr(ed, "with_digest", lambda docs: plain(docs).withColumn("text_sha256", F.substring("text_sha256", 1, 1)))
    rows = [(i, f"text {i % 40}") for i in range(120)]
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in ed.exact_dedup(make(rows)).collect()}
    assert found == {i: (i % 40, 3) for i in range(120)}


def test_empty_tables(make):
    assert exact_dedup(make([])).count() == 0
    assert mix_report(make([])).count() == 0
    assert take_mix(make([])).count() == 0


def targets(sizes):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        heavy = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else weight[s] * rest / heavy for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing_targets_and_bounds(make, awkward):
    rows = [(i, t, "abcdef"[(n * n) % 6] if n % 7 else None) for n, (i, t) in enumerate(awkward)]
    rows += [(1000 + i, "w " * 5, "tiny") for i in range(2)] + [(2000 + i, "word " * 40, "big") for i in range(60)]
    docs = make(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    found = mix_report(docs, block=16).collect()
    assert len(found) == len(rows)
    assert sorted(r["size"] for r in found) == sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert sorted({round(r["target"], 6) for r in found}) == sorted({round(x, 6) for x in want.values()})
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    taken = Counter()
    for r in found:
        taken[round(r["target"], 6)] += r["taken"]
    for value, words in taken.items():
        same = sum(round(x, 6) == value for x in want.values())
        assert abs(words - same * value) <= same
    again = mix_report(docs.repartition(3), block=16).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_mix_is_low_discrepancy(make):
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(120)]
    order = [r["key"] for r in mix(make(rows), block=50).select("slot", "key", "rank").distinct().orderBy("slot").collect()]
    share = Counter(order)
    for key, n in share.items():
        for at in range(10, len(order), 10):
            assert abs(order[:at].count(key) - n / len(order) * at) < 5


def test_take_mix_repeats_rows(make):
    rows = [(i, "w " * 10, "a" if i < 5 else "b") for i in range(40)]
    times = Counter(r["doc_id"] for r in take_mix(make(rows)).collect())
    # Source a has 50 words and a target of 400 / 3: each of its documents twice, the rest of the words a third time.
    assert sorted(times[i] for i in range(5)) == [2, 3, 3, 3, 3] and max(times.values()) == 3
