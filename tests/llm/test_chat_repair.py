import hashlib
import itertools
import random
import re
import zlib

import pytest

from fotolake.llm import chat_repair as cr

PATTERN = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\v\f\r"
INSERTS = ["", "u", "a", "ua", "au", "uu", "aa"]
CLASH = "conv_id long, turn long, role string, text string, conv string, span int, number string, first string, `a.b` int"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(rows):
    """All edits of all rows with up to two insertions at each place, judged by the pattern: the cheapest, and its lines."""
    choices = []
    for (role, _), fault in zip(rows, faults(rows)):
        extra = int(fault == "truncated")
        options = [("D", 3, None)]
        if fault in (None, "truncated"):
            options += [("K", extra, role), ("R", 2 + extra, "user"), ("R", 2 + extra, "assistant")]
        choices.append(options)
    best = None
    for edits in itertools.product(*choices):
        for gaps in itertools.product(INSERTS, repeat=len(rows) + 1):
            shape = gaps[0] + "".join((e[2][:1] or "-" if e[0] != "D" else "") + g for e, g in zip(edits, gaps[1:]))
            if not PATTERN.fullmatch(shape):
                continue
            audit = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:]))
            cost = sum(e[1] for e in edits) + 2 * audit.count("I")
            if best is None or (cost, audit) < best[:2]:
                name = {"u": "user", "a": "assistant"}
                lines = [name[x] + ":" for x in gaps[0]]
                for e, g, (_, text) in zip(edits, gaps[1:], rows):
                    lines += ([f"{e[2]}:{text}"] if e[0] != "D" else []) + [name[x] + ":" for x in g]
                best = (cost, audit, lines)
    return best


def some_rows(rng, n):
    roles = ["user", "user", "assistant", "assistant", "system", "tool", " ", "ape", ""]
    texts = ["Yes.", "No", "Why?", "", " ", "Long answer!\n", "gone\t"]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_charts_equal_all_repairs():
    rng = random.Random(3)
    for case in range(90):
        rows = some_rows(rng, case % 3 + 1 if case < 84 else 3)
        codes = ""
        for (role, _), fault in zip(rows, faults(rows)):
            initial = role[:1] if role[:1] in tuple("sua") else "o"
            codes += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cell = cr.parsed(codes)
        assert min(cell[0, q] for q in cr.FINAL if (0, q) in cell) == every_repair(rows)[:2], rows


def test_any_split_gives_the_same_cell():
    rng = random.Random(4)
    for n in range(1, 14):
        codes = "".join(rng.choice("suaoSUAOx") for _ in range(n))
        leaves = [cr._row(c) for c in codes]
        assert cr.parsed(codes) == cr.combined(leaves)


def plain(conversations):
    """The contract in plain Python, with a pass from left to right in place of charts."""
    damaged = {}
    for conv, turn, role, text in conversations:
        damaged.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        damaged[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    out = {}
    for conv, rows in damaged.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        told = [(r, t) for _, r, t in rows]
        kinds = faults(told)
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[:1] for r, _ in told]
        states = {0: (0, "", ()), 2: (2, "I", ("user:",)), 3: (4, "II", ("user:", "assistant:"))}
        for (role, text), kind in zip(told, kinds):
            new = {}

            def offer(state, cost, audit, lines):
                if state not in new or (cost, audit) < new[state][:2]:
                    new[state] = (cost, audit, lines)

            for p, (cost, audit, lines) in states.items():
                offer(p, cost + 3, audit + "D", lines)
                if kind in (None, "truncated"):
                    more = int(kind == "truncated")
                    for (q, initial), to in cr.STEPS.items():
                        if q == p and initial == role[:1]:
                            offer(to, cost + more, audit + "K", (*lines, f"{role}:{text}"))
                        if q == p and initial != "s":
                            offer(to, cost + 2 + more, audit + "R", (*lines, f"{'user' if initial == 'u' else 'assistant'}:{text}"))
            for _ in range(2):
                for p, (cost, audit, lines) in list(new.items()):
                    to = 3 if p == 2 else 2
                    offer(to, cost + 2, audit + "I", (*lines, "assistant:" if to == 3 else "user:"))
            states = new
        cost, audit, lines = min(states[q] for q in (0, 3) if q in states) if rows else (0, "", ())
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(rows),
        )
    return out


@pytest.fixture(scope="module")
def told():
    rng = random.Random(5)
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate(some_rows(rng, rng.randint(1, 7)))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"Say {t}" + ".!? "[t % 4]) for t in range(700)]
    rows += [(101, t, rng.choice(["user", "assistant", None]), rng.choice(["same.", "same.", None, "x" * 50_000])) for t in range(60)]
    rows += [(102, None, "user", "a."), (102, None, "user", "a."), (102, 5, "assistant", "b."), (102, 5, "assistant", "c"), (102, 9, None, "d.")]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 1, "user", "Hi."), (103, -4, "system", "S."), (103, 3, "user", "é漢.")]
    return rows


def test_report_equals_plain_python(spark, told):
    frame = spark.createDataFrame([(*r, "a", 1, "n", "f", 2) for r in told], CLASH).repartition(5)
    found = cr.repair_report(cr.damaged(frame), frame).collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256, r.n_rows) for r in found}
    assert len(found) == len(got)
    assert got == plain(told)


def test_repaired_rows_are_well_formed(spark, told):
    frame = spark.createDataFrame(told, "conv_id long, turn long, role string, text string")
    rows = cr.repair(frame).orderBy("conv_id", "place").collect()
    for _, group in itertools.groupby(rows, key=lambda r: r.conv_id):
        group = list(group)
        assert [r.place for r in group] == list(range(len(group)))
        assert PATTERN.fullmatch("".join(r.role[:1] for r in group))
        assert all(r.text == "" for r in group if r.edit == "I")


def test_empty_and_all_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert cr.repair_report(spark.createDataFrame([], schema)).collect() == []
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(lost, 0, "user", "x.")], schema)
    (row,) = cr.repair_report(cr.damaged(frame), frame).collect()
    assert (row.conv_id, row.gaps, row.cost, row.audit, row.repaired_sha256) == (lost, 0, 0, "", hashlib.sha256().hexdigest())
