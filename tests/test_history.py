import random

import pytest

from fotolake.operators import history as hi

SCHEMA = "id long, rating int, label string, flag int"


def replay(rows, commands, depth):
    """The log played through by hand: (rows, entries) after all commands; a do is (session, seq, 'do', ids, fields)."""
    rows = {r[0]: dict(zip(("rating", "label", "flag"), r[1:])) for r in rows}
    stacks, entries = {}, []
    for session, seq, kind, *rest in commands:
        undo, redo = stacks.setdefault(session, ([], []))
        if kind == "do":
            ids, fields = rest
            old = {i: {k: rows[i][k] for k in fields} for i in ids if any(rows[i][k] != v for k, v in fields.items())}
            if old:
                entries += [(session, seq, i, k, None if v is None else str(v), None if fields[k] is None else str(fields[k])) for i, o in old.items() for k, v in o.items()]
                undo.append((seq, fields, old))
                del undo[:-depth], redo[:]
            for i in ids:
                rows[i].update(fields)
        elif kind == "undo" and undo:
            redo.append(undo.pop())
            for i, o in redo[-1][2].items():
                rows[i].update(o)
        elif kind == "redo" and redo:
            undo.append(redo.pop())
            for i in undo[-1][2]:
                rows[i].update(undo[-1][1])
    return {(i, *r.values()) for i, r in rows.items()}, entries


@pytest.mark.parametrize("seed", range(3))
def test_state_equals_a_replay(spark, seed):
    rng, depth = random.Random(seed), 5
    rows = [(i, rng.randrange(3), rng.choice([None, "red"]), 0) for i in range(12)]
    commands = []
    for seq in range(400):
        kind = rng.choices(["do", "undo", "redo"], [3, 4, 3] if seq % 60 > 20 else [8, 1, 1])[0]
        fields = rng.choice([{"rating": rng.randrange(3)}, {"label": rng.choice([None, "red", "blue"]), "flag": rng.randrange(2)}])
        commands.append((rng.choice("ab"), seq, kind, *((rng.sample(range(12), 3), fields) if kind == "do" else ())))
    want, entries = replay(rows, commands, depth)
    made = {e[1] for e in entries}
    listed = [(s, n, k) for s, n, k, *_ in commands if k != "do" or n in made]
    log = spark.createDataFrame(listed, "session string, seq long, kind string").repartition(3)
    held = spark.createDataFrame(entries, "session string, seq long, id long, field string, before string, after string")
    assert {tuple(r) for r in hi.after_history(spark.createDataFrame(rows, SCHEMA), log, held, depth).collect()} == want


def test_a_patch_that_changes_nothing_is_no_entry(spark):
    photos = spark.createDataFrame([(1, 5, None, 0), (2, 3, "red", 0)], SCHEMA)
    assert hi.entry(photos, photos, {"flag": 0}, 1, 1).collect() == []
    found = {tuple(r)[2:] for r in hi.entry(photos, photos, {"rating": 5, "label": None}, 1, 2).collect()}
    assert found == {(2, "rating", "3", "5"), (2, "label", "red", None)}


def test_empty_log(spark):
    photos = spark.createDataFrame([(1, 5, None, 0)], SCHEMA)
    log = spark.createDataFrame([], "session string, seq long, kind string")
    held = spark.createDataFrame([], "session string, seq long, id long, field string, before string, after string")
    assert [tuple(r) for r in hi.after_history(photos, log, held).collect()] == [(1, 5, None, 0)]
    only = spark.createDataFrame([("a", 1, "undo"), ("a", 2, "redo")], "session string, seq long, kind string")
    assert hi.resolved(only).collect() == []
