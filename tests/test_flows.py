"""Stateful flows: batch and stream give the same rows, and plain loops give them too."""

import random

import pytest
from pyspark.sql import functions as F

from fotolake.operators import joins as jn
from fotolake.streaming import flows


def streamed(spark, tmp_path, make, parts):
    """The rows of a flow over files that arrive one per batch, with a restart in the middle."""
    folder, found = str(tmp_path / "in"), []
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        if i in (len(parts) // 2, len(parts) - 1):
            stream = flows.read_stream(spark, folder, parts[0].schema)
            flows.run_available(make(stream), str(tmp_path / "ck"), lambda f, n: found.extend(tuple(r) for r in f.collect())).awaitTermination(200)
    return found


def test_rate_limit_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((rng.randrange(3), rng.randrange(200_000)) for _ in range(260))
    want = []
    for key in range(3):
        taken = []
        for at in sorted(a for k, a in rows if k == key):
            hour, day = [t for t in taken if at - t < 3600], [t for t in taken if at - t < 86_400]
            waits = ([hour[-10] + 3600 - at] if len(hour) >= 10 else []) + ([day[-30] + 86_400 - at] if len(day) >= 30 else [])
            want.append((key, at, not waits, max(waits) // 60 + 1 if waits else 0))
            taken += [] if waits else [at]
    frame = spark.createDataFrame(rows, "key long, at long")
    assert sorted(map(tuple, flows.rate_limit(frame.repartition(4)).collect())) == sorted(want)
    flush = spark.createDataFrame([(9, 10_000_000)], "key long, at long")
    parts = [frame.where("at < 70000"), frame.where("at between 70000 and 139999"), frame.where("at >= 140000"), flush]
    assert sorted(streamed(spark, tmp_path, lambda f: flows.rate_limit(f), parts)) == sorted(want)


def test_throttle_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), t, rng.random() < 0.85) for t in rng.sample(range(400_000), 120)]
    want = []
    for alert in "ab":
        last = None
        for _, at, active in sorted(r for r in rows if r[0] == alert):
            if not active:
                last = None
            elif last is None or at - last >= 43_200:
                want.append((alert, at))
                last = at
    frame = spark.createDataFrame(rows, "alert string, at long, active boolean")
    assert sorted(map(tuple, flows.alert_throttle(frame).collect())) == sorted(want)
    flush = spark.createDataFrame([("z", 10_000_000, False)], frame.schema)
    parts = [frame.where("at < 200000"), frame.where("at >= 200000"), flush]
    assert sorted(streamed(spark, tmp_path, lambda f: flows.alert_throttle(f), parts)) == sorted(want)


def test_empty_flows(spark):
    assert flows.rate_limit(spark.createDataFrame([], "key long, at long")).collect() == []
    assert flows.alert_throttle(spark.createDataFrame([], "alert string, at long, active boolean")).collect() == []


KNOWN, DISK = "path string, size long, mtime long, sha string, photo_id long", "path string, size long, mtime long, sha string"


def scan(known, disk):
    """One pass over a folder, a file at a time: (changes, known afterwards)."""
    files = {k[0]: list(k[1:]) for k in known}
    photos = {k[4]: k[3] for k in known}
    disk, out = {d[0]: d for d in disk}, {}
    gone = {files[p][3]: p for p in files if p not in disk}
    for path in sorted(p for p in disk if p in files and tuple(files[p][:2]) != disk[p][1:3]):
        _, size, mtime, sha = disk[path]
        pid = files[path][3]
        if photos[pid] == sha:
            out[path] = ("touched", pid)
        elif any(s == sha for i, s in photos.items() if i != pid):
            out[path] = ("duplicate", pid)
        else:
            photos[pid] = sha
            out[path] = ("changed", pid)
        files[path][:2] = [size, mtime]
    top, added, held = max(photos, default=0), [], {}
    for path in sorted(p for p in disk if p not in files):
        _, size, mtime, sha = disk[path]
        owner = next((i for i, s in photos.items() if s == sha), None)
        if owner in gone:
            out[path] = ("moved", owner)
            del files[gone.pop(owner)]
            held[path] = [size, mtime, sha, owner]
        elif owner is not None or sha in added:
            out[path] = ("duplicate", None)
        else:
            added.append(sha)
            out[path] = ("new", None)
            held[path] = [size, mtime, sha, top + len(added)]
    kept = len(gone) > 20 and len(gone) > 0.5 * max(1, len(known))
    for pid, path in gone.items():
        out[path] = ("held" if kept else "gone", pid)
        if not kept:
            del files[path]
    after = [(p, f[0], f[1], photos[f[3]], f[3]) for p, f in files.items()] + [(p, *h) for p, h in held.items()]
    return {(p, *c) for p, c in out.items()}, set(after)


def folder(rng, before):
    """A next listing: files stay, are edited to contents old and new, move, are copied, vanish and come."""
    shas = [k[3] for k in before] + ["n1", "n2", "n3"]
    disk = {}
    for path, size, mtime, sha, _ in before:
        fate = rng.random()
        if fate < 0.5:
            disk[path] = (path, size, mtime, sha)
        elif fate < 0.8:
            disk[path] = (path, size + rng.randrange(2), mtime + 1, rng.choice([sha, *rng.sample(shas, 2)]))
        elif fate < 0.9:
            disk[f"m/{path}"] = (f"m/{path}", size, mtime, sha)
    for i in range(8):
        disk[f"x{i}"] = (f"x{i}", 1, 1, rng.choice(shas))
    return list(disk.values())


@pytest.mark.parametrize("seed", range(4))
def test_folder_diff_equals_one_file_at_a_time(spark, seed):
    rng = random.Random(seed)
    known = [(f"{rng.randrange(100):02}/f{i}", 1, 1, f"s{i}", i) for i in range(40)]
    disk = folder(rng, known)
    changes, after = scan(known, disk)
    k, d = spark.createDataFrame(known, KNOWN), spark.createDataFrame(disk, DISK)
    found = jn.folder_diff(d, k)
    assert {tuple(r) for r in found.collect()} == changes
    assert {tuple(r) for r in jn.apply_diff(k, d, found).collect()} == after


def test_edited_file_whose_old_content_was_saved_elsewhere(spark):
    known = spark.createDataFrame([("a", 1, 1, "old", 1), ("b", 1, 1, "y", 2), ("c", 1, 1, "z", 3)], KNOWN)
    disk = spark.createDataFrame([("a", 2, 2, "fresh"), ("saved", 1, 1, "old"), ("b", 2, 2, "same"), ("c", 2, 2, "same")], DISK)
    found = {r["path"]: r["change"] for r in jn.folder_diff(disk, known).collect()}
    assert found == {"a": "changed", "saved": "new", "b": "changed", "c": "duplicate"}


def test_folder_sync_remembers(spark, tmp_path):
    """Two listings and a restart between them: what the first one brought is known to the second."""
    known = spark.createDataFrame([("a", 1, 1, "s", 5)], KNOWN)
    folder, out = str(tmp_path / "listing"), str(tmp_path / "out")
    for rows in ([("a", 2, 2, "t"), ("b", 1, 1, "u")], [("a", 2, 2, "t"), ("moved/b", 1, 1, "u"), ("c", 1, 1, "v")], [("a", 2, 2, "t"), ("moved/b", 1, 1, "u"), ("c", 1, 1, "v")]):
        spark.createDataFrame(rows, DISK).coalesce(1).write.mode("append").parquet(folder)
        stream = flows.read_stream(spark, folder, spark.createDataFrame([], DISK).schema)
        flows.folder_sync(stream, known, out, str(tmp_path / "ck")).awaitTermination(120)
    found = {(r["batch"], r["path"], r["change"], r["photo_id"]) for r in spark.read.parquet(out).collect()}
    assert found == {(0, "a", "changed", 5), (0, "b", "new", None), (1, "moved/b", "moved", 6), (1, "c", "new", None)}
