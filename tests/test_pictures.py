"""Measures of pictures against loops over pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotolake.operators import images as im


def lanczos(x):
    x = abs(x)
    if x == 0:
        return 1.0
    return 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2 if x < 3 else 0.0


def line(values, out):
    """One line of levels resampled to another length, a pixel at a time."""
    n, result = len(values), []
    scale = n / out
    wide = max(scale, 1)
    for i in range(out):
        center = (i + 0.5) * scale
        first, last = max(int(center - 3 * wide + 0.5), 0), min(int(center + 3 * wide + 0.5), n)
        weights = [lanczos((x - center + 0.5) / wide) for x in range(first, last)]
        total = sum(w * v for w, v in zip(weights, values[first:last])) / sum(weights)
        result.append(min(max(math.floor(total + 0.5), 0), 255))
    return result


def by_loops(grey, height, width):
    rows = [line(r, width) for r in grey]
    columns = [line([r[x] for r in rows], height) for x in range(width)]
    return [[columns[x][y] for x in range(width)] for y in range(height)]


@pytest.mark.parametrize(("h", "w", "height", "width"), [(31, 47, 8, 9), (8, 9, 8, 9), (5, 4, 8, 9), (64, 20, 8, 9), (20, 30, 13, 7)])
def test_resampling_equals_loops(h, w, height, width):
    grey = np.random.default_rng(h * w).integers(0, 256, (h, w)).astype(float)
    assert im.resampled(grey, height, width).tolist() == by_loops(grey.tolist(), height, width)


def test_hash_is_of_the_resampled_picture():
    rgb = np.random.default_rng(1).integers(0, 256, (40, 50, 3)).astype(float)
    grey = [[(int(r) * 19595 + int(g) * 38470 + int(b) * 7471 + 0x8000) >> 16 for r, g, b in row] for row in rgb]
    small, value = by_loops(grey, 8, 9), 0
    for row in small:
        for left, right in zip(row, row[1:]):
            value = value << 1 | (right > left)
    assert im.dhash(rgb) == (value - (1 << 64) if value >> 63 else value)
    assert im.dhash(np.full((30, 30, 3), 77.0)) is None


def test_hashes_stay_whole_beside_a_picture_without_one(spark):
    rng = np.random.default_rng(7)
    noise = rng.integers(0, 256, (20, 20, 3), dtype=np.uint8)
    rows = [("a", 20, 20, 3, bytearray(noise.tobytes())), ("b", 20, 20, 3, bytearray(b"\x40" * 1200))]
    found = {r["origin"]: r["phash"] for r in im.measure(spark.createDataFrame(rows, "origin string, height int, width int, nChannels int, data binary").coalesce(1)).collect()}
    assert found == {"a": im.dhash(noise[:, :, ::-1].astype(float)), "b": None}


def test_thumbnails_fit_and_average():
    assert im.thumbnail_size(3000, 4000, 512) == (384, 512) and im.thumbnail_size(4000, 1, 48) == (48, 1) and im.thumbnail_size(7, 1000, 48) == (1, 48)
    rgb = np.random.default_rng(2).integers(0, 256, (300, 200, 3)).astype(float)
    assert im.thumbnail(rgb, 512) is rgb and im.thumbnail(rgb, 48).shape == (48, 32, 3)
    assert im._reduced(np.arange(12.0).reshape(3, 4), 2, 3).tolist() == [[3.0, 5.0], [9.0, 11.0]]
    assert abs(im.thumbnail(np.full((3000, 2000, 3), 9.0), 64) - 9).max() == 0


def test_dominant_colour_is_the_heaviest():
    rgb = np.zeros((40, 40, 3))
    rgb[:, :30] = (200, 30, 30)
    rgb[:, 30:] = (90, 90, 90)
    r, g, b = im.dominant(rgb)
    assert abs(r - 200) < 12 and g < 50 and b < 50
    means, n = im.palette(np.array([[[1, 1, 1]] * 5 + [[9, 9, 9]] * 3], float), 6)
    assert sorted(n.tolist()) == [3, 5] and len(means) == 2


def test_eyes_by_closed_form(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=(rng.integers(3, 9), 2)) * [3, rng.random()] @ np.linalg.qr(rng.normal(size=(2, 2)))[0] + 50).tolist()) for i in range(40)]
    rows += [(50, [[1.0, 1.0]] * 4), (51, [[0.0, 0.0], [1.0, 0.0]]), (52, None), (53, [[0.0, 0.0], [4.0, 0.0], [2.0, 1.0]])]
    found = {r["id"]: r["x"] for r in spark.createDataFrame(rows, "id long, p array<array<double>>").select("id", im.eye_ratio(F.col("p")).alias("x")).collect()}
    for i, p in rows[:40]:
        x = np.array(p) - np.mean(p, 0)
        on = x @ np.linalg.svd(x, full_matrices=False)[2].T
        assert abs(found[i] - np.ptp(on[:, 1]) / np.ptp(on[:, 0])) < 1e-9
    assert found[50] == 1.0 and found[51] is None and found[52] is None and abs(found[53] - 0.25) < 1e-12
