import numpy as np
import pytest

from fotolake.operators import graph as gr


def clusters(rng, count, each, spread, dims=24):
    centers = rng.normal(size=(count, dims))
    return np.concatenate([c / np.linalg.norm(c) + rng.normal(size=(each, dims)) * spread for c in centers])


def labels(links, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("spread", "limit"), [(0.05, 0.2), (0.2, 0.38), (1.0, 0.6)])
def test_links_equal_all_pairs(spark, spread, limit):
    rng = np.random.default_rng(3)
    x = clusters(rng, 12, 30, spread)
    x[5] = 0
    x[40] = x[41]
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    found = labels([tuple(r) for r in gr.close_links(frame, limit, 16).collect()], len(x))
    unit = x.astype(np.float32).astype(float)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 1 - limit, 1))
    assert found == labels(list(zip(a.tolist(), b.tolist())), len(x))


def test_far_blocks_are_skipped(spark):
    """Twenty tight clusters: a block meets its own cluster, not the square of all blocks."""
    x = clusters(np.random.default_rng(4), 20, 60, 0.03)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    pivots = gr.pivots_of(frame)
    rows = gr.in_blocks(frame, pivots, 20)
    blocks = rows.select("cell", "at").distinct().count()
    pairs = gr.near_blocks(rows, pivots, 0.2).count()
    assert blocks >= 60 and pairs < blocks * blocks / 2 / 8


def test_clusters_are_the_same_either_way(spark, monkeypatch):
    x = clusters(np.random.default_rng(5), 6, 25, 0.12)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    want = {tuple(r) for r in gr.cluster_faces(frame).collect()}
    assert {tuple(r) for r in gr.cluster_faces(frame, block=10).collect()} == want
    assert gr.cluster_faces(frame.limit(0)).collect() == []


def test_what_lies_around_a_pivot_is_joined_without_products(spark):
    """Tight clusters meet no block of their own; a chain, far vectors and zeros beside them are joined as all pairs would."""
    rng = np.random.default_rng(6)
    turn = np.arange(40) * 0.3
    chain = np.zeros((40, 24))
    chain[:, 0], chain[:, 1] = np.cos(turn), np.sin(turn)
    x = np.concatenate([clusters(rng, 5, 60, 0.04), chain + rng.normal(size=chain.shape) * 0.01, rng.normal(size=(20, 24)), np.zeros((2, 24))])
    x = x[rng.permutation(len(x))]
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 1 - 0.2, 1))
    want = labels(list(zip(a.tolist(), b.tolist())), len(x))
    assert labels([tuple(r) for r in gr.close_links(frame, 0.2, 10).collect()], len(x)) == want
    met, _, links = gr._met_blocks(frame, 0.2, 10)
    assert links is not None and met.count() < 20 * len(x)
    linked = {r["id"]: r["cluster"] for r in gr.cluster_faces(frame, 0.2).collect()}
    rounds = {r["id"]: r["cluster"] for r in gr.cluster_faces(frame, 0.2, whole=10, block=10).collect()}
    label = gr.average_linkage(x, 0.2)
    assert linked == rounds == {i: int(np.flatnonzero(label == label[i]).min()) for i in range(len(x))}


def test_a_tight_component_is_one_cluster_without_rounds(spark, monkeypatch):
    def never(*_):
        raise AssertionError("rounds")

    monkeypatch.setattr(gr, "merged_rounds", never)
    x = clusters(np.random.default_rng(7), 3, 50, 0.03)
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    found = {r["id"]: r["cluster"] for r in gr.cluster_faces(frame, 0.38, whole=20, block=10).collect()}
    assert found == {i: i // 50 * 50 for i in range(len(x))}
