import numpy as np
import pytest

from tapeline.llm import knn, lattice

BAD = [(9001, None), (9002, []), (9003, [1.0, None] + [0.0] * 10), (9004, [float("nan")] * 12), (9005, [float("inf")] * 12), (9006, [1.0, 2.0])]


def brute_knn(rows, k, n):
    good = [(i, np.array(v, np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % n == 0:
            scored = sorted((-int(q @ v), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_knn_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    centres = rng.integers(-300, 300, (6, 12))
    vectors = centres[rng.integers(0, 6, 300)] + rng.integers(-20, 20, (300, 12))
    vectors[40:80] = vectors[40]
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(vectors)] + BAD + [(5, vectors[5].astype(float).tolist()), (None, vectors[7].astype(float).tolist()), (9020, [0.0] * 12)]
    signals = spark.createDataFrame([(*r, 3.0) for r in rows], "signal_id long, entry_features array<double>, score double")
    got = knn.nearest_signals(signals, knn.F.col("signal_id") % 5 == 0, k=4, pivots=8, block=block).collect()
    assert sorted((r.query_id, r["rank"], r.signal_id, r.score) for r in got) == brute_knn(rows, 4, 5)


def test_knn_zero_query_and_small_cells(spark):
    vectors = np.random.default_rng(2).integers(-300, 300, (300, 6))
    vectors[100:200] = vectors[100]
    vectors[[0, 5]] = 0
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(vectors)]
    signals = spark.createDataFrame(rows, "signal_id long, entry_features array<double>")
    got = knn.nearest_signals(signals, knn.F.col("signal_id") % 5 == 0, k=10).collect()
    assert sorted((r.query_id, r["rank"], r.signal_id, r.score) for r in got) == brute_knn(rows, 10, 5)


def test_knn_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (5, [3.0, -1.0]), (10, [0.0, 0.0])], "signal_id long, entry_features array<double>")
    got = knn.nearest_signals(few, knn.F.col("signal_id") == 0).collect()
    assert [(r["rank"], r.signal_id, r.score) for r in got] == [(1, 5, 1), (2, 10, 0)]
    assert knn.nearest_signals(few.limit(0), knn.F.col("signal_id") == 0).collect() == []


def test_lattice_points():
    assert lattice.shortest().shape == (240, 8) and np.allclose((lattice.shortest() ** 2).sum(1), 2)
    y = np.random.default_rng(3).normal(size=(200, 8)) * 2
    p = lattice.decode(y)
    assert (np.all(p == np.rint(p), 1) | np.all(p - 0.5 == np.rint(p - 0.5), 1)).all() and (p.sum(1) % 2 == 0).all()
    near = ((y[:, None] - (p[:, None] + lattice.shortest()[None])) ** 2).sum(2).min(1)
    assert (((y - p) ** 2).sum(1) <= near + 1e-12).all()


def brute_links(rows, least):
    good = {a: np.array(v, float) / np.linalg.norm(v) for a, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {a: {b for b in good if b != a and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least} for a in good}
    label = {a: a for a in range(len(rows))}
    for _ in rows:
        label = {a: min([label[a], *[label[b] for b in links.get(a, ())]]) for a in label}
    least_id = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least_id[label[a]] = min(i, least_id.get(label[a], i))
    return sorted(((i, len(links.get(a, ())), None if i is None else least_id[label[a]], i is not None and i == least_id[label[a]]) for a, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [2048, 5])
def test_lattice_equals_brute_force(spark, block):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(60, 260):
        v = base[rng.integers(0, 8) if i % 2 else rng.integers(0, 60)]
        rows.append((i, (v + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.2, 0.3])).tolist()))
    rows += BAD + [(9030, [0.0] * 24), (9031, (2 * base[0]).tolist()), (3, base[9].tolist()), (None, base[1].tolist())]
    signals = spark.createDataFrame([(*r, 1) for r in rows], "signal_id long, entry_features array<double>, copies int")
    got = sorted((tuple(r) for r in lattice.near_signals(signals, block=block).collect()), key=str)
    assert got == brute_links(rows, 0.95)


def test_lattice_none(spark):
    assert lattice.near_signals(spark.createDataFrame([], "signal_id long, entry_features array<double>")).collect() == []
