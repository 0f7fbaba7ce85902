import datetime as dt

import numpy as np

from folioflow.llm import vectors as V

T = dt.datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, vector_bytes binary, created_at timestamp, key string, rep string")


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(700, 64))
    x = np.concatenate([base, base[:300] + rng.normal(size=(300, 64)) * 0.12]).astype("<f4")
    df = frame(spark, [(f"k{i:04d}", v.tobytes(), T, None, None) for i, v in enumerate(x)])
    got = V.similar_vectors(V.unit_vectors(V.latest_vectors(df)), k=5, least=0.9)
    pairs = {tuple(sorted((r.key, r.neighbour))) for r in got.collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -1)
    true = {tuple(sorted((f"k{i:04d}", f"k{j:04d}"))) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    assert len(true) >= 280 and len(pairs & true) >= 0.97 * len(true) and pairs <= true


def test_recall_of_all_neighbours(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 64))[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 64)) * 0.8).astype("<f4")
    df = frame(spark, [(f"k{i:04d}", v.tobytes(), T, None, None) for i, v in enumerate(x)])
    got = V.similar_vectors(V.unit_vectors(V.latest_vectors(df)), k=5).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -1)
    kth = np.sort(s, 1)[:, -5]
    assert sum(r.similarity >= kth[int(r.key[1:])] - 1e-5 for r in got) >= 0.9 * 5 * len(x)


def test_copies_ties_and_limits(spark):
    v = np.zeros(64, "<f4")
    v[0] = 1
    w = v.copy()
    w[1] = 0.2
    rows = [(f"c{i:02d}", v.tobytes() if i % 2 else (v * 3).tobytes(), T, None, None) for i in range(12)] + [("z", w.tobytes(), T, None, None)]
    got = V.similar_vectors(V.unit_vectors(V.latest_vectors(frame(spark, rows))), k=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.key, []).append((r.rank, r.neighbour, round(r.similarity, 4)))
    assert all(len(x) == 5 for x in by.values()) and len(by) == 13
    assert [n for _, n, _ in sorted(by["c11"])] == ["c00", "c01", "c02", "c03", "c04"] and sorted(by["z"])[0][2] == round(1 / np.hypot(1, 0.2), 4)


def test_invalid_and_newest(spark):
    good = np.ones(64, "<f4")
    bad = good.copy()
    bad[3] = np.nan
    rows = [("a", good.tobytes(), T, None, None), ("a", None, T + dt.timedelta(days=1), None, None), ("b", good.tobytes(), None, None, None), ("b", good.tobytes(), None, None, None), ("c", bad.tobytes(), T, None, None), ("d", bytes(256), T, None, None), ("e", good.tobytes()[:-4], T, None, None), (None, good.tobytes(), T, None, None), ("f", (-good).tobytes(), T, None, None)]
    assert sorted(r.key for r in V.unit_vectors(V.latest_vectors(frame(spark, rows))).collect()) == ["b", "f"]
    assert V.similar_vectors(V.unit_vectors(V.latest_vectors(frame(spark, []))), k=5).count() == 0
    one = V.similar_vectors(V.unit_vectors(V.latest_vectors(frame(spark, rows[2:3]))), k=5)
    assert one.count() == 0
