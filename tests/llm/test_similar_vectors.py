import numpy as np

from stratamem.llm import similar_vectors as sv


def _brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(x @ x.T, 9)
    np.fill_diagonal(sim, -9)
    top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    return {(ids[i], ids[j]) for i, row in enumerate(top) for j in row}


def test_recall_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 16))
    x = (np.repeat(centres, 60, axis=0) + 0.5 * rng.standard_normal((2400, 16))).astype(np.float32)
    x[1200:1800] = rng.standard_normal((600, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["vec_id"], r["near_id"]) for r in sv.nearest(df, "vec_id", "embedding", k=5, dim=16).collect()}
    want = _brute(list(range(len(x))), x.astype(np.float64), 5)
    assert len(got & want) >= 0.95 * len(want)


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [1.0]), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 1.0]), (10, [None, 1.0]), (1, [1.0, 0.0]), (11, [1e-30, 3e38])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, list int")
    got = {}
    for r in sv.nearest(df, "vec_id", "embedding", k=2, dim=2).orderBy("vec_id", "rank").collect():
        got.setdefault(r["vec_id"], []).append(r["near_id"])
    assert got[1] == [2, 3] and got[2] == [1, 3] and got[3] == [1, 2] and got[4] == [11, 1]
    assert set(got) == {1, 2, 3, 4, 11}
    assert sv.nearest(df.limit(0), "vec_id", "embedding", dim=2).count() == 0
    assert sv.nearest(df.where("vec_id = 4"), "vec_id", "embedding", dim=2).count() == 0


def test_full_lists_are_scanned_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sv, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = np.ones((300, 8)) + 0.01 * rng.standard_normal((300, 8))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["vec_id"], r["near_id"]) for r in sv.nearest(df, "vec_id", "embedding", k=3, dim=8).collect()}
    want = _brute(list(range(300)), x.astype(np.float64), 3)
    assert len(got & want) >= 0.95 * len(want)
