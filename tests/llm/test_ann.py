import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcurves.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>"


def clusters(n=6000, d=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    x = (centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, d))).astype(np.float32)
    x[n // 6 : n // 3] = x[n // 6]  # many equal vectors
    return x


def brute(x, ids, asks, k):
    x = x.astype(float)
    out = {}
    for q in asks:
        score = np.einsum("vd,d->v", x, x[q])
        score[ids == ids[q]] = -np.inf
        order = np.lexsort((ids, -score))
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order[:k] if score[j] > -np.inf]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_exact_scores(spark):
    x = clusters()
    ids = np.arange(len(x))
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA).repartition(4)
    got = found(A.nearest(frame, F.col("vec_id") % 50 == 0, k=10, block=100))
    want = brute(x, ids, ids[::50], 10)
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    for q, rows in got.items():
        score = {j: float(np.dot(x[j].astype(float), x[q].astype(float))) for j, _ in rows}
        assert all(abs(score[j] - s) < 1e-9 for j, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_depth_follows_from_the_rows():
    assert [A.depth_for(n, min(n, A.SAMPLE)) for n in (0, 1, 9, 500, 50_000, 10**6, 10**9)] == [0, 0, 0, 3, 6, 8, 11]


@pytest.mark.parametrize("n", [500, 12_000])
def test_recall_on_noise_at_several_depths(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 24)).astype(np.float32)
    ids = np.arange(n)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA).repartition(4)
    got, want = found(A.nearest(frame, F.col("vec_id") % 20 == 0, k=20)), brute(x, ids, ids[::20], 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_one_leaf_is_searched_whole(spark):
    x = clusters(300, 5)
    ids = np.arange(300)
    frame = spark.createDataFrame([(int(i), v.tolist(), "x", 1.0) for i, v in zip(ids, x)], SCHEMA + ", id string, score double")
    got, want = found(A.nearest(frame, F.col("vec_id") % 20 == 0, k=7, few=100.0)), brute(x, ids, ids[::20], 7)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]),
            (None, [9.0, 9.0]), (0, [1.0, 0.0]), (2, [0.5, 0.5]), (20, [1.0, 1.0]), (40, [0.0, 0.0]), (60, None)]
    got = found(A.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=20))
    assert got == {0: [(20, 1.0), (1, 0.5), (2, 0.5)], 20: [(0, 1.0), (1, 1.0), (2, 1.0)]}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(20, [1.0])], [(1, [0.0])]])
def test_nothing_to_find(spark, rows):
    assert A.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_queue_visits_every_leaf_once_nearest_first():
    x = clusters(500, 6).astype(float)
    forest = A.grow(x, trees=3, depth=3)
    order = list(forest.visits(x[7]))
    assert len(order) == len(set(order)) == 3 * 8
    own = forest.leaves(x[7:8])[0]
    assert order[0] == (0, own[0])
    far = {}
    for t, leaf in order:  # the sum of squared margins on the wrong side never falls
        node, cost, path = leaf + 7, 0.0, []
        while node:
            path.append((node, (node - 1) // 2))
            node = (node - 1) // 2
        for child, parent in path:
            m = forest.directions[t, parent] @ x[7] - forest.cuts[t, parent]
            cost += m * m if (child % 2 == 0) != (m > 0) else 0.0
        far[(t, leaf)] = cost
    assert [far[o] for o in order] == sorted(far[o] for o in order)
