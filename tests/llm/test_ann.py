import numpy as np
import pytest
from pyspark.sql import functions as F

from cinegrid.llm import ann


def exact(rows, queries, k):
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and len(v) == 4 or v is not None and i is not None and len(v) > 4 and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v)}
    out = {}
    for q in queries:
        if q in good:
            s = {i: float(np.dot(v, good[q]) / (np.linalg.norm(v) * np.linalg.norm(good[q]))) for i, v in good.items() if i != q}
            out[q] = sorted(s, key=lambda i: (-round(s[i], 12), i))[:k]
    return out


def recall(got, want):
    have = {}
    for r in got:
        have.setdefault(r.query_id, set()).add(r.vec_id)
    return sum(len(have.get(q, set()) & set(ids)) for q, ids in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = ann.nearest(df, F.col("id") % 50 == 0).collect()
    want = exact(rows, [i for i, _ in rows if i % 50 == 0], 5)
    assert len(got) == sum(map(len, want.values()))
    assert recall(got, want) >= 0.9
    vectors = dict(rows)
    for r in got[:200]:
        a, b = (np.array(vectors[i], np.float64) for i in (r.query_id, r.vec_id))
        assert abs(r.score - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-14


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [1.0, 0.0, 0.5, 0.25, 0.0]
    rows = [(0, base), (1, base), (2, [2 * x for x in base]), (3, base), (4, [0.0] * 5), (5, None), (6, [nan, 1.0, 1.0, 1.0, 1.0]), (7, [inf, 1.0, 1.0, 1.0, 1.0]), (8, [None, 1.0, 1.0, 1.0, 1.0]), (9, []), (None, base), (50, [1e30, 1e30, 1e30, 1e30, 1e30]), (50, [1e30, 1e30, 1e30, 1e30, 1e30]), (11, [1.0, 2.0]), (12, [-x for x in base])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as node", "2 as score")
    got = sorted(((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("id") % 50 == 0).collect()))
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 50), (0, 5, 12), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3), (50, 5, 12)]
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_many_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(3000)]
    got = [(r["rank"], r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") == 0).collect()]
    assert sorted(got) == [(i, 999 + i) for i in range(1, 6)]


def agrees(spark, x, step=1, k=5):
    """Recall against brute force of every step-th row, over float64 cosines."""
    x = np.asarray(x, np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("id") % step == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y, hit, total = ann.scaled(x), 0, 0
    for q in range(0, len(x), step):
        s = ann.cosines(y[q], y)
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
        mine = sorted(got.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(order) + 1))
        assert [(-v, i) for _, i, v in mine] == sorted((-v, i) for _, i, v in mine)
        hit += len({i for _, i, _ in mine} & set(order))
        total += len(order)
    return hit / max(1, total)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_small_tables_are_exact(spark, n):
    assert agrees(spark, np.random.default_rng(n).normal(size=(n, 8))) == (1.0 if n > 1 else 0)


def test_orthogonal_vectors_tie_exactly(spark):
    assert agrees(spark, np.eye(30)) == 1
    assert agrees(spark, np.eye(128), 4) == 1
    assert agrees(spark, np.eye(300), 50) == 1  # more ties than a search keeps


@pytest.mark.parametrize("noise", [1e-4, 1e-2])
def test_near_copies(spark, noise):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(4, 64)), 150, axis=0) + noise * rng.normal(size=(600, 64))
    assert agrees(spark, x, 5) >= 0.9
