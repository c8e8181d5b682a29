import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from cinegrid.llm import vector_codes


def brute(rows):
    """rows: id, vector, label. The definition, over rows one by one."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n in {len(v) for _, v, _ in kept}:
        mine = [r for r in kept if len(r[1]) == n]
        cuts = [(n * p // 16, n * (p + 1) // 16) for p in range(16)]
        first = {}
        for i, v, _ in sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
            first.setdefault(i, v)
        start = list(first.values())[:64]
        books = [[v[a:b] for v in start] for a, b in cuts]

        def best(part, book):
            return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), k) for k, e in enumerate(book))

        for _ in range(2):
            for p, (a, b) in enumerate(cuts):
                groups = defaultdict(list)
                for _, v, _ in mine:
                    groups[best(v[a:b], books[p])[1]].append(v[a:b])
                for k, parts in groups.items():
                    books[p][k] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
        digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for i, v, lab in mine:
            found = [best(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
            out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab, digest))
    total = defaultdict(int)
    for r in out:
        total[r[3]] += r[2]
    return sorted(((i, c, e, total[lab], d) for i, c, e, lab, d in out), key=str)


def run(df):
    got = vector_codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert run(df) == brute([(r.vec_id, r.embedding, r.label) for r in df.collect()])


@pytest.mark.parametrize("size", [64, 16, 20, 5])
def test_edges(spark, size):
    rng = np.random.default_rng(size)
    vectors = [rng.integers(-3, 4, size).astype(float).tolist() for _ in range(90)]
    rows = [(i * 7 % 90, v, [None, 1, 2][i % 3]) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[0], 1) for i in range(200)] + [(3, vectors[5], 2), (3, vectors[4], 2), (3, vectors[4], 2), (None, vectors[6], 9), (-5, [float("nan")] * size, 1), (-6, [None] * size, 1), (-7, None, 1), (-8, [float("inf")] + [0.0] * (size - 1), 3), (-9, [], None), (-10, [-0.001] * size, None), (-11, [0.5, 0.25], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as row", "2 as n", "3 as pos", "'x' as key", "5 as error", "6 as v")
    assert run(df) == brute(rows)


def test_empty_and_large(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert run(df) == []
    huge = spark.createDataFrame([(1, [1e30] * 16, 1), (2, [-1e30] * 16, 1)], "vec_id long, embedding array<float>, label int")
    assert [r[2] for r in run(huge)] == [0, 0]
    assert [r[2:4] for r in run(huge.drop("label"))] == [(0, 0), (0, 0)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_sql(spark, sf):
    from cinegrid.llm import queries
    from tests.llm.sql_match import same

    same(spark, queries.QUERIES, queries.ORACLE, "op12_vector_codes", f"/root/testdata/{sf}")
