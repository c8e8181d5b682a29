import hashlib

from pyspark.sql import functions as F

from cinegrid.llm import mixing

SF = "/root/testdata/sf0.001"


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def check(rows, docs):
    sizes = {}
    for i, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = targets(sizes), {}
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        largest = max([r.size for r in rows if r.source == s])
        assert abs(n - want[s]) <= largest


def test_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix_counts(d).collect()
    check(rows, [(r.doc_id, r.text, r.source) for r in d.collect()])
    assert sorted(rows) == sorted(mixing.mix_counts(d.repartition(5)).collect())
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    assert mixed.count() == sum(r.taken // r.size for r in rows if r.size)


def test_nulls_ties_and_empty(spark):
    docs = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "c", None), (None, "d e", None), (3, "", "empty"), (4, "q " * 3000, "y"), (5, "r " * 10, "y")] + [(i, "w v", "z") for i in range(10, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as place")
    rows = mixing.mix_counts(df).collect()
    assert len(rows) == len(docs)
    check([r for r in rows if r.source in ("z", "y", "empty")], docs)
    assert set(mixing.mix(df).columns) == set(df.columns)
    assert mixing.mix_counts(df.limit(0)).count() == 0


def test_place_is_the_digest(spark):
    got = spark.range(5).select(mixing.place(F.col("id")).alias("p")).collect()
    assert [r.p for r in got] == [int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(5)]
