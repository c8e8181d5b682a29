from collections import defaultdict

import pytest

from cinegrid.llm import exact_dedup

SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")
ROWS = [(1, "a b", "x"), (2, "ab", "y"), (3, "a  b", "z"), (4, "a\tb\n", "z"), (None, "a  b", "n"), (5, None, "x"), (6, "", None), (7, " ", "x"), (8, "é", "x"), (8, "é", "x"), (9, "u\u00a0v", "q"), (10, "L" * 200_000, "q")]


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(SPACES)].append((-len(t or ""), i is None, i or 0, i))
    return sorted(((i, min(g)[3], len(g)) for g in groups.values() for *_, i in g), key=str)


@pytest.mark.parametrize("hot_from", [64, 2])
@pytest.mark.parametrize("parts", [1, 7])
def test_groups(spark, monkeypatch, hot_from, parts):
    monkeypatch.setattr(exact_dedup, "HOT_FROM", hot_from)
    df = spark.createDataFrame(ROWS * 3, "doc_id long, text string, digest string").repartition(parts)
    out = exact_dedup.duplicate_groups(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=str) == brute(ROWS * 3)
    groups = {r.text_sha256 for r in out}
    assert sum(r.kept for r in out) == len(groups) and {r.text_sha256 for r in out if r.kept} == groups
    left = exact_dedup.drop_duplicates(df)
    assert left.columns == df.columns and left.count() == len(groups)
    assert {r.doc_id for r in left.collect()} == {r.keep_id for r in out}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.duplicate_groups(df).count() == 0 and exact_dedup.drop_duplicates(df).count() == 0
