import random
import re

import pytest

from cinegrid.llm import ngram_join


def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = ["", " ", "a", "A b", "a b", "a B c", "a b c", None, "é É x y", "x " * 50, "x " * 51]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(3, 120))] for _ in range(25)]
    while len(texts) < n:
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        if rng.random() < 0.3:
            words = passage + words[: rng.randint(1, 12)]
        texts.append(rng.choice([" ", "\n"]).join(words))
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 3, 90), (2, 5, 80), (3, 2, 60)])
def test_components_against_all_pairs(spark, seed, words, percent):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as token")
    got = ngram_join.link_components(df.repartition(3), words=words, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, words, percent)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (4, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(df, words=3, percent=90).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (4, 0, 4)], key=str)
    assert ngram_join.link_components(df.limit(0)).count() == 0
    kept = ngram_join.keep_one_of_each(df.where("doc_id is not null"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 1, 4]


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    near = [" ".join([*w[:-1], "other"]) for w in (a, b, c)]
    a, b, c = map(" ".join, (a, b, c))
    rows = [(1, a), (1, b), (2, near[0]), (0, near[1]), (None, c), (None, near[2]), (None, c), (None, None), (None, near[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3):
        kept = [(r.doc_id, r.text) for r in ngram_join.keep_one_of_each(df.repartition(parts)).collect()]
        assert len(kept) == 4 and {(1, a), (0, near[1]), (None, None)} <= set(kept)
        assert {t for i, t in kept if i is None and t} <= {c, near[2]}
    got = [(r.doc_id, r.component_id) for r in ngram_join.link_components(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 0), (2, 1), (0, 0), (None, None), (None, None), (None, None), (None, None), (None, 1)], key=str)


def test_kept_rows_keep_columns_of_any_name(spark):
    rows = [(7, "a b c d e f", 9), (9, "a b c d e f", 7), (3, "x y z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long").selectExpr("*", "_row as row", "_row as c0", "_row as id")
    got = sorted(map(tuple, ngram_join.keep_one_of_each(df).collect()))
    assert got == [(3, "x y z", 1, 1, 1, 1), (7, "a b c d e f", 9, 9, 9, 9)]
