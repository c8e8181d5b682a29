import random

import pyarrow as pa

from cinegrid.llm import substring_dedup as sd
from cinegrid.llm.wordhash import WordHasher

VOCAB = [f"w{i}" for i in range(5000)]


def words(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def flagged_by_brute_force(rows):
    seen = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - sd.MIN_WORDS + 1):
            seen.setdefault(tuple(w[k : k + sd.MIN_WORDS]), set()).add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def corpus():
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, rng.randint(0, 300)))) for i in range(150)]
    for p in range(12):  # passages in the middle of lines, in two to twenty documents
        passage = words(rng, rng.randint(51, 90))
        for _ in range(2 + p % 4 * 6):
            at = len(rows)
            rows.append((at, " ".join(words(rng, rng.randint(0, 60)) + passage + words(rng, rng.randint(0, 60)))))
    short = words(rng, 30)
    rows += [(len(rows) + k, " ".join(words(rng, 40) + short + words(rng, 40))) for k in range(6)]
    copy = " ".join(words(rng, 120))
    rows += [(len(rows) + k, copy) for k in range(4)]
    return rows


def test_passages_against_brute_force(spark):
    rows = corpus()
    got = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want, have = flagged_by_brute_force(rows), {r.doc_id for r in got}
    assert have <= want
    assert len(have) >= 0.98 * len(want)
    kept = {r.doc_id for r in got if not r.removed}
    assert kept and all(r.keep_id <= r.doc_id for r in got) and {r.keep_id for r in got} <= have


def test_removal_leaves_one_copy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as start", "2 as t")
    out = sd.remove_repeats(df)
    assert out.columns == df.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert len(left) == len(rows) and len(flagged_by_brute_force(left)) <= 0.05 * len(flagged_by_brute_force(rows))
    clean = {i for i, _ in rows} - flagged_by_brute_force(rows)
    assert all(t == dict(rows)[i] for i, t in left if i in clean)


def test_edge_rows(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(1, long), (1, long), (None, long), (None, None), (2, ""), (3, "x " * 5000), (4, "y " * 5000)]
    got = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.start_word, r.end_word, r.keep_id, r.removed) for r in got) == [(0, 0, 60, 1, True), (1, 0, 60, 1, False), (1, 0, 60, 1, False)]
    assert sd.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_of_lines(spark):
    rng = random.Random(8)
    rows = [(i, "\n".join(" ".join(words(rng, 70)) for _ in range(3))) for i in range(30)]
    line = words(rng, 96)
    for k in range(3):  # an edit in the middle, so no 50 words are equal; J = 87 / 97
        edited = list(line)
        edited[47 + k] = f"edit{k}"
        rows.append((100 + k, "\n".join([" ".join(words(rng, 20)), " ".join(edited), " ".join(words(rng, 20))])))
    got = sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.keep_id, r.removed) for r in got) == [(100 + k, 20, 116, 100, k > 0) for k in range(3)]


def test_long_runs_of_short_repeats_are_clean(spark):
    rng = random.Random(9)
    phrases = [words(rng, 30) for _ in range(12)]
    rows = [(i, " ".join(w for k in rng.sample(range(12), 6) for w in phrases[k] + words(rng, 1))) for i in range(40)]
    got = {r.doc_id for r in sd.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= flagged_by_brute_force(rows)


def test_many_rows_of_one_id(spark):
    rng = random.Random(10)
    passage = words(rng, 60)
    rows = [(7 if k % 2 else None, " ".join(words(rng, 30) + (passage if k % 5 == 0 else []) + words(rng, 30))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "5 as id", "6 as x")
    got = sd.repeated_passages(df).collect()
    assert len(got) == 12 and {r.keep_id for r in got} == {7}
    out = sd.remove_repeats(df)
    assert out.columns == df.columns
    left = [r.text for r in out.collect()]
    assert sum(" ".join(passage[5:-5]) in t for t in left) == 6  # documents of id 7 keep it


def test_bands_and_cuts():
    assert sd.tune_bands() == 4 and sd.tune_bands(80, 3) == 6 and sd.tune_bands(80, sd.ROWS_A_LINE_BAND) == 8
    rng = random.Random(1)
    passage = words(rng, 60)
    a, b = (WordHasher()(pa.array([" ".join(words(rng, 30) + passage + words(rng, 30))]), lower=False) for _ in range(2))
    cuts = [set((sd.paragraphs(w)[0] - 30).tolist()) & set(range(sd.REACH, 59 - sd.REACH)) for w in (a, b)]
    assert cuts[0] == cuts[1] and len(cuts[0]) >= 2
