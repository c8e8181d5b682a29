import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cinegrid.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORDS.findall(low)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, least=20):
    def counts(texts):
        out = [0] * 10000
        for t in texts:
            for f in features(t)[1]:
                out[zlib.crc32(f.encode()) % 10000] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000.0) / ((a + 1.0) * (sum(t) + 10000.0)))) for a, b in zip(s, t, strict=True)]
    rows, able = [], []
    for i, (k, x) in enumerate(docs):
        n, f = features(x)
        w = sum(gain[zlib.crc32(y.encode()) % 10000] for y in f)
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= least:
            able.append(i)
    able.sort(key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0))
    for r, i in enumerate(able[: percent * len(able) // 100], 1):
        rows[i][4] = r
    return sorted(map(tuple, rows), key=str)


def run(spark, docs, target, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as score", "2 as key", "3 as rank", "4 as n_words")
    got = importance.resample(d, spark.createDataFrame([(x,) for x in target], "text string"), **more)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, got.collect()), key=str)


def test_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, importance.resample(docs, bench).collect()), key=str) == brute(rows, [r.text for r in bench.collect()])


@pytest.mark.parametrize("percent", [0, 7, 50, 100])
def test_draws_and_edges(spark, monkeypatch, percent):
    monkeypatch.setattr(importance, "PAGE", 5)
    monkeypatch.setattr(importance, "RANGE_ROWS", 7)
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(["Ab", "c1", "é", "d-e", "x_y", "zz"], rng.integers(0, 30)))) for i in range(150)]
    docs += [(7, "a b c"), (None, None), (None, "w " * 40), (400, ""), (401, "\x00!"), *[(500, "same words here " * 10)] * 30, (501, "q" * 70 + " " + "r" * 200 + " t")]
    assert run(spark, docs, ["ab c1", None, "zz zz"], percent=percent, least_words=4) == brute(docs, ["ab c1", None, "zz zz"], percent, 4)
    assert run(spark, [], ["a"]) == [] and run(spark, docs[:3], []) == brute(docs[:3], [])


def test_pieces_of_long_texts(monkeypatch):
    rng = np.random.default_rng(5)
    text = " ".join("".join(rng.choice(list("aé9-Z"), rng.integers(1, 150))) for _ in range(400))
    hasher = importance.FeatureHasher()

    def counted():
        out = np.zeros(10000, np.int64)
        for runs in hasher(pa.array([text])):
            for _, b in runs:
                out += np.bincount(b, minlength=10000)
        return out

    want = np.zeros(10000, np.int64)
    for f in features(text)[1]:
        want[zlib.crc32(f.encode()) % 10000] += 1
    for most in (1 << 19, 700, 40):
        monkeypatch.setattr(importance, "SLICE_BYTES", most)
        assert (counted() == want).all()


def test_tournament_keeps_one_page_of_a_run_open():
    rng, runs = np.random.default_rng(8), []
    for r in range(9):
        keys = np.sort(rng.integers(0, 50, 40))[::-1].tolist()
        runs.append([{"score": keys[a : a + 4], "key": [r] * 4, "row": list(range(1000 * r + a, 1000 * r + a + 4)), "n_features": [1] * 4, "weight": [1] * 4} for a in range(0, 40, 4)])
    pages = sorted((p for run in runs for p in run), key=lambda p: (-p["score"][0], p["key"][0], p["row"][0]))
    tree, got = importance.Tournament(), []
    for p in pages:
        page = importance.Page(p)
        got += [(x.score[i], x.row[i]) for x, a, b in tree.merge(page.order(0)) for i in range(a, b)]
        tree.enter(page)
        assert tree.size <= 16
    got += [(x.score[i], x.row[i]) for x, a, b in tree.merge() for i in range(a, b)]
    assert got == sorted(((s, r) for p in pages for s, r in zip(p["score"], p["row"], strict=True)), key=lambda x: (-x[0], x[1] // 1000, x[1]))
