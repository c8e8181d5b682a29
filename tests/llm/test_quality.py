import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from cinegrid.llm import quality
from cinegrid.llm.wordhash import WordHasher

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    good = [r for r in out if r.quality == 1]
    junk = [r for r in out if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) > 0.98
    assert sum(1 - r.predicted for r in junk) / len(junk) > 0.95


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    m = quality.AttentionModel()
    at = np.array([0, 3, 3, 5, 9, 9, 10, 14, 17, 20])  # two passages without words
    bags = quality.Bags(rng.normal(size=(9, len(quality.FEATURES))), np.array([0, 4, 5, 9]), rng.integers(0, 40, 20).astype(np.uint16), at)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = m.forward(bags)["y"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = m.gradients(m.forward(bags), bags.words, y)
    for k, g in grads.items():
        flat = m.p[k].reshape(-1)
        for i in (0, flat.size - 1, int(bags.words[4]) * quality.WORD_DIMS if k == "E" else 0):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[i]) < 1e-6, k


def scored_by_brute_force(m, text):
    """One text, one passage and one word at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    passages = [words[i : i + 64] for i in range(0, len(words), 64)] or [[]]
    times = Counter(zip(words, words[1:], words[2:], strict=False))
    encoded = []
    for k, p in enumerate(passages):
        raw, n = "".join(p).encode(), max(1, len(p))
        x = [sum(c in chars for c in raw) / max(1, len(raw)) for chars in quality.CLASSES.values()]
        at = 64 * k
        triples = sum(times[tuple(words[i : i + 3])] > 1 for i in range(at, min(at + 64, len(words) - 2))) if len(words) > 3 else 0
        twice = sum(i > 0 and words[i] == words[i - 1] for i in range(at, at + len(p)))
        x += [len(raw) / n / 8, sum(len(w.encode()) <= 3 for w in p) / n, sum("A" <= w[0] <= "Z" for w in p) / n, len(set(p)) / n, triples / n, twice / n, np.log1p(len(p)) / 4]
        hashes = WordHasher()(pa.array([" ".join(p)]), lower=False).hash
        buckets = [int(h >> np.uint64(40)) % 65536 % quality.WORD_BUCKETS for h in hashes]
        mean = sum((m.p["E"][b] for b in buckets), np.zeros(quality.WORD_DIMS)) / max(1, len(buckets))
        x = np.zeros(len(x)) if not p else np.array(x)
        encoded.append(np.tanh((x - m.mean) / m.scale @ m.p["W"] + mean @ m.p["M"] + m.p["b"]))
    weights = np.exp([float((np.tanh(h @ m.p["V"]) / (1 + np.exp(-(h @ m.p["U"])))) @ m.p["w"]) for h in encoded])
    z = sum(a * h for a, h in zip(weights / weights.sum(), encoded, strict=True))
    return 1 / (1 + np.exp(-(z @ m.p["c"] + m.p["d"][0])))


def test_scores_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    for r in quality.score(docs, model).collect():
        assert abs(r.score - scored_by_brute_force(model, texts[r.doc_id])) < 1e-5, r.doc_id


def test_passages_cover_the_whole_text():
    bags = quality.features(WordHasher(), pa.array(["", "a b", "w " * 1000, "x" * 100_000]))
    assert np.diff(bags.first).tolist() == [1, 1, 16, 1] and not bags.x[0].any()
    assert np.diff(bags.at).tolist() == [0, 2, *[64] * 15, 40, 1]
    few = bags.one(2).sampled(5)
    assert len(few.x) == 5 and len(few.words) == few.at[-1]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "u"), (1, "a b c", "v"), (None, None, None), (2, "", "w"), (3, "z " * 5000, "w")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1), (3, 1), (4, 0), (6, 1)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert {(r.doc_id, r.held_out) for r in rows if r.doc_id} == {(i, zlib.crc32(str(i).encode()) % 5 == 0) for i in (1, 2, 3)}
    assert quality.classify(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.classify(docs.limit(0), labels).count() == 0
    model = quality.train(docs, labels)
    assert quality.score(docs, model, keep=0.0).columns == docs.columns and quality.score(docs, model, keep=0.0).count() == 5
