import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cinegrid.llm import language_id

KEEP = set(range(97, 123)) | set(range(128, 256))


def grams(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b if b in KEEP else 32 for b in text.encode())
    low = re.sub(b" +", b" ", b" " + low + b" ")
    return [int.from_bytes(low[i : i + n], "big") for n in (3, 4) for i in range(len(low) - n + 1)]


def train(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2


def brute(rows):
    """Predictions from the counts that exact sets in place of the filters give."""
    size, held = Counter(), defaultdict(Counter)
    for i, t, lang in rows:
        if train(i) and t is not None and lang is not None:
            size[lang] += 1
            held[lang].update(set(grams(t)))
    sets = {k: {g for g, n in held[k].items() if n >= max(2 if size[k] >= 200 else 1, 0.003 * size[k])} for k in size}
    order = sorted(size, key=lambda k: (-size[k], k))
    out = []
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t) or not order:
            out.append((i, not train(i), "und", 0.0))
            continue
        hits = [sum(g in sets[k] for g in grams(t)) for k in order]
        out.append((i, not train(i), order[int(np.argmax(hits))], max(hits) / max(sum(hits), 1e-300)))
    return out


def test_accuracy_on_held_out_and_exact_sets(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    want = {w[0]: w for w in brute(rows)}
    assert got.keys() == want.keys()
    right = [got[i].lang_pred == lang for i, _, lang in rows if not train(i)]
    assert np.mean(right) >= 0.98
    for i, g in got.items():
        assert g.held_out == want[i][1] and g.lang_pred in ("en", "de", "fr", "es") and 0 <= g.score <= 1
        assert abs(g.score - want[i][3]) < 0.05
    assert np.mean([got[i].lang_pred == want[i][2] for i in got]) > 0.995


def test_edges(spark):
    rows = [(i, "the cat sat on the mat " * (i % 5 + 1), "en") for i in range(40)] + [(100 + i, "der hund und die katze " * (i % 3 + 1), "de") for i in range(30)]
    rows += [(None, "the mat", None), (None, None, "en"), (500, "", "de"), (501, "123 -- 7", "fr"), (502, "the cat", None), (502, "the cat", "en"), (503, "zzz qqq", None), (504, "x" * 3000, None), (505, "Ω", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as key", "2 as score", "'a' as lang_pred", "'b' as source")
    got = language_id.identify(df)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    by = lambda rows: sorted(((r[0], r[1], r[2], round(r[3], 6)) for r in rows), key=str)
    assert by(got.collect()) == by(brute(rows))
    assert language_id.identify(df.limit(0)).collect() == []
    nothing = language_id.identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)} and len(nothing) == len(rows)


@pytest.mark.parametrize("most", [1 << 19, 300, 50, 7])
def test_ngrams_of_pieces(monkeypatch, most):
    rng = np.random.default_rng(most)
    texts = ["".join(rng.choice(list("aB é 9-ß"), rng.integers(0, 12))) for _ in range(60)] + ["", " ", "x"]
    got = defaultdict(Counter)
    for t, g in language_id.ngrams(pa.array(texts)):
        for a, b in zip(t.tolist(), g.tolist(), strict=True):
            got[a][b] += 1
    assert all(got[i] == Counter(grams(t)) for i, t in enumerate(texts))
    monkeypatch.setattr(language_id, "SLICE_BYTES", most)
    long = " ".join(texts) * 3
    total = Counter()
    for _, g in language_id.ngrams(pa.array([long])):
        total.update(g.tolist())
    assert total == Counter(grams(long))


def test_many_languages_and_chances():
    rng, names = np.random.default_rng(1), [f"l{i}" for i in range(70)]
    of = rng.integers(0, 1 << 31, (70, 3000))
    slot = np.concatenate([s for i in range(70) for s in language_id.slots(of[i])])
    word, bit = np.repeat(np.arange(70) // 64, 9000), np.repeat(np.arange(70) % 64, 9000)
    mask = np.zeros((2, language_id.SLOTS), np.uint64)
    np.bitwise_or.at(mask, (word, slot), np.uint64(1) << bit.astype(np.uint64))
    w, s = np.nonzero(mask)
    f = language_id.Filters.of(names, s, w, mask[w, s].view(np.int64))
    assert f.masks.shape == (2, language_id.SLOTS) and np.all(f.chance > 0) and np.all(f.chance < 1e-5)
    total, found = np.array([1000.0]), np.zeros((1, 70))
    for k in range(70):
        hit = np.ones(3000, bool)
        for at in language_id.slots(of[69]):
            hit &= (f.masks[k // 64][at] >> np.uint64(k % 64)) & np.uint64(1) == 1
        found[0, k] = hit.mean() * 1000
    assert f.decide(total, found)[0][0] == 69
