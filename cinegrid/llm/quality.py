"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Each passage is encoded: the mean of its words' embeddings (learned,
WORD_DIMS numbers for each of WORD_BUCKETS hash buckets of words) and FEATURES of its surface pass a hidden layer. A gated
attention weighs the passages of the document, and the weighted mean of the encodings is scored by a logistic unit. All
weights, the embeddings too, are learned together from document labels alone. Whole texts are read in scoring. The model,
some tens of thousands of numbers, is fitted on the driver on a bounded sample: at most TRAIN_DOCS labelled documents, those
with the smallest hashed ids, one row each, and of a document of more than TRAIN_PASSAGES passages those with the smallest
hashes.

Rows with crc32(id as text) mod HELD_OUT_OF = 0 never train. Ids, languages, sources and labels are no inputs of a score.
A null or empty text is one passage without words. Several labels of one id count as their mean; null labels do not
count; without labels of both kinds every document gets the mean label (0.5 without any). A score equal to the threshold is
predicted 1. Each row of the table gives one row, repeated ids and null ids too; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrid.llm.common import small_batches
from cinegrid.llm.wordhash import WordHasher, shingles, slices

PASSAGE_WORDS = 64
TRAIN_DOCS, TRAIN_PASSAGES = 4000, 500
WORD_BUCKETS, WORD_DIMS = 4096, 8
HELD_OUT_OF = 5
THRESHOLD = 0.3
HIDDEN, GATE, EPOCHS, BATCH = 16, 8, 30, 64

#: Byte classes whose share of a passage's bytes is a feature.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".?;:", "comma": b",", "bang": b"!", "bar": b"|", "mark": b"#$%&*", "bracket": b"(){}[]<>=\"'/\\_@+-~^`", "wide": bytes(range(128, 256))}
FEATURES = [*CLASSES, "word_bytes", "short_words", "capital_words", "distinct", "repeated", "twice", "log_words"]


@dataclass
class Bags:
    """Passages of some texts: their surface features, where each text's passages start, the hash buckets of the words, and where
    each passage's words start."""

    x: np.ndarray
    first: np.ndarray
    words: np.ndarray
    at: np.ndarray

    def one(self, text: int) -> Bags:
        a, b = self.first[text], self.first[text + 1]
        return Bags(self.x[a:b], np.array([0, b - a]), self.words[self.at[a] : self.at[b]], self.at[a : b + 1] - self.at[a])

    def sampled(self, most: int) -> Bags:
        """Of one text, at most so many passages: those with the smallest hashes of what they hold."""
        n = len(self.x)
        if n <= most:
            return self
        hashes = [zlib.crc32(self.words[a:b].tobytes()) for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        pick = np.sort(np.lexsort((np.arange(n), hashes))[:most])
        sizes = np.diff(self.at)[pick]
        words = np.concatenate([self.words[self.at[i] : self.at[i + 1]] for i in pick])
        return Bags(self.x[pick], np.array([0, most]), words, np.concatenate([[0], np.cumsum(sizes)]))

    @staticmethod
    def joined(bags: list[Bags]) -> Bags:
        first = np.concatenate([[0], np.cumsum([len(b.x) for b in bags])])
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b.at) for b in bags]))])
        return Bags(np.concatenate([b.x for b in bags]), first, np.concatenate([b.words for b in bags]), at)


def features(hasher: WordHasher, texts: pa.Array) -> Bags:
    w = hasher(texts, lower=False)
    counts = np.diff(w.first)
    n = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n)])
    x = np.zeros((first[-1], len(FEATURES)), np.float32)
    words = len(w.start)
    if not words:
        return Bags(x, first, np.zeros(0, np.uint16), np.zeros(first[-1] + 1, np.int64))
    within = np.arange(words) - w.first[w.text]
    passage = first[w.text] + within // PASSAGE_WORDS
    size = np.bincount(passage, minlength=first[-1]).astype(np.float32)
    length = (w.end - w.start).astype(np.float32)
    total = np.bincount(passage, length, first[-1])

    def share(per_word: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(passage, per_word, first[-1]) / np.maximum(of, 1)

    for k, chars in enumerate(CLASSES.values()):
        member = np.zeros(256, np.int64)
        member[list(chars)] = 1
        upto = np.concatenate([[0], np.cumsum(member[w.data])])
        x[:, k] = share(upto[w.end] - upto[w.start], total)
    k = len(CLASSES)
    capital = (w.data[w.start] >= 65) & (w.data[w.start] <= 90)
    x[:, k] = total / np.maximum(size, 1) / 8
    x[:, k + 1] = share(length <= 3, size)
    x[:, k + 2] = share(capital, size)
    order = np.lexsort((w.hash, passage))
    fresh = np.ones(words)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    x[:, k + 3] = np.bincount(passage[order], fresh, first[-1]) / np.maximum(size, 1)
    s, at = shingles(w, 3)
    again = np.zeros(len(s))
    for t in np.flatnonzero(np.diff(at) > 1):  # word triples that stand more than once in the text
        _, back, times = np.unique(s[at[t] : at[t + 1]], return_inverse=True, return_counts=True)
        again[at[t] : at[t + 1]] = times[back] > 1
    spot = np.repeat(w.first[:-1] - at[:-1], np.diff(at)) + np.arange(len(s))
    x[:, k + 4] = np.bincount(passage[spot], again, first[-1]) / np.maximum(size, 1)
    same = np.zeros(words)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    x[:, k + 5] = share(same, size)
    x[:, k + 6] = np.log1p(size) / 4
    return Bags(x, first, (w.hash >> np.uint64(40)).astype(np.int64).astype(np.uint16) % WORD_BUCKETS, np.searchsorted(passage, np.arange(first[-1] + 1)))


class AttentionModel:
    """Gated attention pooling over passages; forward and gradients over bags laid end to end."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = len(FEATURES)

        def normal(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.p = {"W": normal(d, HIDDEN), "M": normal(WORD_DIMS, HIDDEN), "b": np.zeros(HIDDEN), "V": normal(HIDDEN, GATE), "U": normal(HIDDEN, GATE), "w": normal(GATE), "c": normal(HIDDEN), "d": np.zeros(1)}
        self.p["E"] = rng.normal(0, 0.02, (WORD_BUCKETS, WORD_DIMS))
        self.mean, self.scale, self.constant = np.zeros(d), np.ones(d), None

    def forward(self, bags: Bags) -> dict[str, np.ndarray]:
        p, bag, starts = self.p, np.repeat(np.arange(len(bags.first) - 1), np.diff(bags.first)), bags.first[:-1]
        x, size = (bags.x - self.mean) / self.scale, np.diff(bags.at)
        m = np.zeros((len(x), WORD_DIMS))
        if len(bags.words):
            m[size > 0] = np.add.reduceat(p["E"][bags.words], bags.at[:-1][size > 0]) / size[size > 0][:, None]
        h = np.tanh(x @ p["W"] + m @ p["M"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "m": m, "size": size, "bag": bag, "starts": starts, "h": h, "t": t, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def gradients(self, f: dict[str, np.ndarray], words: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, bag, h, t, g, a = self.p, f["bag"], f["h"], f["t"], f["g"], f["a"]
        err = (f["y"] - y) / len(y)
        dz = err[:, None] * p["c"]
        through = (dz[bag] * h).sum(1)
        de = a * (through - np.add.reduceat(a * through, f["starts"])[bag])
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        each = np.repeat((dh @ p["M"].T) / np.maximum(f["size"], 1)[:, None], f["size"], axis=0)
        embedded = np.stack([np.bincount(words, each[:, i], WORD_BUCKETS) for i in range(WORD_DIMS)], 1)
        return {"W": f["x"].T @ dh, "M": f["m"].T @ dh, "E": embedded, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": f["z"].T @ err, "d": np.array([err.sum()])}

    def fit(self, bags: list[Bags], y: np.ndarray) -> AttentionModel:
        if len(y) == 0 or y.min() > 0.5 or y.max() < 0.5:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rows = np.concatenate([b.x for b in bags])
        self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-3
        rng, m, v, step = np.random.default_rng(11), {}, {}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                batch = Bags.joined([bags[i] for i in pick])
                grads = self.gradients(self.forward(batch), batch.words, y[pick])
                step += 1
                for k, grad in grads.items():  # Adam with a little weight decay, more for what few words teach
                    grad = grad + (1e-3 if k == "E" else 1e-4) * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * grad
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * grad**2
                    self.p[k] = self.p[k] - 0.01 * 0.95**epoch * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: Bags) -> np.ndarray:
        return np.full(len(bags.first) - 1, self.constant) if self.constant is not None else self.forward(bags)["y"]


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == 0


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        for part, texts in slices(batch, "text"):
            bags = features(hasher, texts)
            one = [bags.one(i).sampled(TRAIN_PASSAGES) for i in range(part.num_rows)]
            flat = [[b.x.astype(np.float32).tobytes() for b in one], [b.words.astype(np.uint16).tobytes() for b in one], [b.at.astype(np.int32).tobytes() for b in one]]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.binary()) for c in flat)], names=["id", "x", "words", "at"])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_DOCS) -> AttentionModel:
    """Fits the model on at most `most` labelled documents."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    known = known.groupBy(F.col(key).cast("long").alias("id")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(most)
    narrow = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sample = narrow.join(F.broadcast(picked.select("id")), "id", "left_semi").mapInArrow(_bags, "id long, x binary, words binary, at binary")
    sample = sample.groupBy("id").agg(F.min(F.struct("x", "words", "at")).alias("bag"))  # of rows that share an id, one
    target = {r.id: r.label for r in picked.collect()}
    rows = sorted(((r.id, r.bag) for r in sample.collect()), key=lambda r: r[0])  # TRAIN_DOCS rows of TRAIN_PASSAGES passages at most
    bags = []
    for _, b in rows:
        x = np.frombuffer(b.x, np.float32).reshape(-1, len(FEATURES))
        bags.append(Bags(x, np.array([0, len(x)]), np.frombuffer(b.words, np.uint16), np.frombuffer(b.at, np.int32).astype(np.int64)))
    return AttentionModel().fit(bags, np.array([target[i] for i, _ in rows]))


def score(docs: DataFrame, model: AttentionModel, key: str = "doc_id", text: str = "text", keep: float | None = None) -> DataFrame:
    """Without keep: id and score of every row. With keep: the rows whose score is at least keep, with all their columns."""
    small_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]) if keep is not None else docs.select(F.col(key).alias("c0"), F.col(text).alias("c1"))
    column = f"c{names.index(text)}" if keep is not None else "c1"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for part, texts in slices(batch, column):
                y = model.score(features(hasher, texts))
                if keep is not None:
                    yield part.filter(pa.array(y >= keep))
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(y, pa.float64())], names=["c0", "score"])

    if keep is not None:
        return plain.mapInArrow(run, plain.schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
    kind = docs.schema[key].dataType.simpleString()
    return plain.mapInArrow(run, f"c0 {kind}, score double").withColumnRenamed("c0", key)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    scored = score(docs, train(docs, labels, key, text), key, text)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
