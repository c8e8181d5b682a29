"""Language identification by language-bitmask n-gram filters: bit-sliced Bloom filters.

N-grams are runs of 3 and 4 bytes of the text in UTF-8, after A-Z are lower-cased, other ASCII characters are made spaces and
runs of spaces are one; a text begins and ends with a space. An n-gram is of a language if at least SHARE of the language's
documents that train hold it (and two at least, where there are as many as TWO_FROM). Each language has a Bloom filter of SLOTS
bits and HASHES hashes over its n-grams; the filters are stored by slot, one bit a language, so that the AND of an n-gram's
HASHES slots is the mask of all languages that hold it. A document counts, for each language, the n-grams whose mask has its
bit. A filter with a share f of its bits set answers an n-gram that it doesn't hold with the chance p = f^HASHES, so that of n
n-grams (hits - n*p) / (1 - p) are expected to be real. The language with the most is predicted; its share of all languages'
sum is the score.

Learning counts documents by language and n-gram over all documents that train: tasks count for themselves, with at most
HELD counts at a time, and a partial aggregation adds up. The n-grams kept are bounded by the documents' mean number of
distinct n-grams over SHARE; what is broadcast by SLOTS and the number of languages (LANGUAGES at most, else a ValueError).

Edges: a null text, or one without a letter, is `und` with score 0. Where no n-gram counts for any language, the language of
most training documents is predicted, with score 0; ties go to it too, then to the name that comes first. Without documents
to learn from all is `und`. Texts of any length are read in pieces. Rows with a null lang don't train; a null id counts as an
empty one. Each row gives a row; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrid.llm.common import Scratch, small_batches
from cinegrid.llm.wordhash import SLICE_BYTES, mix, slices

SIZES = (3, 4)
SHARE, TWO_FROM = 0.003, 200
SLOTS, HASHES, LANGUAGES = 1 << 20, 3, 1024
HELD_OUT_OF, HELD_OUT = 4, 2
UNKNOWN = "und"
#: Counts by language and n-gram that a task holds before it gives them out.
HELD = 400_000


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == HELD_OUT


def _letters() -> np.ndarray:
    kind = np.full(256, 32, np.uint8)
    kind[97:123], kind[128:] = np.arange(97, 123), np.arange(128, 256)
    kind[65:91] = kind[97:123]
    return kind


KIND = _letters()


def _laid_out(texts: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
    """Bytes to read n-grams from, and how many of the first ones were read before: short texts each as a space, the text, a
    space and a 0; a single long text in pieces."""
    at = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    if len(raw) <= SLICE_BYTES or len(texts) > 1:
        data = np.full(len(raw) + 3 * len(texts), 32, np.uint8)
        data[np.arange(len(raw)) + np.repeat(3 * np.arange(len(texts)) + 1, np.diff(at))] = KIND[raw]
        data[at[1:] - at[0] + 3 * np.arange(1, len(texts) + 1) - 1] = 0
        yield _single_spaces(data), 0
        return
    tail = np.zeros(0, np.uint8)
    for a in range(0, len(raw), SLICE_BYTES):
        piece = KIND[raw[a : a + SLICE_BYTES]]
        parts = [tail if a else np.array([32], np.uint8), piece, np.array([32], np.uint8)[: int(a + SLICE_BYTES >= len(raw))]]
        data = _single_spaces(np.concatenate(parts))
        yield data, len(tail)
        tail = data[-(max(SIZES) - 1) :]


def _single_spaces(data: np.ndarray) -> np.ndarray:
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    return data[keep]


def ngrams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """texts: without nulls; several only if they are short together. The number of the text and the bytes, as one number, of
    every n-gram, a piece of text at a time."""
    for data, old in _laid_out(texts):
        text, gram, whole = np.cumsum(data == 0), data.astype(np.uint32), data != 0
        byte, inside = gram, whole
        for n in range(2, max(SIZES) + 1):
            gram, whole = (gram[:-1] << np.uint32(8)) | byte[n - 1 :], whole[:-1] & inside[n - 1 :]
            if n in SIZES:
                new = whole & (np.arange(n - 1, n - 1 + len(whole)) >= old)
                yield text[: len(whole)][new], gram[new].astype(np.int64)


def slots(gram: np.ndarray) -> list[np.ndarray]:
    h = mix(gram.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    first, step = h & np.uint64(SLOTS - 1), (h >> np.uint64(32)) | np.uint64(1)
    return [((first + np.uint64(j) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for j in range(HASHES)]


@dataclass
class Filters:
    """Languages, those of most documents first; by 64 languages, a mask for each slot; the false-positive chance of each."""

    languages: list[str]
    masks: np.ndarray
    chance: np.ndarray

    @staticmethod
    def of(languages: list[str], slot: np.ndarray, word: np.ndarray, mask: np.ndarray) -> Filters:
        masks = np.zeros((-(-len(languages) // 64), SLOTS), np.uint64)
        masks[word, slot] = mask.astype(np.int64).view(np.uint64)
        share = [np.count_nonzero(masks[k // 64] & (np.uint64(1) << np.uint64(k % 64))) / SLOTS for k in range(len(languages))]
        return Filters(languages, masks, np.array(share) ** HASHES)

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """By text: the number of n-grams, and of those in each language's filter."""
        total, found = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for text, gram in ngrams(texts):
            total += np.bincount(text, minlength=len(texts))
            where = slots(gram)
            for k, table in enumerate(self.masks):
                mask = table[where[0]]
                for at in where[1:]:
                    mask &= table[at]
                some = np.flatnonzero(mask)
                mask, of = mask[some], text[some]
                for bit in range(min(64, len(self.languages) - 64 * k)):
                    found[:, 64 * k + bit] += np.bincount(of[(mask >> np.uint64(bit)) & np.uint64(1) == 1], minlength=len(texts))
        return total, found

    def decide(self, total: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language that each text has most n-grams of, corrected for false positives, and its share."""
        real = np.maximum(0, found - total[:, None] * self.chance) / np.maximum(1 - self.chance, 1e-9)
        best = real.argmax(1)
        return best, real[np.arange(len(real)), best] / np.maximum(real.sum(1), 1e-300)


def document_counts(docs: DataFrame) -> DataFrame:
    """docs: text, lang, no nulls. lang, gram and n: the language's documents that hold the n-gram; gram -1 stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held, size = [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            total = pd.DataFrame({"k": np.concatenate([k for k, _ in held]), "n": np.concatenate([n for _, n in held])}).groupby("k", sort=False)["n"].sum()
            return total.index.to_numpy(), total.to_numpy()

        def given(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            lang = pa.array(list(names), pa.string()).take(pa.array(key >> 33))
            return pa.RecordBatch.from_arrays([lang, pa.array((key & ((1 << 33) - 1)) - 1), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for part, texts in slices(batch, "text"):
                lang = np.array([names.setdefault(x, len(names)) for x in part.column(1).to_pylist()], np.int64)
                pairs = [pd.unique((text << 33) | (gram + 1)) for text, gram in ngrams(texts)]
                pairs = pd.unique(np.concatenate([*pairs, np.arange(len(texts)) << 33]))
                key = (lang[pairs >> 33] << 33) | (pairs & ((1 << 33) - 1))
                count = pd.Series(key).value_counts(sort=False)
                held.append((count.index.to_numpy(), count.to_numpy()))
                size += len(count)
                if size > 2 * HELD:
                    held = [added()]
                    size = len(held[0][0])
                    if size > HELD:
                        yield given(*held[0])
                        held, size = [], 0
        if held:
            yield given(*added())

    each = docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Filters from all rows that are not held out and have a text and a language."""
    scratch = Scratch(docs.sparkSession, "language")
    mine = docs.where(~held_out(F.col(key)) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = scratch.save(document_counts(mine.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))))
    sizes = counts.where("gram = -1").orderBy(F.desc("n"), "lang").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"documents are of more than {LANGUAGES} languages")
    spark, languages = docs.sparkSession, [r.lang for r in sizes]
    known = spark.createDataFrame([(r.lang, k, max(2.0 if r.n >= TWO_FROM else 1.0, SHARE * r.n)) for k, r in enumerate(sizes)], "lang string, place int, least double")
    kept = counts.where("gram >= 0").join(F.broadcast(known), "lang").where("n >= least").select("gram", "place")  # LANGUAGES rows

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, place = (c.to_numpy().astype(np.int64) for c in batch.columns)
            mask = (np.uint64(1) << (place % 64).astype(np.uint64)).view(np.int64)
            columns = np.concatenate(slots(gram)).astype(np.int32), np.tile(place // 64, HASHES).astype(np.int32), np.tile(mask, HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "word", "mask"])

    masks = kept.mapInArrow(bits, "slot int, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # SLOTS rows for 64 languages
    return Filters.of(languages, *(masks.column(c).to_numpy() for c in ("slot", "word", "mask")))


def predict(docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            for part, texts in slices(batch, "text"):
                letters = part.column(2).to_pylist()
                if f.languages:
                    best, share = f.decide(*f.hits(texts))
                    names = [f.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, share, 0.0)
                else:
                    names, score = [UNKNOWN] * len(letters), np.zeros(len(letters))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], names=["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter")
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), letter)
    return plain.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    found = predict(docs, learn(docs, key, text, lang), key, text)
    return found.select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
