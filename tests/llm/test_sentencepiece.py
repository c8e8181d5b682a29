import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinegrid.llm import sentencepiece_codec as codec

spm = pytest.importorskip("sentencepiece")
V = codec.load_vocabulary()
T = codec.Tables(V)
E = codec.Encoder(T)
DECODE = codec.decoder(V)
LIB = spm.SentencePieceProcessor(model_file=codec.MODEL)
HARD = ["", " ", "   a  b ", "Hello  world\n\tfoo é 😀  x ", "a\r\nb\x00", "梦" * 300, "ab" * 5000, "x" * 3000, " " * 1000, "▁a", "ﬁ Å ñ", "dededededede" * 90, "http://www.example.com/index.html?a=1&b=2" * 40]


@pytest.mark.parametrize("text", HARD)
def test_ids_equal_the_library(text):
    assert E.encode(text) == LIB.encode(text)
    if "▁" not in text:
        assert DECODE(E.encode(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" aeinorst.,éñßд\n▁!")), st.characters(codec="utf-8")), max_size=200))
def test_random_texts_equal_the_library(text):
    text = text.replace("▁", "")
    assert E.encode(text) == LIB.encode(text)
    assert DECODE(E.encode(text)) == text


def test_unigram_scores_equal_the_library():
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(codec.MODEL, "rb").read())
    model.trainer_spec.model_type = codec.UNIGRAM
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -1.0 - (i * 7919 % 1000) / 61.0 - len(p.piece) * 0.37  # any scores without ties
    lib = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
    pieces = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
    e = codec.Encoder(codec.Tables(codec.Vocabulary(codec.UNIGRAM, pieces, V.texts, V.bytes_, V.unknown, True)))
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("the quick brown fox ends") for _ in range(400))
        ids, want = e.encode(text), lib.encode(text)
        assert sum(map(lib.get_score, ids)) == pytest.approx(sum(map(lib.get_score, want)), abs=1e-2)
        assert lib.decode(ids) == text


def test_window_is_bounded():
    e = codec.Encoder(T)
    for text in ("thequickbrownfox" * 500, "x" * 5000, "naïve" * 3000):
        assert e.encode(text) == LIB.encode(text)
    assert e.widest == codec.WINDOW * e.t.longest  # whatever the length of a stretch
    e = codec.Encoder(T)
    e.encode("the quick brown fox ends")
    assert e.widest <= 6  # short stretches go the same way


def test_paths_that_never_meet():
    pieces = {p: (i, s) for i, (p, s) in enumerate([("▁", -9.0), ("a", -5.0), ("b", -5.0), ("ab", -1.0), ("ba", -1.0)])}
    e = codec.Encoder(codec.Tables(codec.Vocabulary(codec.UNIGRAM, pieces, list(pieces), {}, 0, False)))
    score = {i: s for i, s in pieces.values()}
    for text in ("ab" * 300, "ab" * 300 + "a", "ba" * 301 + "ab"):
        ids = e.encode(text)
        assert "".join(list(pieces)[i] for i in ids) == text
        best = [0.0] + [-1e9] * len(text)
        for i in range(len(text)):
            for k in (1, 2):
                if text[i : i + k] in pieces and i + k <= len(text):
                    best[i + k] = max(best[i + k], best[i] + pieces[text[i : i + k]][1])
        assert sum(score[i] for i in ids) == pytest.approx(best[-1])
    assert e.widest > codec.WINDOW * 2


def test_chunks_and_forgetting(monkeypatch):
    texts = ["the quick  brown fox " * 40, "", "x" * 300, "a b", "   z " * 50]
    monkeypatch.setattr(codec, "CHUNK", 50)
    monkeypatch.setattr(codec, "KEPT_IDS", 20)
    ids, number = codec.Encoder(T)(texts)
    ends = number.cumsum()
    assert [ids[b - n : b].tolist() for n, b in zip(number, ends, strict=True)] == [LIB.encode(t) for t in texts]


def test_rows(spark):
    rows = [(1, "a b", "x"), (2, None, "y"), (2, "", "z"), (None, "é", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = codec.decode(codec.encode(df)).collect()
    assert [(r.doc_id, r.decoded) for r in out] == [(1, "a b"), (2, ""), (2, ""), (None, "é")]
    assert codec.round_trip(df).count() == 4 and codec.round_trip(df.limit(0)).count() == 0


def test_table_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in codec.decode(codec.encode(docs)).collect():
        assert r.decoded == r.text and r.ids == LIB.encode(r.text)


def test_round_trip_in_one_pass(spark):
    rows = [(1, "a b  c"), (2, None), (3, ""), (4, "x\ty é 漢")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit(7))
    two = {r.doc_id: (r.ids, r.decoded, r.text, r.more) for r in codec.decode(codec.encode(df)).collect()}
    one = {r.doc_id: (r.ids, r.decoded, r.text, r.more) for r in codec.encode(df, decoded="decoded").collect()}
    assert one == two and one[2][:3] == ([], "", None)
    over = codec.encode(df, decoded="text")  # a column of that name is replaced
    assert over.columns == ["doc_id", "more", "ids", "text"] and {r.doc_id: r.text for r in over.collect()} == {i: t or "" for i, t in rows}
    told = {r.doc_id: r.decoded_sha256 for r in codec.round_trip(df).collect()}
    assert told == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}
