import hashlib

import corpus_pipeline as cp
from cinegrid.llm import quality, sentencepiece_codec
from tests.llm.test_exact_dedup import SPACES
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "lang")
    rows = {r.doc_id: r for r in docs.collect()}

    kept = cp.keep_quality(spark, docs, SF)
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs, model).where("score >= 0.3").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want and 0 < len(want) < len(rows)

    exact = cp.drop_exact(spark, kept, SF)
    best = {}
    for i in want:
        norm = rows[i].text.translate(SPACES)
        best[norm] = min(best.get(norm, (1, 0)), (-len(rows[i].text), i))
    assert {r.doc_id for r in exact.collect()} == {i for _, i in best.values()} and exact.columns == docs.columns

    near = cp.drop_near(spark, exact, SF)
    left = [(r.doc_id, r.text) for r in exact.collect()]
    assert {r.doc_id for r in near.collect()} == {c for d, _, c in brute(left, cp.NEAR_WORDS, cp.NEAR_PERCENT)} and near.columns == docs.columns

    mixed = cp.mix_sources(spark, near, SF)
    sizes, taken, largest = {}, {}, {}
    for r in near.collect():
        n = len(r.text.split())
        sizes[r.source] = sizes.get(r.source, 0) + n
        largest[r.source] = max(largest.get(r.source, 0), n)
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert mixed.columns == docs.columns
    assert all(abs(taken.get(s, 0) - t) <= largest[s] for s, t in targets(sizes).items())

    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.Tables(sentencepiece_codec.load_vocabulary()))
    for r in cp.tokenize(spark, mixed, SF).collect():
        assert r.ids == encoder.encode(rows[r.doc_id].text) and r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].text.encode()).hexdigest()


def test_run_is_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, docs.collect()))
