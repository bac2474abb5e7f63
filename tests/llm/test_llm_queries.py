"""The registered queries against SQL, and the pipeline stage by stage against brute force."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from timberline.llm import mixing, simhash, toxicity
from timberline.llm.queries import ORACLE_SQL, QUERIES

from parity import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(connect(SF), ORACLE_SQL[name])


COLUMNS = {
    "op1_token_counts": ["length", "docs"], "op3_nearest_neighbours": ["query_id", "rank", "vec_id", "score"], "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op6_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "op7_html_extraction": ["page_id", "url", "text", "n_chars"], "op10_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name] and df.count() > 0


def test_held_out_rows(spark):
    for r in QUERIES["op4_toxicity"](spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "mixing", "packing"]
    clean = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if scorer.score(r.text) < 0.5}

    one = corpus_pipeline.drop_near_copies(spark, clean, SF).cache()
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in clean.collect()}
    comp = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            low = min(comp[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3)
            changed |= low < comp[i]
            comp[i] = min(comp[i], low)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(comp.values())

    mixed = corpus_pipeline.mix_sources(spark, one, SF)
    sized = one.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    times = {r.doc_id: r.times for r in mixing.mix(sized).collect() if r.times}
    assert mixed.columns == docs.columns and {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == times

    packed = corpus_pipeline.run(spark, SF)
    starts = {r.doc_id: r["count"] for r in packed.where("start = 0").groupBy("doc_id").count().collect()}
    assert starts == times
