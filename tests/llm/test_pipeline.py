import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from placework.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_exact_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.sql(ORACLES["op8_exact_duplicates"]).fetchall()
    df = QUERIES["op8_exact_duplicates"](spark, FOLDER)
    got = df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_follow_each_other(spark, folder):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, FOLDER).write.parquet(folder(name))
        docs = spark.read.parquet(folder(name))
        assert docs.columns == columns
        kept = {r.doc_id for r in docs.collect()}
        assert kept < before or name == "decontamination" and kept <= before
        before = kept
    packed = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert packed == before


def test_stages_equal_brute_force(spark, folder, vocabulary):
    """Each stage's decisions on what its predecessor kept, by comparing everything with everything."""
    from test_tokens import check_packing

    from placework.llm import dart_minhash, decontamination, quality

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")

    def run(name, docs):
        stages[name](spark, docs, FOLDER).write.parquet(folder(name))
        return spark.read.parquet(folder(name))

    def texts_of(df):
        return {r.doc_id: r.text or "" for r in df.collect()}

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.score >= 0.7}
    docs = run("quality", docs)
    texts = texts_of(docs)
    assert set(texts) == good
    quality_of = {r.doc_id: r.quality for r in labels.collect()}
    known = [quality_of[d] == (d in good) for d in texts_of(spark.read.parquet(f"{FOLDER}/documents.parquet")) if d in quality_of]
    assert sum(known) / len(known) > 0.95

    last = {}
    for doc_id, text in sorted(texts.items()):
        last[text] = doc_id
    docs = run("exact_dedup", docs)
    texts = texts_of(docs)
    assert set(texts) == set(last.values())

    ids = sorted(texts)
    root = {d: d for d in ids}
    for k, a in enumerate(ids):
        found = dart_minhash.similarities([texts[a].encode()] * k, [texts[b].encode() for b in ids[:k]]) if k else []
        for b, value in zip(ids, found):
            if value >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    docs = run("near_dedup", docs)
    texts = texts_of(docs)
    assert set(texts) == set(root.values())

    words = {d: decontamination.words_of([t])[0].tolist() for d, t in texts.items()}
    items = [decontamination.words_of([r.text])[0].tolist() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaked = {d for d, w in words.items() for i in items if decontamination.least_distance(i, w)[0] <= int(0.2 * len(i))}
    docs = run("decontamination", docs)
    texts = texts_of(docs)
    assert leaked and set(texts) == set(words) - leaked

    check_packing(stages["packing"](spark, docs, FOLDER).collect(), texts, vocabulary, 1024)


def test_stages_on_hard_and_empty_tables(spark, hard):
    docs = hard.select("doc_id", "text", "score", "digest")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), FOLDER).collect() == [], name
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
