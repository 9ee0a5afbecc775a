import os

import pytest

import corpus_pipeline
from quadloom.llm import crf, exact, mixing, neardup, packing
from quadloom.llm.queries import tokenizer_path
from quadloom.plans.scratch import release, scratch_root

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        counts.append(out.count())
        docs = out
    assert before > counts[0] > counts[1] >= counts[2] > 0
    spark.catalog.clearCache()
    release(spark)
    last = corpus_pipeline.run(spark, SF).collect()
    assert last and {"row", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(last[0].asDict())
    assert sum(p.piece == 0 for p in last) == counts[3] and len({(p.row, p.piece) for p in last}) == len(last)
    # of all its scratch tables only the result is left
    left = os.listdir(scratch_root(spark).removeprefix("file://"))
    assert len(left) == 1 and left[0].startswith("packing-")


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = crf.train(docs, labels)
    good = {r.doc_id for r in crf.score_quality(docs, model).collect() if r.score >= 0.5}
    kept = {}
    for i in sorted(good):
        kept[rows[i].text] = i
    from test_neardup import brute

    near = {i for i, (_, c) in brute([(i, rows[i].text) for i in kept.values()]).items() if i == c}
    d = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, SF)
    assert {r.doc_id for r in d.collect()} == near
    d = d.cache()
    plan = {r.doc_id: r.taken for r in mixing.plan_mix(d).collect()}
    words = {}
    for r in corpus_pipeline.mixture(spark, d, SF).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
        assert r.n_chars == len(r.text)
    assert words == {k: v for k, v in plan.items() if v}


def test_clean_documents_stay(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = docs.join(labels, "doc_id", "left_semi")
    kept = corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.01").join(labels, "doc_id", "left_semi")
    assert kept.count() >= 0.99 * clean.count()


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_entry_registers_everything():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert "pipeline" in known and all(any(n.startswith(f"op{k}_") for n in known) for k in range(1, 11))


@pytest.mark.parametrize("module", [exact, mixing, neardup, packing])
def test_docstrings_define_odd_cases(module):
    assert "Defined cases" in module.__doc__


def test_queries_over_whole_tables(spark):
    from quadloom.llm.queries import QUERIES

    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, q in QUERIES.items():
        rows = q(spark, SF)
        assert rows.select("doc_id").distinct().count() == n, name


def test_tokenizer_is_a_path():
    assert tokenizer_path().endswith("word_bpe_49k.json")
