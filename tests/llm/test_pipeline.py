"""The pipeline's stages: what each keeps, and that they fit together."""

from __future__ import annotations

import corpus_pipeline
from couponlab import session
from couponlab.llm import quality, secret_scan, winnowing

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, counts = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, FOLDER), f"test-{name}")
        counts.append(docs.count())
        assert docs.schema == before.schema
        assert docs.select("doc_id").distinct().count() == counts[-1]
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert counts == sorted(counts, reverse=True) and counts[0] > counts[-1] > 0
    assert docs.where("text is not null and n_chars != length(text)").count() == 0
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert winnowing.contamination(docs, bench).where("contaminated").count() == 0
    clean = secret_scan.redacted(docs)
    assert clean.exceptAll(docs).count() == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert tokens.count() == counts[-1] and tokens.where("not lossless").count() == 0


def test_first_stage_keeps_what_scores_well(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scored = quality.score(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r["doc_id"] for r in scored.where("predicted = 1").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.good_quality(spark, documents, FOLDER).collect()} == want


def test_odd_documents_pass_all_stages(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (3, "ok then", "en", None, 7)]
    clashing = ["fingerprint", "label", "component_id", "score", "predicted", "spans", "blob_id", "content", "ids", "n_words"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in clashing)
    docs = spark.createDataFrame([(*r, *clashing) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), f"odd-{name}")
        assert all(tuple(r[c] for c in clashing) == tuple(clashing) for r in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).where("not lossless").count() == 0
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, FOLDER), f"empty-{name}")
    assert empty.count() == 0


def test_run_leaves_one_table_and_equals_the_stages(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: str(tmp_path))
    got = corpus_pipeline.run(spark, FOLDER)
    left = sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), f"again-{name}")
    want = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert left == ["stage-secrets"]
