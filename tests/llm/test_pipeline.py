import inspect

import pytest
import sentencepiece
from brute import base_counts, classes, contamination

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm.pieces import DEFAULT_MODEL
from tidemark.llm.quality import quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "language identification", "near-duplicates", "decontamination", "sentencepiece"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in cp.STAGES)


def test_same_as_by_hand(spark, docs):
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    kept = {r.doc_id for r in quality(docs, keep=["doc_id"]).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    least = classes(rows)  # all of them have a language
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i: t for i, t in rows if least[i] == i and not contamination(t, items)[1]}
    assert set(got) == set(want)
    sp = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    assert all(got[i].ids == sp.encode(t) and got[i].n_ids == len(got[i].ids) for i, t in want.items())


def test_all_but_the_last_return_the_columns_of_documents(spark, docs):
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.limit(40), SF).columns == docs.columns, name


def test_odd_rows(spark, odd, none):
    for name, stage in cp.STAGES:
        out = stage(spark, odd, SF)
        assert out.count() <= odd.count(), name
        assert stage(spark, none, SF).count() == 0, name
    rows = lambda df: sorted(map(str, df.collect()))
    # what each stage leaves: texts of fifty words or more that don't repeat, texts with letters, and, where nothing is contaminated, all
    enough = [r for r in odd.collect() if base_counts(r.text)[0] >= 50 and 2 * base_counts(r.text)[4] <= base_counts(r.text)[0]]
    assert {str(r) for r in cp.quality_stage(spark, odd, SF).collect()} <= set(map(str, enough))
    assert all(any(c.isalpha() for c in r.text or "") for r in cp.language_stage(spark, odd, SF).collect())
    assert rows(cp.decontamination_stage(spark, odd, SF)) == rows(odd)
    sp = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    got = sorted(str((r.doc_id, r.lang, r.source, r.ids)) for r in cp.encoding_stage(spark, odd, SF).collect())
    assert got == sorted(str((r.doc_id, r.lang, r.source, sp.encode(r.text or ""))) for r in odd.collect())
    ids = {r.doc_id for r in cp.dedup_stage(spark, odd, SF).collect()}
    assert 1 in ids and 2 not in ids and {4, 5, 6, 7} <= ids


def test_dedup_stage_leaves_one_row_of_a_class(spark, docs):
    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(1, text("a"), "en", "s", 1), (1, text("a"), "en", "s", 1), (1, text("a"), "de", "s", 1), (2, text("a"), "en", "s", 1), (2, text("b"), "en", "s", 1), (5, "", "en", "s", 0), (5, None, None, None, None), (None, text("a"), "en", "s", 1)]
    out = cp.dedup_stage(spark, spark.createDataFrame(rows, docs.schema).withColumn("text_key", F.lit(1)), SF)
    got = sorted(((r.doc_id or 0), (r.text or "")[:1], r.lang or "") for r in out.collect())
    assert got == [(0, "a", "en"), (1, "a", "de"), (2, "b", "en"), (5, "", ""), (5, "", "en")]


def test_columns_of_clashing_names(spark, docs):
    odd = docs.limit(60)
    for c in ("score", "lang_pred", "kept", "n_words", "class_id", "ids", "text_key", "bare", "items"):
        odd = odd.withColumn(c, F.lit("mine"))
    for name, stage in cp.STAGES:
        own, plain = stage(spark, odd, SF), stage(spark, docs.limit(60), SF)
        assert own.columns == plain.columns and sorted(map(str, own.collect())) == sorted(map(str, plain.collect())), name
