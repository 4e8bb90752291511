import random
import time

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.queries import op7_toxicity
from tidemark.llm.toxicity import evidence, fit, folded, hits_of, matcher, toxicity


@pytest.mark.parametrize("raw,want", [
    ("You are w0rthless tr4sh", "you are worthiess trash"), ("аn іdіоt", "an idiot"), ("t.r.a.s.h and i-d-i-o-t", "trash and idiot"), ("SCUM!! $cum d!sgusting", "scum scum disgusting"),
    ("l'été 1diot", "i ete idiot"), ("a $ b | c @ d ere$$$", "a b c d ere"), ("trash​ ｌｏｓｅｒ", "trash ioser"), (None, ""), ("", ""), ("漢字 Straße", "漢字 straße"),
])
def test_folding(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(folded(F.col("t"))).first()[0] == want


def data(spark, seed=0, n=1200):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        w = [f"w{rng.choice('bcdfghjk')}{rng.choice('aeu')}{rng.choice('mnpr')}{rng.randrange(9)}".replace("1", "x") for _ in range(rng.randrange(20, 200))]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["nasty", "vile", "n4sty", "VILE", "vilest"]))
        elif i % 5 == 2:
            w.insert(3, "nasty weather")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_entries_and_exceptions(spark):
    docs, labels = data(spark)
    model = fit(docs, labels.where("doc_id % 2 = 0"))
    assert {p[:4] for p in model.rates} <= {"nast", "viie"} and any("weather" in p for p in model.exceptions)
    out = toxicity(docs, model).join(labels, "doc_id").where("doc_id % 2 = 1")
    assert out.where("predicted <> toxic").count() == 0
    assert fit(docs, labels.where("doc_id % 2 = 0")) == model


def test_words_of_a_copied_text_leave_entries(spark):
    docs, labels = data(spark)
    words = [f"{a}{b}{c}{d}" for a in "bdfghkmprs" for b in "aeou" for c in "bdfghkmnpr" for d in "aeou"][:1500]
    for edit in (lambda i: "", lambda i: f" copy {i}"):  # as they are, and with other ends
        copies = [(10_000 + i, " ".join(w + "qq" for w in words) + edit(i)) for i in range(200)]
        more = labels.union(spark.createDataFrame([(i, 1) for i, _ in copies], labels.schema))
        found = fit(docs.union(spark.createDataFrame(copies, docs.schema)), more).rates
        assert any(p.startswith("viie") for p in found) and (edit(0) or any(p.startswith("nast") for p in found))


def test_hits_outside_phrases():
    a = matcher(["trash", "scum"], ("trash can",))
    assert hits_of("trash can trash scummy can", a) == {"trash": 1, "scum": 1} and hits_of("trashcan can", a) == {"trash": 1}
    assert evidence(hits_of("x trash", a), 2, {"trash": 1e-6}) > evidence(hits_of("x trash", a), 10_000, {"trash": 1e-6}) > 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("trash can scum scummy x trashcan can trash".split()), max_size=25))
def test_hits_by_looking_at_every_place(words):
    line = " ".join(words)
    entries, phrases = ["trash", "scum", "can "], ("trash can", "can trash", "scum x scum")
    assert hits_of(line, matcher(entries, phrases)) == brute.hits(line, entries, phrases)


def test_many_hits_and_phrases_take_one_pass():
    start = time.time()
    found = hits_of("trash can trash scum " * 100_000, matcher(["trash", "scum"], ("trash can",)))
    assert found == {"trash": 100_000, "scum": 100_000} and time.time() - start < 10


def test_scores_are_those_of_the_rule(spark):
    """The whole query against a plain restatement over every document."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(docs, labels.where((part != 0) & F.col("toxic").isNotNull()))
    lines = {r.doc_id: r.line for r in docs.select("doc_id", folded(F.col("text")).alias("line")).collect()}
    got = op7_toxicity(spark, d).collect()
    assert len(got) == len(lines) and model.rates and any(r.predicted for r in got)
    for r in got:
        score, n = brute.toxic_score(lines[r.doc_id], model)
        assert r.score == pytest.approx(score, abs=1e-9) and r.n_hits == n and r.predicted == (r.score >= 0.5)


def test_the_fit_does_not_depend_on_partitions(spark):
    docs, labels = data(spark, 3, 600)
    a = fit(docs.repartition(1), labels)
    assert fit(docs.repartition(7), labels.repartition(5)) == a and a.rates
    # a label whose id many texts share stays within the bound on rows
    many = docs.limit(1).unionByName(docs.withColumn("doc_id", F.lit(1).cast("long")))
    assert fit(many, spark.createDataFrame([(1, 1), (2, 0)], labels.schema), rows_per_class=50) is not None


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    out = op7_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    # a part of the labels is noise: junk without any insult that is marked toxic
    assert n.get((0, 1), 0) <= 2 and n[1, 1] / (n[1, 1] + n[1, 0]) > 0.85


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (5, 1), (None, 1), (3, None), (6, 7)], "doc_id long, toxic int")
    for model in (fit(odd, labels), fit(none, labels), fit(odd, labels.where("false"))):
        out = toxicity(odd.withColumn("score", F.lit("mine")).withColumn("predicted", F.lit(9)), model)
        assert out.count() == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out.collect())
        assert toxicity(none, model).count() == 0
