import random

from brute import base_counts
from pyspark.sql import functions as F

from tidemark.llm import quality as q
from tidemark.llm.quality import Limits, js_distance, quality


def test_base_counts_as_by_hand(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice(["a ", "b ", "cc ", "\n", "\t", "#", "é", " | ", "a b c ", "\x00", " ", "\U0001f600"]) for _ in range(rng.randrange(200))) for _ in range(300)] + [None, "", "\n\n", "one", "a b c a b c", "x " * 5000]
    df = q.base_counts(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    for r in df.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(r.text), r.text


def test_many_repeated_windows_take_the_other_way(spark):
    text = " ".join(f"w{i}" for i in range(100)) + " " + " ".join(f"w{i}" for i in range(100)) + " end of it"
    (r,) = q.base_counts(spark.createDataFrame([(text,)], "text string")).collect()
    assert r.n_repeat_words == base_counts(text)[-1] == 200


def test_distance(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 0.0), ([1.0, 0.0], [0.0, 1.0], 1.0), ([0.5, 0.5], [1.0, 0.0], 0.557923)]
    got = spark.createDataFrame(rows, "p array<double>, q array<double>, want double").select(js_distance(F.col("p"), F.col("q")).alias("d"), "want").collect()
    assert all(abs(r.d - r.want) < 1e-5 for r in got)


def test_labelled_prose_stays_and_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    out = quality(spark.read.parquet(f"{d}/documents.parquet"), keep=["doc_id"]).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed")
    good, junk = (out.where(f"quality = {x}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for x in (1, 0))
    assert good == 1.0 and junk < 0.4


def test_odd_rows(spark, odd, none):
    clash = odd.withColumn("kept", F.lit("mine")).withColumn("class_counts", F.lit(1)).withColumn("_lang0", F.lit(2)).withColumn("_t0", F.lit(3))
    out = quality(clash)
    assert out.count() == odd.count() and "_lang0" in out.columns and "_t0" in out.columns and dict(out.dtypes)["kept"] == "boolean"
    got = {r.doc_id: r for r in out.collect()}
    assert not got[4].kept and not got[5].kept and got[5].n_words == 0 and got[6].n_words == 180_000 and got[10].base_failed
    assert quality(none).count() == 0


def test_unknown_language_takes_the_nearest(spark):
    prose = lambda w: " ".join(random.Random(1).choices(w.split(), k=300))
    en, de = prose("the of and to in house tree river stone walked and the of"), prose("der die und in Haus Baum Fluss Stein ging und der die")
    df = spark.createDataFrame([(1, en, "en"), (2, de, "de"), (3, en, None), (4, de, "xx")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality(df, Limits(max_repeat_percent=100)).collect()}
    assert got[3].common_distance == got[1].common_distance < 0.01 and got[4].class_distance == got[2].class_distance


def test_guards(spark):
    df = spark.createDataFrame([(1, "plain words here# " * 40, "en"), (2, "plain words here# " * 80, "en"), (3, "all plain words " * 300, "en"), (4, "all plain words " * 300, "en"), (5, "all plain words " * 300, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality(df, Limits(max_repeat_percent=100, max_common_distance=1.0)).collect()}
    assert got[1].class_distance == got[2].class_distance and 0.1 < got[1].class_distance < 0.28
    tight = {r.doc_id: r.kept for r in quality(df, Limits(max_repeat_percent=100, max_common_distance=1.0, max_class_distance=0.1, class_guard_words=150)).collect()}
    assert tight[1] and not tight[2] and got[1].common_distance is None and got[2].common_distance is not None
