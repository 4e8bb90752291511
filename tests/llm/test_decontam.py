import random

from brute import contamination
from pyspark.sql import functions as F

from tidemark.llm.decontam import contaminated

ITEMS = [(1, "What is the capital of the large country that lies to the north of here, please?"), (2, "two words"), (3, ""), (4, None), (None, "an item that has no id of its own at all in this table"), (10, "two words"), (5, "Ünïcode wörds ARE words")]


def corpus(seed=0):
    rng, rows = random.Random(seed), []
    vocabulary = "the a of what is capital large country that lies to north two words Two WORDS item ünïcode wörds ARE Ünïcode".split()
    for i in range(300):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(ITEMS)[1] or ""
            a = rng.randrange(len(t) + 1)
            parts.insert(rng.randrange(len(parts) + 1), t[a // 3 :] if rng.random() < 0.5 else t)
        rows.append((i, rng.choice([" ", ", ", "\n", " -- "]).join(parts)))
    return rows


def test_same_as_by_hand(spark):
    bench, rows = spark.createDataFrame(ITEMS, "item_id long, text string"), corpus()
    items = [("null" if i is None else i, t) for i, t in ITEMS]
    for max_words in (10**6, 20):  # by the automaton, and by a join of windows
        for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, max_words=max_words).collect():
            n, hit, found = contamination(r.text, items)
            assert (r.n_words, r.n_hit, r.items) == (n, hit, found)


def test_spans_are_places_in_the_original(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    text = "\U0001f600 Before: TWO -- words, after. ÜNÏCODE wörds two words"
    (r,) = contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).collect()
    assert [text[s.start : s.end] for s in r.spans] == ["TWO -- words", "two words"] and r.items == ["10", "2"]


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = contaminated(odd.withColumn("n_hit", F.lit("mine")).withColumn("items", F.lit(1)), bench)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and got[5].n_words == 0 and got[6].n_words == 180_000 and {r.n_hit for r in got.values()} == {0}
    assert contaminated(none, bench).count() == 0
    assert {r.n_hit for r in contaminated(odd, bench.where("false")).collect()} == {0}


def test_a_large_benchmark_is_one_join(spark, odd, none):
    """Beyond its bound the benchmark is neither in the plan nor scanned in parts; the results are those of the automaton."""
    bench = spark.createDataFrame([*ITEMS, *[(100 + i, f"item number {i} of a large benchmark that {i % 7} documents may quote in full or in part") for i in range(400)]], "item_id long, text string")
    docs = spark.createDataFrame([(i, t) for i, t in corpus(1)] + [(1000, "see: item number 7 of a large benchmark that 0 documents may quote"), (1000, "see: item number 7 of a large benchmark that 0 documents may quote")], "doc_id long, text string")
    joined, scanned = (contaminated(docs, bench, max_words=n) for n in (100, 10**6))
    assert sorted(joined.collect()) == sorted(scanned.collect())
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    out = contaminated(odd.withColumn("items", F.lit(1)), bench, max_words=10)
    assert out.count() == odd.count() and {r.n_hit for r in out.collect()} == {0} and contaminated(none, bench, max_words=10).count() == 0
