import random

import numpy as np
import pytest
from brute import classes, counted_shingles, shingles, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import darts, dedup
from tidemark.llm.dedup import near_duplicates


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 400), st.floats(0.0, 1.0), st.integers(0, 2**31))
def test_agreement_estimates_jaccard(n, share, seed):
    rng = np.random.default_rng(seed)
    common = round(n * share)
    pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
    a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
    s = darts.sketches(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.ones(len(a) + len(b)), 2, 600)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.12


def test_weights_count():
    rng = np.random.default_rng(1)
    e = rng.integers(0, 2**63, 200).astype(np.uint64)
    w, v = rng.exponential(5, 200), rng.exponential(5, 200)
    s = darts.sketches(np.repeat([0, 1], 200), np.concatenate([e, e]), np.concatenate([w, v]), 2, 3000)
    assert abs((s[0] == s[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04


def test_sketch_does_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 2**63, 50).astype(np.uint64)
    alone = darts.sketches(np.zeros(50, int), e, np.ones(50), 1, 130)[0]
    among = darts.sketches(np.concatenate([np.zeros(9, int), np.ones(50, int)]), np.concatenate([rng.integers(0, 2**63, 9).astype(np.uint64), e[::-1]]), np.ones(59), 3, 130)
    assert (among[1] == alone).all() and not among[2].any()


def corpus(n, seed=0):
    """Texts with copies, near copies at many distances, chains, and shared passages."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 40, 120, 200]))]
            if kind > 0.8:
                w += passage
            if kind > 0.9:
                w += w[:20] * rng.choice([1, 3, 9])
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("weights", ["set", "count"])
def test_same_classes_as_all_pairs(spark, weights):
    rows = corpus(500)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weights=weights).collect()}
    want = classes(rows, counted=weights == "count")
    # a pair at exactly the threshold may lack a common band, 1 in 30,000
    assert sum(got[i] != want[i] for i in want) <= 1


def test_group_of_loose_copies(spark):
    """Copies at many distances from one text: classes by checks inside the join too."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(150)] = f"x{rng.randrange(4000)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_odd_rows(spark, odd, none):
    out = near_duplicates(odd.withColumn("class_id", F.lit("mine")).withColumn("node", F.lit(1)))
    assert out.columns == ["doc_id", "class_id"] and out.count() == odd.count()
    got = {(r.doc_id, r.class_id) for r in out.collect()}
    assert {(1, 1), (2, 1), (None, 1), (None, None), (4, 4), (5, 5), (7, 7)} <= got
    assert near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)]
    got = {r["node"]: r["class"] for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100, 150: 100}


def test_exact_sets_are_those_of_the_rule():
    texts = ["a b c d e f", "a b", "A-b c_d e F", "x " * 50, "a b c " * 30]
    for t in texts:
        line = " ".join(words(t))
        assert len(set(dedup.weighted_shingles(line, 5, False).tolist())) == len(dedup.weighted_shingles(line, 5, False)) == len(shingles(t))
        assert len(set(dedup.weighted_shingles(line, 5, True).tolist())) == max(1, len(words(t)) - 4)
    a, b = texts[-1], "a b c " * 20 + "d " * 30
    x, y = (set(dedup.weighted_shingles(" ".join(words(t)), 5, True).tolist()) for t in (a, b))
    assert len(x & y) / len(x | y) == len(counted_shingles(a) & counted_shingles(b)) / len(counted_shingles(a) | counted_shingles(b))


@pytest.mark.parametrize("large", [20, 1000])
def test_large_buckets_with_several_classes(spark, monkeypatch, large):
    """Three loose groups that share half of their words: further centres and salted pairs give the classes of all pairs."""
    monkeypatch.setattr(dedup, "LARGE", large)
    monkeypatch.setattr(dedup, "SALTED", large)
    rng, rows = random.Random(4), []
    half = [f"w{i}" for i in range(110)]
    for i in range(150):
        w = half + [f"g{i % 3}.{j}" for j in range(22)]
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(4000)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_rows_of_one_id_with_different_texts(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (2, text("b") + " more"), (3, text("a") + " more"), (3, text("c")), (None, text("b")), (None, text("d"))]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), key="text_key")
    assert out.columns == ["doc_id", "class_id", "text_key"]
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in out.collect()) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (3, 3)]


def test_ids_of_any_kind(spark):
    rows = [(f"id{i:03}", t) for i, t in corpus(60, 5)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == classes(rows)
