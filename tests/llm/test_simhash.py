import random

import numpy as np
import pytest
from brute import near_components, simhash
from pyspark.sql import functions as F

from tidemark.llm import simhash as sh
from tidemark.llm.simhash import simhash_duplicates


def test_anchors_are_the_golay_code():
    """Each block of 23 bits has one word within three places, those a place further are all told, and words differ in seven places."""
    rng = np.random.default_rng(0)
    block = rng.integers(0, 1 << 23, 2000)
    words = np.flatnonzero(sh.errors()[0] == 0)
    assert len(words) == 4096 and min(int(w).bit_count() for w in words[1:]) == 7
    row, anchor, beyond = sh.anchors(block, 1)
    for i in range(0, 2000, 50):
        far = np.bitwise_count((words ^ block[i]).astype(np.uint64))
        assert (far <= 3).sum() == 1
        assert sorted(anchor[row == i].tolist()) == words[far <= 4].tolist()
        assert sorted(beyond[row == i].tolist()) == np.maximum(np.sort(far[far <= 4]).astype(int) - 3, 0).tolist()


@pytest.mark.parametrize("fine", [False, True])
def test_all_that_differ_in_four_bits_meet(fine):
    rng = np.random.default_rng(1)
    one = rng.integers(0, 2**63, 3000).astype(np.uint64)
    two = one.copy()
    for i in range(3000):
        for k in rng.choice(64, rng.integers(0, 5), replace=False):
            two[i] ^= np.uint64(1) << np.uint64(k)
    row, key, home = sh.visits(one.view(np.int64), fine)
    other, at, _ = sh.visits(two.view(np.int64), fine)
    met = set(zip(row[home].tolist(), key[home].tolist())) & set(zip(other.tolist(), at.tolist()))
    assert {i for i, _ in met} == set(range(3000))


@pytest.mark.parametrize(("fine", "salted"), [(False, 4096), (True, 4096), (False, 7)])
def test_components_of_all_pairs(spark, monkeypatch, fine, salted):
    """Fingerprints in loose groups, with chains, some far beyond an anchor's bound."""
    monkeypatch.setattr(sh, "SALTED", salted)
    rng, prints = random.Random(2), {0}
    while len(prints) < 900:
        base = rng.choice(sorted(prints)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 4, 5, 9])):
            base ^= 1 << (rng.randrange(12) if rng.random() < 0.7 else rng.randrange(64))
        prints.add(base)
    prints = sorted(prints)
    signed = [p - (p >> 63 << 64) for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(5)
    root = near_components(prints)
    label = {n: c for n, c in sh.components(sh.links(nodes, fine)).collect()}
    got = [label.get(p, p) for p in signed]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, set()).add(got[i])
    assert all(len(x) == 1 for x in groups.values()) and len({min(x) for x in groups.values()}) == len(groups)


def texts(n):
    rng, rows = random.Random(5), []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"W{rng.randrange(99)}"
        else:
            w = [f"w{rng.randrange(999)}" for _ in range(rng.choice([0, 1, 3, 4, 60, 400]))]
        rows.append((i, rng.choice([" ", " ", "\t \n"]).join(w)))
    return rows


def test_same_as_by_hand(spark):
    rows = texts(250)
    prints = [simhash(t) for _, t in rows]
    root = near_components(prints)
    got = {r.doc_id: r for r in simhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert [got[i].fingerprint for i in range(250)] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(250)] == root and len(set(root)) < 200


def test_fingerprint_is_that_of_spark(spark):
    """XXH64 with seed 42, over the shingles' bytes, in Spark's own functions."""
    text = "Tide marks ARE marks that the tide leaves, é 漢"
    h = "transform(sequence(1, size(w) - 3), i -> xxhash64(array_join(slice(w, i, 4), ' ')))"
    df = spark.range(1).select(F.split(F.lower(F.lit(text)), " ").alias("w")).select(F.expr(h).alias("h"))
    n = df.select(*[F.expr(f"int(2 * size(filter(h, x -> getbit(x, {k}) = 1)) > size(h))").alias(f"b{k}") for k in range(64)]).first()
    (got,) = simhash_duplicates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert int(got.fingerprint, 16) == sum(b << k for k, b in enumerate(n))


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    root = near_components([simhash(t) for _, t in rows])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f"{simhash(t):016x}", least[r]) for (i, t), r in zip(rows, root)), key=str)
    clash = odd.withColumnsRenamed({"lang": "fp", "source": "component_id"})
    for df in (odd, clash):
        assert sorted((tuple(r) for r in simhash_duplicates(df).collect()), key=str) == want
    assert simhash_duplicates(none).collect() == []
    nobody = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert {r.component_id for r in simhash_duplicates(nobody).collect()} == {None}
    with pytest.raises(ValueError):
        simhash_duplicates(odd, distance=5)
