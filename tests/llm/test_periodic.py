import random
import re

import numpy as np
import pytest
from brute import periodic_runs as by_hand
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodic
from tidemark.llm.periodic import periodic_runs

parts = st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=9), st.integers(1, 9)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(parts, max_size=4), st.sampled_from([0, 1, 12]), st.sampled_from([(6, 4), (2, 2), (10, 3)]))
def test_every_run_of_every_text(texts, top, rule):
    words = [[w for part, times in text for w in part * times] for text in texts]
    first = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    runs = periodic.runs_of(np.array([ord(x) for w in words for x in w], np.int32), first, *rule, top)
    for i, w in enumerate(words):
        assert [tuple(r[1:]) for r in runs[runs[:, 0] == i].tolist()] == by_hand(w, *rule)


def test_names_stand_for_equal_words():
    code = np.array([1, 2, 1, 2, 1, 2, 3, 1, 2], np.int32)
    names = periodic.levels(code, np.zeros(9, np.int64))
    for k, level in enumerate(names):
        for i in range(9):
            for j in range(i):
                same = i + 2**k <= 9 and list(code[i : i + 2**k]) == list(code[j : j + 2**k])
                assert (level[i] == level[j]) == same


def test_texts(spark):
    rng, rows = random.Random(3), []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(4)):
            some = [rng.choice(["a", "é", "漢字", "\U0001f600", "x y", "<b>"]) for _ in range(rng.randrange(1, 7))]
            words += some * rng.choice([1, 3, 4, 6])
        rows.append((i, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "\r\n", "  ", "\x0b"]).join(words)))
    texts, some = dict(rows), 0
    for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        words = re.findall("[^\x20\x09-\x0d]+", texts[r.doc_id])
        runs = by_hand(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), runs)
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        some += bool(runs)
    assert some > 100


def test_long_texts_take_time_in_proportion(spark):
    """A word 400,000 times over, and a passage of a thousand words 300 times, are one run each."""
    rows = [(1, "so " * 400_000), (2, " ".join(f"w{i % 1000}" for i in range(300_000)))]
    got = {r.doc_id: r for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 400_000, 1)] and got[1].collapsed == "so"
    assert [tuple(x) for x in got[2].runs] == [(0, 300_000, 1000)] and len(got[2].collapsed.split(" ")) == 1000


def test_odd_rows(spark, odd, none):
    out = periodic_runs(odd).collect()
    assert len(out) == odd.count()
    for r in out:
        words = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        assert r.n_words == len(words) and r.collapsed is not None
        if len(words) < 1000:
            assert [tuple(x) for x in r.runs] == by_hand(words)
    assert periodic_runs(none).collect() == []
    clash = odd.selectExpr("doc_id as runs", "text", "1 as n_words", "2 as _found0")
    got = periodic_runs(clash)
    assert got.columns == ["text", "_found0", "n_words", "runs", "collapsed"] and sorted(r.n_words for r in got.collect()) == sorted(r.n_words for r in out)
    with pytest.raises(ValueError):
        periodic_runs(odd, periods=1)
