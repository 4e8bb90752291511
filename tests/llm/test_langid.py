import itertools
import math
import random
import re
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.langid import LanguageModel, Lattice, arcs_of, fit, identify
from tidemark.llm.queries import op3_language_id

SF = "/root/testdata/sf0.01"


def by_hand(word, pieces, p, unknown):
    """The sum over all ways to cut a word, one by one."""
    total, text = 0.0, "▁" + word
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        x = 1.0
        for a, b in zip(at, at[1:]):
            s = text[a:b]
            x *= p[pieces.index(s)] if s in pieces else unknown if b - a == 1 else 0.0
        total += x
    return total


def test_forward_sums_all_segmentations():
    pieces = ("▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab")
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces)))
    column = np.append(p, 1e-3)[:, None]
    for word in ("a", "abab", "xab", "bbx", "ababab"):
        got = np.exp(Lattice([word], arcs_of(pieces)).log_p(column))[0, 0]
        assert got == pytest.approx(by_hand(word, pieces, p, 1e-3))


def slow_log_p(word, pieces, p, unknown):
    """The forward sums of one word with exact fractions."""
    text = "▁" + word
    alpha = [Fraction(1)] + [Fraction(0)] * len(text)
    for e in range(1, len(text) + 1):
        for k, x in zip(pieces, p):
            if text[:e].endswith(k):
                alpha[e] += alpha[e - len(k)] * Fraction(float(x))
        if text[e - 1] not in pieces:
            alpha[e] += alpha[e - 1] * Fraction(unknown)
    return log_of(alpha[-1])


def log_of(x):
    return math.log2(x.numerator >> max(0, x.numerator.bit_length() - 60)) * math.log(2) + math.log(2) * (max(0, x.numerator.bit_length() - 60) - max(0, x.denominator.bit_length() - 60)) - math.log(x.denominator >> max(0, x.denominator.bit_length() - 60))


def test_words_of_any_length():
    pieces = ("▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab")
    p = np.random.default_rng(0).dirichlet(np.ones(len(pieces)))
    column = np.append(p, 1e-3)[:, None]
    for word in ("ab" * 30, "a" * 39, "a" * 40, "a" * 41, "abx" * 100, "b" * 700):
        assert Lattice([word], arcs_of(pieces)).log_p(column)[0, 0] == pytest.approx(slow_log_p(word, pieces, p, 1e-3), rel=1e-9)
    start = time.time()
    assert np.isfinite(Lattice(["ab" * 50_000], arcs_of(pieces)).log_p(np.hstack([column] * 3))).all() and time.time() - start < 60


def test_expected_counts_of_long_words():
    pieces = ("▁", "a", "b", "ab", "▁a", "ba", "aba")
    column = np.append(np.random.default_rng(1).dirichlet(np.ones(len(pieces))), 1e-3)[:, None]
    words, counts = ["abx", "ab" * 12, "bab"], np.array([2.0, 1.0, 3.0])
    lattice = Lattice(words, arcs_of(pieces))
    want = lattice.expected(column, counts)
    lattice.long = True
    assert lattice.expected(column, counts) == pytest.approx(want)


def test_the_whole_prediction_by_hand(spark):
    """identify() over texts, word by word and language by language."""
    pieces = ("▁", "a", "b", "c", "ab", "ca", "▁b")
    p = np.random.default_rng(2).dirichlet(np.ones(len(pieces)), 3).T
    model = LanguageModel(("x", "y", "z"), pieces, np.vstack([p, np.full(3, 1e-7)]))
    texts = ["ab ca", "B, b! ccc", "abd", "a" * 90 + " b", "7 ?", "", None, "ca"]
    rows = identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string"), model).collect()
    for r in rows:
        w = re.findall("[a-z]+", (r.text or "").lower())
        if not w:
            assert (r.lang_pred, r.score, r.log_p_char) == ("und", 0.0, None)
            continue
        logs = [sum(slow_log_p(x, pieces, p[:, j], 1e-7) for x in w) for j in range(3)]
        best = max(range(3), key=lambda j: logs[j])
        assert r.lang_pred == model.langs[best] and r.score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs)) and r.log_p_char == pytest.approx(logs[best] / len(" ".join(w)))


def test_texts_of_no_known_language_do_not_fit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("doc_id", "text", "lang")
    rng = random.Random(0)
    junk = [(-1 - i, " ".join("".join(rng.choice("qwxzkjvyp") for _ in range(7)) for _ in range(80)), None) for i in range(40)]
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa " * 3
    all_docs = docs.where(F.length("text") > 300).unionByName(spark.createDataFrame([*junk, (-100, polish, None)], docs.schema))
    out = identify(all_docs, fit(all_docs))
    kept = langid.in_language(out)
    assert kept.columns == out.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = {r.doc_id for r in all_docs.where("doc_id >= 0").select("doc_id").collect()}
    assert not {i for i in ids if i < 0} and ids >= clean


def test_words_in_one_lattice_do_not_mix():
    pieces = ("▁", "a", "b", "ab")
    arcs, p = arcs_of(pieces), np.array([[0.4], [0.3], [0.2], [0.1], [1e-3]])
    words = ["ab", "b", "aab", "ab" * 50]
    together = Lattice(words, arcs).log_p(p)[:, 0]
    assert together == pytest.approx([Lattice([w], arcs).log_p(p)[0, 0] for w in words])


def test_held_out_accuracy(spark):
    out = op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = out.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 250 and right / n > 0.98


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    a, b = fit(docs.where(part != 1)), fit(docs.withColumn("lang", F.when(part == 1, "xx").otherwise(F.col("lang"))).where(part != 1))
    assert a.key() == b.key()


def test_odd_rows(spark, odd, none):
    model = fit(odd)
    assert set(model.langs) == {"de", "en", "fr"}
    clash = odd.withColumn("lang_pred", F.lit("mine")).withColumn("score", F.lit(7))
    out = identify(clash, model)
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == odd.count() and got[4, ""].lang_pred == "und" and got[5, None].lang_pred == "und" and got[5, None].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1, next(t for i, t in got if i == 1)].lang_pred == "en"
    empty = fit(none)
    assert empty.langs == () and {r.lang_pred for r in identify(odd, empty).collect()} == {"und"}
    assert identify(none, model).count() == 0


def test_word_store_is_bounded(monkeypatch):
    monkeypatch.setattr(langid, "KEPT_WORDS", 3)
    s = langid.Scorer(LanguageModel(("x",), ("▁", "a"), np.array([[0.5], [0.5], [1e-7]])))
    a = s.words(["a", "aa"])
    s.words(["aaa", "aaaa"])
    assert len(s.place) <= 3 and (s.words(["a", "aa"]) == a).all()


def test_texts_without_a_letter_are_of_no_language(spark):
    """Combining marks alone, or after digits, are no letters."""
    rows = [(i, t) for i, t in enumerate(["\u0301", "1\u0301 2\u0308", "\u0301 \u0301\u0301", "123 !?", "", None, "x\u0301"])]
    learned = spark.createDataFrame([("the words of a text", "en"), ("les mots du texte", "fr")] * 20, "text string, lang string")
    got = {r.i: (r.lang_pred == "und", r.score) for r in identify(spark.createDataFrame(rows, "i int, text string"), fit(learned)).collect()}
    assert all(got[i] == (True, 0.0) for i in range(6)) and not got[6][0]
