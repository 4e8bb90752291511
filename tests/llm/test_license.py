import math
import random

from brute import words
from pyspark.sql import functions as F

from tidemark.llm.license import TEMPLATES, containment_join, licenses, need, words_of
from tidemark.llm.queries import SQL, op10_license_scan

TEXTS = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "Released under the MIT License. cc by cc by", "released the MIT", "under mit license released the", "", None]


def test_phrases_and_templates(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses(df).collect()}
    assert got[0].base_labels == "cc-by" and "cc-by-nc" in got[0].labels.split(",")
    assert (got[1].base_labels, got[1].first_word) == ("gpl", 7) and got[1].score == 1.0
    assert (got[2].labels, got[2].n_base, got[2].n_words) == ("reserved", 1, 3)
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].labels) == (2, 5, 7, "cc-by,mit")
    assert got[4].labels == "" and got[5].labels == "mit"  # a set of words, in any order
    assert (got[6].n_words, got[6].first_word, got[6].labels, got[6].score) == (0, None, "", 0.0) == (got[7].n_words, got[7].first_word, got[7].labels, got[7].score)


def test_join_finds_every_pair(spark):
    """Against all pairs of blocks and templates, with random templates and thresholds."""
    rng = random.Random(0)
    vocabulary = [f"w{i}" for i in range(40)]
    templates = {f"t{i}": [" ".join(rng.sample(vocabulary, rng.randrange(1, 9)))] for i in range(25)}
    rows = [(i, "\n".join(" ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))) for _ in range(rng.randrange(5)))) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, text string")
    for threshold in (0.5, 0.8, 1.0):
        got = {(r.k, r.block, r.label) for r in containment_join(df, ["k"], templates, threshold).collect()}
        want = set()
        for k, text in rows:
            for b, line in enumerate(text.split("\n")):
                for label, (t,) in templates.items():
                    u = set(words_of(t))
                    if len(u & set(words(line))) >= need(len(u), threshold):
                        want.add((k, b, label))
        assert got == want


def test_blocks_of_several_lines(spark):
    text = "Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses(df).first().labels == "" and licenses(df, lines_per_block=3).first().labels == "mit"


def test_wrapped_notices_in_the_query(spark, tmp_path):
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    rows, want = [], {}
    for label, texts in TEMPLATES.items():
        for t in texts:
            for n in (2, 3, 7):
                want[len(rows)] = label
                rows.append((len(rows), "def f(x):\n# " + wrap(t, n).replace("\n", "\n# ") + "\nreturn x and y"))
    far = " and ".join(["other text here"] * 40)
    rows.append((len(rows), f"released under\n{far}\nthe mit\n{far} license"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op10_license_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[len(rows) - 1].labels == ""
    assert all(label in got[i].labels.split(",") and got[i].score == 1.0 for i, label in want.items())


def test_the_sql_is_the_querys_rule(spark, tmp_path):
    """Notices wrapped over lines, thinned out, mixed with others and cut, in the query and in its SQL."""
    import duckdb
    from compare import rows

    rng, out = random.Random(4), []
    texts = [t for ts in TEMPLATES.values() for t in ts]
    filler = "the of license to this work is under a free charge any software copy words here nothing".split()
    for i in range(400):
        words_ = []
        for _ in range(rng.randrange(4)):
            t = rng.choice(texts).split(" ")
            words_ += [w for w in t if rng.random() > rng.choice([0, 0, 0.05, 0.2])] if rng.random() < 0.7 else t[rng.randrange(3) :]
            words_ += rng.choices(filler, k=rng.randrange(5))
        out.append((i, "".join(w + rng.choice([" ", " ", " ", "\n", ", ", "\n * "]) for w in words_)))
    out += [(400, None), (401, ""), (402, TEMPLATES["mit"][1].replace(" ", "\n")), (None, TEMPLATES["bsd"][0])]
    spark.createDataFrame(out, "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    ours, theirs = rows(op10_license_scan(spark, str(tmp_path)).toPandas()), rows(con.execute(SQL["op10_license_scan"]).df())
    assert ours == theirs and sum("mit" in r[ours[0].index("labels")] for r in ours[1]) > 20


def test_windows_find_every_run(spark):
    """Against all runs of words, with random templates and thresholds; lines find what they found."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    templates = {f"t{i}": [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))] for i in range(25)}
    rows = [(i, "\n".join(" ".join(rng.choices(vocabulary, k=rng.randrange(0, 30))) for _ in range(rng.randrange(5)))) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, text string")
    for threshold in (0.5, 0.8, 1.0):
        found = containment_join(df, ["k"], templates, threshold, windows=True)
        got, want = {}, {}
        for r in found.where("block is null").collect():
            got[r.k, r.label] = max(r.containment, got.get((r.k, r.label), 0))
        for k, text in rows:
            for label, (t,) in templates.items():
                u, ws, n = set(words_of(t)), words(text), math.ceil(len(t.split()) / threshold)
                most = max((len(u & set(ws[i : i + n])) for i in range(len(ws))), default=0)
                if most >= need(len(u), threshold):
                    want[k, label] = most / len(u)
        assert got == want
        lines = lambda d: {(r.k, r.block, r.label) for r in d.where("block is not null").collect()}
        assert lines(found) == lines(containment_join(df, ["k"], templates, threshold))


def test_odd_rows(spark, odd, none):
    out = licenses(odd.withColumn("labels", F.lit("mine")).withColumn("_text", F.lit(1)))
    assert out.count() == odd.count() and "_text" in out.columns and {r.labels for r in out.collect()} == {""}
    assert licenses(none).count() == 0


def test_templates_of_a_bounded_size(spark, none):
    import pytest

    with pytest.raises(ValueError):
        containment_join(none, ["doc_id"], {"x": [" ".join(f"w{i}" for i in range(30_000))]}, 0.8)
    assert all(TEMPLATES.values())


def test_no_phrases_or_templates(spark):
    df = spark.createDataFrame([(1, "cc by; Released under the MIT License"), (2, None)], "doc_id long, text string")
    for phrases, templates, want in ({}, {}, ("", "")), ({}, {"mit": ["Released under the MIT License", "", "..."]}, ("", "mit")), ({"cc by": "cc-by"}, {}, ("cc-by", "cc-by")), ({}, {"x": []}, ("", "")):
        for windows in (False, True):
            rows = {r.doc_id: r for r in licenses(df, phrases, templates, windows=windows).collect()}
            assert (rows[1].base_labels, rows[1].labels) == want and (rows[2].labels, rows[2].n_base) == ("", 0)
