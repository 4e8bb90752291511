"""Ranks and medians by counting are those of windows and of Spark's own median, and no task gets a group."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_operators import FIRM, firm

import __spark_entry__ as entry
from tidemark.operators import cohort, methodology, ranks

SF = "/root/testdata/sf0.001"


def step(v):
    """The step in Python's doubles, as the Column says it."""
    scaled = v * (2.0 ** (53 - ranks.STEP_BITS) + 1)
    return scaled - (scaled - v) if abs(v) < 1e290 else v


@settings(max_examples=2000, deadline=None)
@given(st.floats(allow_nan=False), st.floats(allow_nan=False), st.integers(0, 40))
def test_steps_never_fall(a, b, near):
    for x, y in ((a, b), (a, a * (1 + near * 2.0**-52)), (a, math.nextafter(a, math.inf))):
        x, y = min(x, y), max(x, y)
        assert step(x) <= step(y)
        assert x == 0 or math.isinf(x) or abs(x) < 1e-290 or abs(step(x) - x) <= abs(x) * 2.0**-10


def test_steps_are_those_of_spark(spark):
    rng = random.Random(0)
    values = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-300, 300) for _ in range(500)] + [0.0, 1e300, float("inf")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks.step(F.col("v")).alias("s")).collect()
    assert all(r.s == step(r.v) for r in got)


def rows_of(n):
    rng = random.Random(1)
    kinds = [lambda: None, lambda: 0.0, lambda: -5.0, lambda: 7.0, lambda: rng.random() * 10 ** rng.randrange(12), lambda: -rng.random(), lambda: 1e9 + rng.randrange(50) / 1000, lambda: float("inf")]
    return [(i, rng.choice(["a", "a", "a", "b", None, f"g{i % 40}"]), rng.choice("xy"), rng.choice(kinds)(), float(rng.randrange(5))) for i in range(n)] + [(n, "lone", "x", 3.0, 1.0), (n + 1, "none", "x", None, 1.0)]


KIND = "i int, g string, h string, v double, w double"


def test_ranks_are_those_of_windows(spark):
    df = spark.createDataFrame(rows_of(3000), KIND).repartition(7)
    asked = {"one": ("v", ["g"]), "two": ("v", []), "three": ("w", ["g", "h"]), "four": ("v", ["h"])}
    out = ranks.ranked(df, asked)
    out = out.select("i", *[x for n in asked for x in (ranks.at_or_below(n).alias(f"c_{n}"), ranks.below(n).alias(f"p_{n}"), ranks.mid_rank(n).alias(f"m_{n}"))])
    got = {r.i: r for r in out.collect()}
    assert len(got) == 3002
    for n, (v, keys) in asked.items():
        own = Window.partitionBy(*keys, F.col(v).isNull())
        w = own.orderBy(v)
        mid = F.bround((F.rank().over(w) - 1 + F.count("*").over(Window.partitionBy(*keys, v)) / 2) / F.count("*").over(own) * 100).cast("long")
        want = df.select("i", *[F.when(F.col(v).isNotNull(), x).alias(a) for x, a in ((F.cume_dist().over(w), "c"), (F.percent_rank().over(w), "p"), (mid, "m"))])
        for r in want.collect():
            assert (got[r.i][f"c_{n}"], got[r.i][f"p_{n}"], got[r.i][f"m_{n}"]) == (r.c, r.p, r.m)
    assert ranks.ranked(df.where("false"), asked).collect() == []


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
def test_medians_are_those_of_spark(spark, keys):
    df = spark.createDataFrame(rows_of(2001), KIND).repartition(5)
    got = ranks.with_median(df, keys, F.col("v"), {"n": F.lit(1), "w": F.col("w"), "some": ranks.one_if(F.col("v") > 0)})
    want = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.count_if(F.col("v") > 0).alias("some"), F.median("v").alias("median"))
    key = lambda r: str(r[: len(keys)])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key) and got.columns == want.columns


def test_one_group_of_many_rows_is_no_task(spark):
    """Of ten million rows in one group the largest task that orders values has a thousandth; the median is right."""
    n = 10_000_000
    df = spark.range(n).select(F.lit("a").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(n)) + 1).cast("double").alias("v"))
    out = ranks.with_median(df, ["g"], F.col("v"), {"n": F.lit(1)})
    assert [tuple(r) for r in out.collect()] == [("a", n, (n + 1) / 2)]
    sizes = df.groupBy(ranks.step(F.col("v"))).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= n / 1000 and sizes[1] > 2000


def windows(out):
    """The partition keys of every window of a plan, and what is right below it."""
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [re.split(r"#\d+L?(?:, )?", re.search(r"\], \[(.*?)\](?:, \[|$)", x)[1])[:-1] if re.search(r"\], \[(.*?)\](?:, \[|$)", x) else [] for x in plan.split("\n") if re.search(r"- Window|\* Window|Window \[", x)]


def checked(out):
    """Windows over values are dealt out by steps; all others are over sums."""
    for keys in windows(out):
        assert any("_c" in k for k in keys) or keys == ["_i", "_g"] or all(k.startswith("_key") for k in keys) or set(keys) <= {"aum_band", "client_mix", "band", "mix", "region", "segment"}, keys
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "cume_dist" not in text and "percent_rank" not in text and " rank(" not in text


def test_ranking_plans_have_no_window_over_a_group(spark):
    df = spark.createDataFrame([firm(i, 1e8 * i) for i in range(1, 30)], FIRM)
    for m in methodology.METHODS.values():
        checked(methodology.top_firms(df, m, None))
        checked(methodology.outlier_firms(df, m, None))
    for name in ("w05_w06_shares", "w07_mid_ranks", "w09_cohort_rank", "w10_peer_fallback", "w11_compare_strip", "r01_top_list", "r02_outliers"):
        checked(entry.queries()[name](spark, SF))


def test_levels_count_all_members(spark):
    """Members with a null value count for a level's size, and null keys are no level."""
    rows = [(i, "a", "x" if i < 3 else None, float(i) if i % 2 else None) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, g string, h string, v double")
    got = {r.i: (r.l, r.s) for r in cohort.in_cohort(df, {"s": "v"}, [["g"], ["g", "h"]], [6, 3], lower=True, level="l").collect()}
    assert got == {0: (2, None), 1: (2, 0.0), 2: (2, None), 3: (1, 0.5), 4: (1, None), 5: (1, 1.0)}
    assert {r.s for r in cohort.in_cohort(df, {"s": "v"}, [["g"]], 7, whole=False).collect()} == {None}


def test_ties_are_looked_up_by_many_tasks(spark, monkeypatch):
    """Rows of one value, or of one cohort, that are most of a table don't meet in one task where their counts aren't broadcast, and their ranks stay those of windows."""
    monkeypatch.setattr(ranks, "TIES", 100, raising=False)
    n, own = 4500, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        df = spark.range(n).select("id", F.when(F.col("id") % 9 == 0, F.col("id") % 5).otherwise(0).cast("double").alias("v"), F.when(F.col("id") % 10 > 0, "a").alias("g")).where("id > 0")
        w = Window.partitionBy("g").orderBy("v")
        want = {r.id: (r.p, r.c) for r in df.select("id", F.percent_rank().over(w).alias("p"), F.cume_dist().over(w).alias("c")).collect()}
        out = ranks.ranked(df, {"r": ("v", ["g"])}).select("id", ranks.below("r").alias("s"), F.spark_partition_id().alias("part")).collect()
        assert {r.id: r.s for r in out} == {i: p for i, (p, _) in want.items()} and len(out) == n - 1
        levels = cohort.with_level(df, [["g"]], 10).select("id", "level", F.spark_partition_id().alias("part")).collect()
        assert {(r.id % 10 > 0, r.level) for r in levels} == {(True, 1), (False, 0)} and len(levels) == n - 1
        for rows in (out, levels):
            parts = [r.part for r in rows]
            assert max(map(parts.count, set(parts))) < 0.3 * n
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
