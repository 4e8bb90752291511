"""Reports, feeds and settings of links: cases that the queries' tables don't hold."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import settings
from tidemark.operators import documents, reports


def test_annual_reports_take_what_is_there(spark):
    rows = [
        ("a", "m1", 1, {"Organization CRD#": "5", "5F(2)(c)": "$1,000.50", "5A": "-"}), ("a", "m1", 2, {"organization crd #".upper().replace(" #", "#"): "5", "5F2C": "7"}), ("a", "m1", 3, {"Organization CRD#": " ", "5A": "3"}),
        ("a", "m2", 1, {"ORGANIZATION CRD": "6", "5B1": "12", "5F2F": "x"}), ("b", "m1", 1, {"Organization CRD#": "5", "5a": "9"}),
    ]
    df = spark.createDataFrame(rows, "source_archive string, member string, line long, fields map<string,string>")
    got = sorted(tuple(r) for r in reports.annual_reports(df).collect())
    assert got == [("a", 5, 7.0, None, None, None), ("a", 6, None, None, None, 12.0), ("b", 5, None, None, 9.0, None)]


def test_typed_columns(spark):
    df = spark.createDataFrame([(" x ", "TRUE ", "1.50"), ("", "yes", "1,5"), (None, None, " -3 ")], "A string, b string, c string")
    out = reports.typed(df, {"a": ("text", "text"), "B": ("flag", "flag"), "C": ("number", "number"), "D": ("none", "number")})
    assert [tuple(r) for r in out.collect()] == [("x", True, 1.5, None), (None, False, None, None), (None, None, -3.0, None)] and dict(out.dtypes)["none"] == "double"


def test_newest_feed(spark):
    names = ["IA_INDVL_Feed_12_31_2023.zip", "IA_INDVL_Feed_01_02_2024.zip", "IA_INDVL_Feed_13_45_2025.zip", "zz.zip"]
    df = spark.createDataFrame([(1, n) for n in names] + [(2, "zz.zip"), (2, "aa.zip"), (3, "x_20240101_20240630.zip"), (3, "x_20240101_20240630b.zip"), (3, "y_20231201_20240131.zip")], "k int, name string")
    assert {r.k: r.name for r in reports.newest(df, "name", ["k"]).collect()} == {1: "IA_INDVL_Feed_01_02_2024.zip", 2: "zz.zip", 3: "x_20240101_20240630b.zip"}


def test_roster_records_are_json(spark):
    rows = [(2, 'A "q" \\ é', [3, 1], None, True, None), (1, None, [], "NY", None, 1999)]
    df = spark.createDataFrame(rows, "crd long, name string, employers array<long>, state string, disclosure boolean, first_year int")
    got = [json.loads(r.record) for r in reports.roster(df, "crd", df.columns).collect()]
    assert got == [[1, None, [], "NY", 0, 1999], [2, 'A "q" \\ é', [3, 1], None, 1, None]]


def test_notes_and_shares(spark):
    rows = [(None, "http://a.org", "http://a.org"), ("redirect", "http://a.org", "http://b.org"), ("research", "https://www.a.org/x", "http://a.org"), ("research", None, "http://a.org"), ("research", "http://s.com/a", "http://a.org")]
    df = spark.createDataFrame(rows, "via string, filed string, shown string").select(reports.website_note(F.col("via"), F.col("filed"), F.col("shown")))
    assert [r[0] for r in df.collect()] == ["firm website", "firm website · redirected", "firm website", "firm website · researched", "firm website · researched"]
    mix = spark.createDataFrame([({"p": 40.0}, "wealth"), ({"p": 40.0}, "funds"), (None, "wealth"), ({"p": 1.0}, None)], "mix map<string,double>, segment string")
    assert [r[0] for r in mix.select(reports.segment_share(F.col("mix"), F.col("segment"), {"wealth": "p", "funds": "f"})).collect()] == [40.0, None, None, None]


@pytest.mark.parametrize("payload", [
    "no json", '"text"', "[]", "7", "{}", '{"p":"boutique"}', '{"p":"nobody"}', '{"p":""}', '{"d":{}}', '{"d":{"min_aum":-5,"min_staff":2.5,"threshold":1e9}}', '{"d":{"weights":{"scale":3,"hnw_focus":0.25}}}', '{"d":{"weights":[1]}}',
    '{"d":{"max_disclosures":null,"risk_min_aum":12}}',
])
def test_link_columns_are_what_decoding_says(spark, payload):
    link = base64.urlsafe_b64encode(payload.encode()).decode().rstrip("=")
    got = spark.createDataFrame([(link,)], "t string").select(*[c.alias(n) for n, c in settings.link_columns(F.col("t")).items()]).first()
    want = settings.decoded(link)
    if want is None:
        assert all(v is None for v in got) or payload in ('"text"', "[]", "7")
    else:
        assert {k: got[k] for k in settings.LIMITS} == {k: float(getattr(want, k)) for k in settings.LIMITS}
        assert {k: got[f"weight_{k}"] for k in settings.FACTOR_NAMES} == {k: float(want.weights.get(k, 0)) for k in settings.FACTOR_NAMES}


def test_links_that_are_none(spark):
    df = spark.createDataFrame([("***",), (None,), ("",)], "t string").select(settings.link_columns(F.col("t"))["min_aum"].alias("x"))
    assert [r.x for r in df.collect()] == [None, None, None]


def test_comparison_filters_every_source(spark):
    """Each source's scan is told the firms; a firm that a source lacks has a dash."""
    spark.range(100).selectExpr("id as k", "id % 3 as v").createOrReplaceTempView("own_rows")
    one = spark.table("own_rows")
    two = spark.range(50).selectExpr("id % 10 as k", "id as x").groupBy("k").agg(F.max("x").alias("x"))
    out = documents.compare_sources("k", [7, 42], [(one, "A", "v", F.col("v").cast("string")), (two, "B", "x", F.col("x").cast("string")), (one, "A", "none", F.lit(None).cast("string"))])
    assert [tuple(r) for r in out.collect()] == [("A", "v", "1", "0"), ("B", "x", "47", "—"), ("A", "none", "—", "—")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("IN (7,42)") >= 2
