"""Small cases that SQL over the test tables doesn't reach."""

import datetime as dt
import io
import random
import re
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean, settings
from tidemark.operators import asof, bios, cohort, diff, disclosures, holdings, methodology, people, resolve, stats, text, websites
from tidemark.plans.plain import list_firms
from tidemark.sources import archives, readers, sinks
from tidemark.streaming import ingest

D = dt.date


def one(df):
    return [tuple(r) for r in df.collect()]


def values(spark, column, inputs, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}").orderBy("i").select(column(F.col("x"))).collect()]


def test_numbers(spark):
    assert values(spark, clean.to_number, ["$1,234.50", "-", "", None, "12d", "nan", " 7 ", "-3", "1e3"]) == [1234.5, None, None, None, None, None, 7.0, -3.0, 1000.0]


def test_booleans(spark):
    raw = ["Y", "no", "", None, "TRUE", "x", "1", "0"]
    assert values(spark, clean.to_bool, raw) == [True, False, False, None, True, None, True, False]
    assert values(spark, clean.is_y, raw) == [True] + [False] * 7
    assert values(spark, clean.is_true_word, raw) == [False, False, False, False, True, False, False, False]


def test_names(spark):
    assert values(spark, clean.cased_name, ["O'BRIEN-SMITH", "mary ann", "ÉMILE d'ÉVRY", None]) == ["O'Brien-Smith", "Mary Ann", "Émile D'Évry", None]
    assert values(spark, clean.suffix_stripped, ["Acme, L.L.C.", "Acme Co., Inc.", "LLC", None]) == ["ACME", "ACME CO.", "LLC", None]
    assert values(spark, clean.provider_key, ["J. P. Morgan Bank, N.A.", "JPMORGAN BANK", "LLC", "Smith & Wood LLP", "Price Water & Company"]) == ["JPMORGANBANK", "JPMORGANBANK", "LLC", "SMITHWOOD", "PRICEWATER"]
    assert values(spark, clean.normalized_name, ["Acme Corp.", "A&B L.L.C.", "25 LLC", None]) == ["acme", "a b", "25", ""]


def test_dates(spark):
    assert values(spark, clean.partial_iso, ["2024", "2024-05", "5/7/2024", "05/2024", "soon", None]) == ["2024", "2024-05", "2024-05-07", "2024-05", None, None]
    assert values(spark, clean.filed_date, ["30-JUN-2024", "06/30/2024", "2024-06-30", "x"]) == [D(2024, 6, 30)] * 3 + [None]
    assert values(spark, readers.period_of_name, ["2024q3.zip", "ia063024.zip", "ia06302024.csv", "x_20240701_20240731.zip", "none"]) == [D(2024, 9, 30), D(2024, 6, 30), D(2024, 6, 30), D(2024, 7, 31), None]


def test_hosts(spark):
    assert values(spark, clean.host_of, ["https://www.Example.com/x", "example.org.", "mailto", "", None, "http://me@a.b.de:80/"]) == ["example.com", "example.org", None, None, None, "a.b.de"]
    assert values(spark, lambda c: clean.registrable(clean.host_of(c)), ["a.b.example.co.uk", "x.example.com"]) == ["example.co.uk", "example.com"]
    assert values(spark, lambda c: clean.is_platform(clean.host_of(c)), ["facebook.com/acme", "acme.com", None, "pinterest.ca", "a.podbean.com", "x.weixin.qq.com"]) == [True, False, False, True, True, True]


def test_formats(spark):
    assert values(spark, clean.compact_usd, [950.0, 1200.0, 34e6, 1.25e9, None], "double") == ["$950", "$1.2K", "$34M", "$1.2B", None]
    assert values(spark, clean.compact_usd, [-0.3, -0.0, 0.0, -0.5, -0.51, -3.7, 0.3], "double") == ["$-0", "$-0", "$0", "$-0", "$-1", "$-4", "$0"]
    assert values(spark, clean.ordinal, [1, 2, 3, 4, 11, 12, 13, 21, 112], "int") == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "112th"]
    assert values(spark, lambda c: clean.clean_text(c, 12), ["a  long   sentence here", "N/A", "", "short"]) == ["a long…", None, None, "short"]


def test_search_tiers(spark):
    assert values(spark, lambda c: clean.name_matches(F.lit("acme cap"), c), ["Acme Cap", "Acme Capital", "Capital of Acme", "recap macmea acmex", "other", None]) == [3, 2, 1, 0, None, None]


FILINGS = [(1, 1, D(2023, 1, 10), 5.0), (2, 1, D(2023, 5, 2), 6.0), (3, 1, D(2023, 5, 2), 7.0), (4, 2, D(2022, 3, 31), 1.0), (5, 2, D(2024, 2, 1), 2.0)]


def test_snapshots_take_the_latest_known(spark):
    f = spark.createDataFrame(FILINGS, "filing_id long, crd long, filed date, aum double")
    got = {(r.quarter, r.crd): r.filing_id for r in asof.snapshots(f, "crd", "filed", ["filing_id"], 15, F.lit(D(2024, 3, 31))).collect()}
    assert got[D(2023, 3, 31), 1] == 1 and got[D(2023, 6, 30), 1] == 3  # the larger id wins on a day
    assert got[D(2023, 6, 30), 2] == 4 and (D(2023, 9, 30), 2) not in got  # too old
    assert got[D(2024, 3, 31), 2] == 5
    w = spark.createDataFrame([(1, D(2023, 6, 30)), (1, D(2023, 8, 1))], "crd long, gone date")
    left = {(r.quarter, r.crd) for r in asof.without_withdrawn(asof.snapshots(f, "crd", "filed", ["filing_id"], 15), w, "crd", "gone").collect()}
    assert (D(2023, 3, 31), 1) in left and (D(2023, 6, 30), 1) not in left


def test_empty_inputs(spark):
    f = spark.createDataFrame([], "filing_id long, crd long, filed date, aum double")
    assert one(asof.snapshots(f, "crd", "filed", ["filing_id"], 15)) == [] and one(asof.quarter_ends(f, "filed")) == []
    assert one(asof.latest(f, ["crd"], [F.desc("filed")])) == []


def test_upper_median(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "g string, x double")
    assert one(df.groupBy("g").agg(stats.upper_median("x"), F.median("x"))) == [("a", 3.0, 2.5)]


def test_fit_recovers_a_power_law(spark):
    df = spark.createDataFrame([(float(x), 3.0 * x**0.7) for x in (1, 10, 100, 1000)] + [(0.0, 5.0), (-1.0, 2.0)], "x double, y double")
    slope, intercept, n = df.agg(*stats.log_fit(F.col("x"), F.col("y"))).first()
    assert slope == pytest.approx(0.7) and intercept == pytest.approx(1.0986, abs=1e-3) and n == 4


def test_cohorts_fall_back(spark):
    rows = [(i, "s", "m" if i < 12 else None, "r" if i < 5 else "q", float(i)) for i in range(14)] + [(99, "l", "m", "r", None)]
    df = spark.createDataFrame(rows, "id int, band string, mix string, region string, x double")
    levels = [["band"], ["band", "mix"], ["band", "mix", "region"]]
    got = {r.id: (r.l, r.s) for r in cohort.in_cohort(df, {"s": "x"}, levels, 10, level="l").collect()}
    assert got[0][0] == 2 and got[13][0] == 1 and got[99] == (0, None)
    assert got[11][1] == 1.0 and got[0][1] == pytest.approx(1 / 12) and got[12][1] == pytest.approx(13 / 14)


def test_changes_between_filings(spark):
    rows = [(1, 1, "a", "A"), (1, 1, "b", "B"), (1, 2, "a", "C"), (1, 2, "c", "A"), (2, 5, "z", "A")]
    df = spark.createDataFrame(rows, "crd int, filing int, owner string, stake string")
    got = sorted((r.owner, r.event, r.old, r.new) for r in diff.consecutive_changes(df, "crd", ["filing"], "owner", "stake").collect())
    assert got == [("a", "changed", "A", "C"), ("b", "removed", "B", None), ("c", "added", None, "A")]


def test_cascade_settles_firms_only(spark):
    """An own filer by number or file number, one by name and state, a parent that files its own and includes others, the largest of several parents."""
    ids = spark.createDataFrame([(1, 100, "crd"), (5, 500, "crd"), (6, 500, "sec_file_number")], "cik int, crd int, matched string")
    names = spark.createDataFrame([(2, 200), (3, 700), (3, 701), (1, 800), (7, 100), (8, 900), (9, 900)], "cik int, crd int")
    inside = spark.createDataFrame([(3, 300, 9000.0), (4, 300, 50.0), (3, 100, 9000.0), (1, 301, None), (1, 302, 5.0), (3, 302, 5.0)], "cik int, crd int, value double")
    tiers = [
        resolve.Tier(ids, [F.desc("cik")]), resolve.Tier(resolve.only_candidate(names, "cik", "crd").withColumn("matched", F.lit("name_state")), [F.col("cik")]),
        resolve.Tier(inside.withColumn("matched", F.lit("included_manager")), [F.desc(F.coalesce("value", F.lit(0.0))), F.col("cik")], fresh=False),
    ]
    got = {r.crd: (r.cik, r.matched) for r in resolve.cascade(tiers, "cik", "crd").collect()}
    assert got == {100: (1, "crd"), 500: (6, "sec_file_number"), 200: (2, "name_state"), 900: (8, "name_state"), 300: (3, "included_manager"), 301: (1, "included_manager"), 302: (1, "included_manager")}


def test_scales(spark):
    prices = spark.createDataFrame([(c, 10.0) for c in "abcd"], "c string, price double")
    rows = [("x", c, 100.0, 10.0) for c in "abc"] + [("k", c, 0.1, 10.0) for c in "abc"] + [("few", "a", 5.0, 1.0)] + [("odd", c, 3700.0, 10.0) for c in "abc"]
    got = dict(one(holdings.scales(spark.createDataFrame(rows, "f string, c string, v double, s double"), prices, "f", "c", "v", "s")))
    assert got == {"x": 1.0, "k": 1000.0, "few": 1.0, "odd": None}


def test_flags_and_what_takes_them_back(spark):
    snippets = lambda t: spark.createDataFrame([(t,)], "t string").select(text.find_flags(F.col("t"))).first()[0]
    flags = lambda t: set(snippets(t))
    assert flags("We act as the general partner. We may get revenue sharing payments.") == {"affiliated_gp_lp", "revenue_sharing"}
    assert flags("We do not accept any referral fee. Others may. A solicitation arrangement doesn't exist") == set()
    assert flags("No conflict. A referral fee is paid.") == {"revenue_sharing"}  # the negation is in another sentence
    assert flags("Referral fees ........... 14") == set() and flags("The fund has a 12b-1 fee") == set() and flags("We earn a 12b-1 fee") == {"revenue_sharing"}
    assert "proprietary fund" in snippets("x " * 300 + "our proprietary fund is" + " y" * 300)["proprietary_funds"]


def test_places_of_matches(spark):
    df = spark.createDataFrame([("Fund a fund\U0001f600FUND",), ("none",), ("",), ("fundfund",)], "t string")
    got = [[(m.begin, m.end) for m in r[0]] for r in df.select(text.matches(F.col("t"), "fund")).collect()]
    assert got == [[(0, 4), (7, 11), (12, 16)], [], [], [(0, 4), (4, 8)]]
    out = df.union(spark.createDataFrame([(None,)], "t string")).select(text.find_flags(F.col("t"))).collect()
    assert [r[0] for r in out] == [{}] * 5


SUPPLEMENT = """Part 2B of Form ADV: Brochure Supplement
Item 1{dash}Cover Page
{cover}
This brochure supplement provides information about {about} that supplements the firm's brochure.
Item 2 - Educational Background and Business Experience
{bio}
Item 3{dash}Disciplinary Information
None.
"""


def named(cover="", about="the person below", bio="Born 1970, a degree in economics, planner since 2001.", dash=" - "):
    return [(b["name"], b["crd"]) for b in bios.bios_of(SUPPLEMENT.format(cover=cover, about=about, bio=bio, dash=dash))]


@pytest.mark.parametrize("given,want", [
    (dict(cover="Anna Maria Roe (Annie)\nRoe Creek Capital LLC\n12 Main Street, Suite 4\nChicago, Illinois 60618", about="Annie Roe", dash=" – "), [("Anna Maria Roe", None)]),
    (dict(cover="SUPERVISED PERSON'S NAME:\nPaul F. Stone\n4 Oak Avenue\nTowson, MD 21204"), [("Paul F. Stone", None)]),
    (dict(cover="ANNA EVA ROE\n3590 Park Dr.- Ste 140.\nSan Luis, CA 93401", about="Anna E. Roe (CRD# 4665596)"), [("ANNA EVA ROE", 4665596)]),
    (dict(cover="Advisory Personnel\nSteven Michael Gray\n  CRD#: 1022056", bio="Investment Advisor Name: Steven Gray\nYear of Birth: 1954"), [("Steven Michael Gray", 1022056)]),
    (dict(about="Juan Núñez-Ybarra", bio="Juan Núñez-Ybarra – Born 1961\nBachelor of Arts"), [("Juan Núñez-Ybarra", None)]),
    (dict(cover="Douglas Norman Mann Lind & Mann, Inc.", about="Douglas Norman Mann"), [("Douglas Norman Mann", None)]),
    (dict(cover="Douglas Norman Mann Lindahl", about="Douglas Norman Mann"), [("Douglas Norman Mann", None)]),
    (dict(cover="Jane Roe\nCRD No. 7680872", bio="Jane Roe was born in 1980."), [("Jane Roe", 7680872)]),
    (dict(cover="Jeremy S. Martin\nSearch with the Advisor's firm name or\nCRD# 170093.\nor his individual\nCRD# 4587392.", bio="Jeremy S. Martin, CFP®, born in 1977, is dedicated to advising."), [("Jeremy S. Martin", 4587392)]),
    (dict(bio="Mr. Bob van Dyke has a degree in economics and many years of experience."), [("Bob van Dyke", None)]),
    (dict(bio="Registered in 1998, earned a license in 2001, and has served clients in the area."), []),
    (dict(cover="Acme Capital LLC\nMain Street\nSome Wealth Partners", bio="Born in 1970, studied economics."), []),
    (dict(cover="Jane Roe", bio="Too short"), []),
    (dict(cover="Jane Roe", bio="She studied. Her educational background and business experience is as follows: a planner since 2001."), [("Jane Roe", None)]),
    (dict(bio="NAME: James Cahn TITLE: Chair & Chief Officer\nBorn 1980, a degree in finance.\nNAME: Eva Hub TITLE: Deputy\nBorn 1985, a degree in law."), [("James Cahn", None), ("Eva Hub", None)]),
])
def test_whose_a_biography_is(given, want):
    assert named(**given) == want


@pytest.mark.parametrize("text,want", [
    # the number on a line of its own, behind a table of contents that pads its entries with spaces
    ("Ina A. Lark\n\nThis brochure supplement provides information about Ina A. Lark that supplements Sea Wealth's brochure.\nItem 1 – Cover Page                1\nItem 2 - Educational Background and Business Experience         3\nItem 3 - Disciplinary Information   4\n\nItem 2\nEducational Background and Business Experience\n\nName: Ina A. Lark\nYear of Birth: 1983, Some College\n\nItem 3 - Disciplinary Information\nNone.", ["Ina A. Lark"]),
    # a heading of capitals, prose with its words, and a firm named after its founder
    ("Item 1 – Cover Page\nDora N. Mansfeld\nLind & Mansfeld, Inc.\nITEM 2 – EDUCATIONAL BACKGROUND AND BUSINESS EXPERIENCE\nMs. Mansfeld was born in 1949. Her educational background and business experience\nis as follows: a college, a bank.\nItem 3 Disciplinary Information", ["Dora N. Mansfeld"]),
    # a possessive before each heading
    ("Atul Gosh's Biographical Information\nEducational Background and Business Experience\nBirth date: January 2, 1972, a degree in law.\nDisciplinary Information\nNone.\nEva Lund’s Biographical Information\nEducational Background and Business Experience\nBirth date: March 5, 1981, a degree in art.\nDisciplinary Information\nNone.", ["Atul Gosh", "Eva Lund"]),
    # told by where more can be read
    ("Acme Planners LLC\nAdditional information about Jane Dorn is available on the website of the regulator.\nItem 2 Educational Background and Business Experience\nBorn in 1970, studied economics at some place.\nItem 3", ["Jane Dorn"]),
    # paragraphs that open with an honorific, a surname and the birth; full names where the text tells them
    ("Our people are Christoph Karl, Mr. Denis Stein, and Mr. Nico Sant.\nItem 2 – Educational Background and Business Experience\nMr. Karl was born in 1956 and attended a university. He is the owner.\nMr. Stein was born in 1960, attended another one.\nMs. Other is born in 1984, attended a third.\nItem 3", ["Christoph Karl", "Denis Stein", "Ms. Other"]),
    # a name that ran into words on both sides, cut to what two witnesses share
    ("Item 1 Cover Page\nSenior Planner Maria Eva Holt\nThis supplement has information about Maria Eva Holt that supplements the Acme brochure.\nItem 2- Business Experience\nMaria Eva Holt was born in 1949 and is a planner.\nItem 3", ["Maria Eva Holt"]),
    # degrees without a comma are no part of a name; a middle name isn't one
    ("Item 1 Cover Page\nChel B. Miesch CFP® EA®\n12 Main Street\nItem 2 Educational Background and Business Experience\nBorn in 1990, studied economics.\nItem 3", ["Chel B. Miesch"]),
    # addresses, firms and buildings make no person; nothing sure, no biography
    ("Item 1 Cover Page\nNorth Bay Capital\n123 Main Street\nFairview Plaza\nItem 2 Educational Background and Business Experience\nRegistered in 1998, earned a license in 2001.\nItem 3", []),
    ("The Adviser requires an educational background and business experience of five years.\nItem 10 – Other Activities\nNone.", []),
])
def test_biographies_as_filed(text, want):
    indented = "\n".join(f"    {x}" for x in text.split("\n"))
    assert [b["name"] for b in bios.bios_of(text)] == [b["name"] for b in bios.bios_of(indented)] == want


def test_shared_runs_of_names():
    assert bios.shared_run("Senior Planner Eva Holt", "EVA HOLT born") == ["Eva", "Holt"] and bios.shared_run("A B", "C") == []
    assert bios.agreed(["Eva Holt Acme", "Eva Holt"]) == "Eva Holt" and bios.agreed(["Anna Maria Roe", "Annie Roe"]) == "Anna Maria Roe" and bios.agreed([]) is None
    assert bios.agreed(["Eva Mae Holt", "Dr Eva Mae Holt"]) == "Eva Mae Holt"


def test_firm_documents(spark):
    rows = [(9, 5, "Zoe Ray", 2, "b"), (9, 5, "Ann Low", 1, "a"), (8, None, "No Firm", 3, "c"), (7, 6, "No Number", None, "d")]
    b = spark.createDataFrame(rows, "doc int, firm int, name string, crd int, bio string")
    d = spark.createDataFrame([(1, True, 2), (1, False, 9), (None, True, 1), (3, True, 1)], "crd int, regulatory boolean, flag_count int")
    got = {r.firm: [(x.name, x.crd, x.bio, x.disclosures and tuple(x.disclosures)) for x in r.advisors] for r in bios.firm_documents(b, d, "firm").collect()}
    assert got == {5: [("Ann Low", 1, "a", (False, 9)), ("Zoe Ray", 2, "b", None)], 6: [("No Number", None, "d", None)]}


def test_biographies():
    one = SUPPLEMENT.format(cover="Jane Roe\nCRD# 12345", about="Jane Roe", bio="Born in 1970, a planner since 2001.", dash=". ")
    two = SUPPLEMENT.format(cover="John Stone\nCRD# 67890", about="John Stone", bio="Born in 1958, a lawyer until 1990.", dash=". ")
    got = bios.bios_of(one + two)
    assert [(b["name"], b["crd"], b["bio"]) for b in got] == [("Jane Roe", 12345, "Born in 1970, a planner since 2001."), ("John Stone", 67890, "Born in 1958, a lawyer until 1990.")]
    contents = "Item 2 - Educational Background and Business Experience {0}\nItem 3 - Disciplinary Information 4\n"
    for page in (" " + "." * 30 + " 21", " ......... ...... iv", "            3"):
        assert bios.bios_of("Jane Roe\n" + contents.format(page)) == [] and len(bios.bios_of(contents.format(page) + one)) == 1
    bare = "Jane Roe\nEducational Background & Business Experience\nBorn in 1970, a planner since 2001.\nDisciplinary Information\nNone."
    assert [b["name"] for b in bios.bios_of(bare)] == ["Jane Roe"] and bios.bios_of("") == [] and bios.bios_of("Item 1\nNo heading") == []
    assert bios.person_name("JOHN SMITH, CFP") == "JOHN SMITH" and bios.person_name("Wealth Partners") is None and bios.person_name("One") is None and bios.person_name("Élodie d’Or") is None


def test_header_resolution(spark):
    df = spark.createDataFrame([("1", "x")], ["Organization  CRD#", "Name"])
    got = readers.resolve_columns(df, {"crd": ["crd", "organization crd#"], "name": ["name"], "phone": ["tel"]}, ["crd"])
    assert one(got) == [("1", "x", None)]
    with pytest.raises(ValueError):
        readers.resolve_columns(df, {"tel": ["tel"]}, ["tel"])


def test_tolerant_reader(spark, tmp_path):
    from pyspark.sql.types import StringType, StructType

    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y,z\n3,NA\n")
    good, bad = readers.read_tolerant(spark, str(tmp_path / "a.csv"), StructType().add("a", StringType()).add("b", StringType()))
    assert sorted(one(good)) == [("1", "x"), ("3", "NA")] and one(bad) == [(1,)]


def test_links(spark):
    page = """<a href="/a.zip?x=1">a</a><a href='b.ZIP'>b</a><a href="c.pdf">c</a>"""
    assert values(spark, lambda c: readers.links(c, ".zip"), [page, "", None]) == [["/a.zip?x=1", "b.ZIP"], [], None]
    assert values(spark, lambda c: readers.absolute(c, F.lit("https://e.org/x/y")), ["/a", "b", "http://z/q"]) == ["https://e.org/a", "https://e.org/b", "http://z/q"]


def test_long_lists(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [1])], "id int, xs array<int>")
    short, long = sinks.split_long_lists(df, "xs", 2)
    assert sorted(one(short.select("id", "xs", "own_file", "n_items"))) == [(1, None, True, 3), (2, [1], False, 1)] and one(long.select("id")) == [(1,)]


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(one(sinks.upsert(old, new, ["k"]))) == [(1, "a"), (2, "c"), (3, "d")]


def test_list_firms_bounds_its_limit(spark):
    df = spark.range(600).select(F.col("id").alias("crd"), F.col("id").cast("double").alias("aum"), F.lit("x").alias("mix"))
    assert list_firms(df, limit=10_000).count() == 500 and list_firms(df, least=590.0).count() == 10


def test_sessions(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), 1) for m in (0, 5, 50)]
    spark.createDataFrame(rows, "ts timestamp, k int").write.parquet(str(tmp_path / "in"))
    s = ingest.sessions(spark.readStream.schema("ts timestamp, k int").parquet(str(tmp_path / "in")), "ts", "k", "10 minutes", "1 hour")
    q = s.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


FIRM = "crd long, name string, aum_total double, employees_advisory long, employees_total long, accounts_total long, fee_pct_of_aum boolean, fee_commissions boolean, fee_performance_based boolean, affil_count int, disciplinary_flag_count int, pct_clients_individuals double, pct_clients_hnw_individuals double, aum_band string, client_mix string, region string, advisors long, flagged_advisors long, recent_events long"


def firm(crd, aum, staff=10, **more):
    base = dict(crd=crd, name=f"F{crd:03}", aum_total=aum, employees_advisory=staff, employees_total=None, accounts_total=100, fee_pct_of_aum=True, fee_commissions=False, fee_performance_based=False, affil_count=0, disciplinary_flag_count=0, pct_clients_individuals=None, pct_clients_hnw_individuals=None, aum_band="b", client_mix="m", region="r", advisors=None, flagged_advisors=None, recent_events=0)
    return tuple((base | more).values())


def test_published_methodology(spark):
    rows = [firm(i, 1e8 * i, staff=i % 7 + 1) for i in range(1, 41)]
    rows += [firm(50, 9e9, disciplinary_flag_count=1), firm(51, 9.5e9, staff=2), firm(52, 5e7), firm(53, 2e9, fee_commissions=True, fee_performance_based=True, advisors=30, flagged_advisors=30), firm(54, 3e8, advisors=10, flagged_advisors=10)]
    rows += [firm(60 + i, 4e8, advisors=40, flagged_advisors=i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, FIRM)
    best = methodology.top_firms(df, methodology.METHODS["default"]).collect()
    assert len(best) == 10 and not {r.crd for r in best} & {50, 51, 52} and [r.score for r in best] == sorted((r.score for r in best), reverse=True)
    (r,) = methodology.outlier_firms(df, methodology.METHODS["default"]).collect()
    assert r.crd == 53 and set(r.signals) == {"advisor_disclosures", "commissions_plus_performance"} and r.score == 60
    assert [r.crd for r in methodology.outlier_firms(df, methodology.METHODS["clean_record"]).collect()] == [50]
    for m in methodology.METHODS.values():
        assert methodology.top_firms(df, m, None).where("score < 0 or score > 100").count() == 0


def test_sliding_points(spark):
    got = spark.createDataFrame([(0.9,), (0.95,), (1.0,)], "s double").select(methodology.sliding(50.0, F.col("s"), 0.9)).collect()
    assert [r[0] for r in got] == [20, 35, 50]


def test_match_levels(spark):
    rows = [("edwardjones", "EDWARD JONES", 4), ("janushenderson", "JANUS HENDERSON INVESTORS", 3), ("blackrock", "BLACKROCK FUND ADVISORS", 2), ("ifa", "INDEX FUND ADVISORS, INC.", 2), ("zmlp", "ZEPHYR MANAGEMENT, L.P.", 2), ("kkr", "KOHLBERG KRAVIS ROBERTS & CO. L.P.", 2)]
    rows += [("edwardjonescreditcard", "EDWARD JONES", 1), ("capital", "CAPITAL RESEARCH", 1), ("other", "EDWARD JONES", 0), ("x", None, 0), ("llc", "LLC", 0)]
    got = websites.with_match_level(spark.createDataFrame(rows, "label string, name string, want int"), "label", "name", "level").collect()
    assert [(r.label, r.level) for r in got] == [(r.label, r.want) for r in got]


def test_websites(spark):
    rows = [(1, ["weixin.qq.com/x", "ishares.com", "https://www.blackrock.com"], None, "BLACKROCK FUND ADVISORS"), (2, ["twosigma.cn", "twosigma.com"], "Two Sigma", "TWO SIGMA LP"), (3, ["a.org/x", "b.com"], "Nothing Alike", None), (4, ["facebook.com/x"], "X", "X"), (5, None, "X", "X")]
    got = dict(one(websites.pick_websites(spark.createDataFrame(rows, "crd int, filed array<string>, b string, l string"), "crd", "filed", "b", "l")))
    assert got == {1: "https://www.blackrock.com", 2: "http://twosigma.com", 3: "http://a.org/x"}


def test_icons(spark):
    rows = [(200, b"\x89PNG" + b"x" * 70, True), (200, b" \n<svg" + b"x" * 70, True), (200, b"\x89PNG", False), (404, b"GIF8" + b"x" * 70, False), (200, b"<html>" + b"x" * 70, False), (200, None, False)]
    assert all(r.got == r.want for r in spark.createDataFrame(rows, "s int, b binary, want boolean").select(websites.is_real_icon(F.col("s"), F.col("b")).alias("got"), "want").collect())


def test_people(spark):
    df = spark.createDataFrame([(1, "Smith-Jones, Ann"), (2, "Ann Smith"), (3, "Bob Smithers"), (4, None), (5, "Ann B. Smith")], "k int, name string")
    assert [r.k for r in people.search_people(df, "name", "ann smi").collect()] == [5, 2, 1]
    assert [r.k for r in people.search_people(df, "name", "ann Smith").collect()] == [5, 2, 1] and people.search_people(df, "name", "a !").count() == 0
    d = spark.createDataFrame([(0, "a"), (1, "m"), (2, "ma"), (3, "mb"), (4, "mc"), (5, "z")], "bucket int, first string")
    assert people.too_broad(d, "ma") is False and people.buckets_for(d, "m").count() == 5 and people.too_broad(d.unionByName(d.selectExpr("bucket + 10 as bucket", "concat('ma', first) as first")), "ma")


def test_people_of_one_name_come_by_key(spark, tmp_path):
    df = spark.createDataFrame([(k, "Ann Smith") for k in (9, 3, 7, 1, 8, 2)], "k int, name string").repartition(3)
    assert [r.k for r in people.search_people(df, "name", "ann smith", 3, "k").collect()] == [1, 2, 3]
    sinks.write_buckets(df, str(tmp_path / "people"), "k", "name", 100)
    assert [r.k for r in people.search_folder(spark, str(tmp_path / "people"), "k", "name", "ann smith", 3).collect()] == [1, 2, 3]


def test_settings_from_links():
    assert settings.compared("?firms=3,x, 4,3,5,6,7") == [3, 4, 5, 6] and settings.compared("") == []
    for name, m in methodology.METHODS.items():
        assert settings.preset_of(settings.decoded(settings.encoded(m))) == name
    own = settings.sanitized({"weights": {"scale": 5, "hnw_focus": "x"}, "min_staff": 2.6, "threshold": float("nan"), "cohorts": ["region", "bad"], "other": 1})
    assert own.weights["scale"] == 1 and "hnw_focus" not in own.weights and own.min_staff == 3 and own.threshold == 40 and own.cohorts == ("region",)
    assert settings.decoded(settings.encoded(own)) == own and settings.decoded("!!") is None and settings.decoded("e30") == settings.sanitized({})


def test_brochures(spark):
    inner = '{\\"brochures\\": {\\"brochuredetails\\": [{\\"brochureVersionID\\": 5, \\"brochureName\\": \\"A\\"}, {\\"brochureName\\": \\"B\\"}]}}'
    raw = ['{"hits": {"hits": [{"_source": {"iacontent": "%s"}}]}}' % inner, '{"hits": {"hits": []}}', "not json", None]
    assert values(spark, readers.brochure_list, raw) == [[(5, "A", None)], [], [], []]
    assert values(spark, lambda c: readers.filing_url(F.lit("0001234"), c), ["0001-24-000005"]) == ["https://www.sec.gov/Archives/edgar/data/1234/000124000005/"]


def test_search_reads_few_buckets(spark, tmp_path):
    """Words that all begin alike are dealt out; a search reads the buckets of its words, by their folders, and finds what the search of all names finds."""
    rng = random.Random(3)
    names = [f"{rng.choice(['Ann', 'Anna', 'Bob', 'Zoe'])} 000{rng.randrange(5000):04} {rng.choice(['Smith', 'Smart', 'Doe', 'O’Neil'])}" for _ in range(4000)] + ["", None, "Ann Lee-Smith", "Quentin Only"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string").repartition(5)
    folder = str(tmp_path / "search")
    sinks.write_buckets(df, folder, "k", "name", 100)
    written, directory = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/directory")
    every = sorted((t, i) for i, n in enumerate(names) for t in {x for x in re.split("[^a-z0-9]+", (n or "").lower()) if x})
    assert sorted((r.token, r.k) for r in written.collect()) == every
    first, place = {}, {}
    for n, (t, _) in enumerate(every):
        first.setdefault(t, n)
    assert all(r.bucket == first[r.token] // 100 for r in written.select("token", "bucket").distinct().collect())
    assert {(r.bucket, r.first) for r in directory.collect()} == {(b, min(t for t in first if first[t] // 100 == b)) for b in {n // 100 for n in first.values()}}
    for query in ("quentin", "only quen", "lee ann", "o neil bo"):
        try:
            found = people.search_folder(spark, folder, "k", "name", query, 10_000)
        except ValueError:
            spans = people.bucket_spans(directory, people.query_words(query))
            assert all(b - a >= people.MAX_BUCKETS for a, b in spans.values())
            continue
        want = people.search_people(df, "name", query, 10_000)
        assert sorted(r.k for r in found.collect()) == sorted(r.k for r in want.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
        scans = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
        assert scans and all(int(b) - int(a) < people.MAX_BUCKETS for x in scans for a, b in [re.search(r">= (\d+)\).*<= (\d+)", x).groups()])
    assert people.search_folder(spark, folder, "k", "name", "zz top").count() == 0 == people.search_folder(spark, folder, "k", "name", "!").count()
    assert people.too_broad(directory, "ann smith") and not people.too_broad(directory, "quentin smith")


def test_upsert_rewrites_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_keyed(spark.range(1000).selectExpr("id as k", "'old' as v"), path, ["k"], 16)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(5, "new", 1), (5, "first", 0), (7, "new", 0), (5000, "new", 0)], "k long, v string, o int")
    parts = sinks.upsert_keyed(new.drop("o").where("v <> 'new' or k <> 5"), path, ["k"], 16)
    own = {r[0] for r in new.select(sinks._part(["k"], 16)).collect()}
    assert set(parts) == own and 1 <= len(own) <= 3
    kept = {f for f in before if f in files()}
    assert {int(f.parent.name.rpartition("=")[2]) for f in before if f not in kept} == own and len(kept) == len(before) - len(own)
    got = {r.k: r.v for r in sinks.read_keyed(spark, path).collect()}
    assert len(got) == 1001 and (got[5], got[7], got[5000], got[6]) == ("first", "new", "new", "old")
    assert sinks.upsert_keyed(new.drop("o").where("false"), path, ["k"], 16) == []
    with pytest.raises(ValueError):
        sinks.upsert_keyed(new.drop("o"), path, ["k"], 8)


def test_small_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, seen string")
    assert sorted(one(sinks.stamped(df, F.col("k") == 1, "seen", F.lit("now")))) == [(1, "now"), (2, "x")]
    sinks.refresh(df, str(tmp_path / "t"))
    sinks.refresh(df.where("k = 2"), str(tmp_path / "t"))
    assert one(spark.read.parquet(str(tmp_path / "t"))) == [(2, "x")]
    urls = spark.createDataFrame([("https://e.org/?a=1&b=2", D(2024, 5, 1))], "u string, d date")
    assert one(sinks.sitemap(urls, "u", "d")) == [("<url><loc>https://e.org/?a=1&amp;b=2</loc><lastmod>2024-05-01</lastmod></url>",)]


def test_json_documents(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{"as_of": "2024", "firms": {"5": {"n": 1}, "7": {"n": null}}}')
    got = readers.read_json_map(spark, str(tmp_path / "doc.json"), "firms", "struct<n:int>").select("crd", "value.n")
    assert sorted(one(got)) == [("5", 1), ("7", None)]


def test_identity_and_rates(spark):
    rows = [("A", "77", "SMITH", None), ("A", "", "SMITH", None), ("B", None, "SMITH", "ACME")]
    df = spark.createDataFrame(rows, "s string, i string, n string, o string").select(diff.identity_key(F.col("s"), F.col("i"), F.col("n"), F.col("o")))
    assert [r[0] for r in df.collect()] == ["A|id:77|", "A|nm:SMITH|", "B|nm:SMITH|ACME"]
    assert values(spark, lambda c: F.round(clean.annual_rate(c, 3), 6), [8.0, 1.0, 0.0, None], "double") == [1.0, 0.0, None, None]
    assert values(spark, clean.gentle_name, ["Smith Holdings, LLC", None]) == ["SMITH HOLDINGS LLC", None]


def test_effective_filings(spark):
    rows = [(1, 1, "A", D(2024, 1, 1)), (1, 2, "R", D(2024, 2, 1)), (1, 3, "N", D(2024, 1, 15)), (1, 4, "N", D(2024, 3, 1)), (2, 5, "N", D(2024, 1, 1))]
    got = asof.effective(spark.createDataFrame(rows, "cik int, id int, kind string, d date"), "cik", "kind", ["d", "id"], ["A", "R"], ["N"])
    assert sorted(r.id for r in got.collect()) == [2, 4]


def workbook(rows):
    """A small workbook: shared and inline strings, numbers, and gaps."""
    shared = sorted({str(x) for r in rows for x in r if isinstance(x, str)})
    cell = lambda x, at: "" if x is None else f'<c r="{at}" t="s"><v>{shared.index(x)}</v></c>' if isinstance(x, str) else f'<c r="{at}"><v>{x}</v></c>'
    body = "".join("<row>" + "".join(cell(x, f"{chr(65 + i)}{n}") for i, x in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def test_members_of_archives_and_workbooks(spark, tmp_path):
    book = workbook([["CRD", "Name", "5F(2)(c)"], [1, "One", 2.5], [2, None, 7]])
    files = {
        "a.zip": zipped(ia_1__csv='\ufeffCRD,"Legal  Name",AUM\n1,"A, ""b""\nc",5\n2,Zwei,6,too many\n3,Drei\n', ia_2__CSV=b"crd,NAME\n9,caf\xe9\n", other__csv="CRD\n7\n"),
        "b.zip": zipped(ia_3__xlsx=book), "c.xlsx": book, "d.zip": b"no archive", "e.zip": zipped(ia_4__csv=""),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = archives.zipped_rows(archives.list_archives(spark, str(tmp_path)), r"ia_\d\.(csv|xlsx)")
    got = sorted(tuple(r) for r in rows.select(F.element_at(F.split("source_archive", "/"), -1), "member", archives.field("crd").alias("crd"), archives.field("name", "legal name").alias("name"), archives.field("aum", "5f(2)(C)").alias("aum")).collect())
    assert got == [("a.zip", "ia_1.csv", "1", 'A, "b"\nc', "5"), ("a.zip", "ia_1.csv", "3", "Drei", None), ("a.zip", "ia_2.CSV", "9", "caf\ufffd", None), ("b.zip", "ia_3.xlsx", "1", "One", "2.5"), ("b.zip", "ia_3.xlsx", "2", "", "7"), ("c.xlsx", "c.xlsx", "1", "One", "2.5"), ("c.xlsx", "c.xlsx", "2", "", "7")]
    (tmp_path / "f.zip").write_bytes(b"")
    nothing = spark.createDataFrame([(None,), (f"file://{tmp_path}/f.zip",), (f"file://{tmp_path}/d.zip",)], "path string")
    assert archives.zipped_rows(nothing, ".*").count() == 0
    # a filter on members is all that is read: b's workbook is no more opened
    some = archives.members(archives.list_archives(spark, str(tmp_path)), ".*").where("member = 'other.csv'")
    assert [(r.size, r.method) for r in some.collect()] == [(6, 0)] and [r.fields for r in archives.member_rows(some).collect()] == [{"CRD": "7"}]


def test_written_archives_are_read_back(spark, tmp_path):
    files = spark.createDataFrame([("a.zip", "m2.csv", "x,y\n1,2\n"), ("a.zip", "m1.csv", "x\n" + "7\n" * 50_000), ("b.zip", "m1.csv", None)], "path string, member string, text string")
    listed = archives.write_archives(files, f"file://{tmp_path}/z")
    assert sorted(r.path.rsplit("/", 1)[-1] for r in listed.collect()) == ["a.zip", "b.zip"]
    rows = archives.zipped_rows(archives.list_archives(spark, f"{tmp_path}/z"), ".*")
    assert sorted((r.member, r["count"]) for r in rows.groupBy("member").count().collect()) == [("m1.csv", 50_000), ("m2.csv", 1)]
    broken = bytearray((tmp_path / "z/a.zip").read_bytes())
    broken[50:60] = bytes(x ^ 255 for x in broken[50:60])  # within the first member's packed bytes
    (tmp_path / "broken.zip").write_bytes(broken)
    with pytest.raises(Exception, match="invalid|incorrect|too early|decompressing|checksum"):
        archives.zipped_rows(archives.list_archives(spark, f"{tmp_path}/broken.zip"), ".*").collect()


def test_files_are_written_line_by_line(spark, tmp_path):
    """A file's text is that of its rows in their order, however they are dealt; what isn't shuffled is made when it is written."""
    lines = spark.range(30_000).select(F.format_string("a%d.zip", F.col("id") % 3).alias("path"), F.format_string("m%d.csv", F.col("id") % 2).alias("member"), F.col("id").alias("n")).repartition(7)
    text = F.when(F.col("n") != 7, F.concat(F.col("n").cast("string"), F.lit("é\n")))
    assert archives.write_archives(lines, f"file://{tmp_path}/z", ["n"], text, tasks=5).count() == 3
    for i in range(3):
        with zipfile.ZipFile(tmp_path / f"z/a{i}.zip") as z:
            assert z.testzip() is None and z.namelist() == ["m0.csv", "m1.csv"]
            for j in range(2):
                assert z.read(f"m{j}.csv").decode() == "".join(f"{n}é\n" for n in range(30_000) if n % 3 == i and n % 2 == j and n != 7)


def test_cells_are_fields(spark):
    rows = [({"CRD # ": "1", "crd#": "2", "Name": ""},), ({"a b": "x"},), (None,), ({},)]
    df = archives.with_cells(spark.createDataFrame(rows, "fields map<string,string>"))
    for names in (("crd#",), ("CRD #", "name"), ("nothing", "AB"), ("nAmE", "crd#")):
        assert one(df.select(archives.cell(*names))) == one(df.select(archives.field(*names)))
    assert [r[0] for r in df.select(archives.cell("AB", "NAME")).collect()] == ["", "x", None, None]


def test_an_archive_of_a_union_is_written_once(spark, tmp_path):
    """Files that are each dealt by path already, some large, some small: their partitions aren't merged alike."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        rows = spark.range(40_000).select((F.concat(F.lit("a"), (F.col("id") % 8).cast("string"), F.lit(".zip"))).alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        part = lambda some, name: some.groupBy("path").agg(F.concat_ws("\n", F.lit("x"), F.array_join(F.collect_list("x"), "\n")).alias("text")).withColumn("member", F.lit(name))
        listed = archives.write_archives(part(rows, "large.csv").unionByName(part(rows.where("id < 8"), "small.csv")), f"file://{tmp_path}/u")
        assert sorted(r.path.rsplit("/", 1)[-1] for r in listed.collect()) == [f"a{i}.zip" for i in range(8)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    got = archives.zipped_rows(archives.list_archives(spark, f"{tmp_path}/u"), ".*").groupBy("member").count().collect()
    assert {r.member: r["count"] for r in got} == {"large.csv": 40_000, "small.csv": 8}


def test_large_archives_are_read_by_ranges(spark, tmp_path):
    """A member behind three gigabytes that nobody reads, and one of 300 MB that is inflated as a stream: no task holds either."""
    path = tmp_path / "large.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        with z.open("hole.bin", "w", force_zip64=True) as f:
            f.write(b"x")
        start = z.fp.tell()
        z.fp.seek(start + 3_000_000_000)  # sparse: no such bytes on disk
        z.start_dir = z.fp.tell()
        z.writestr("far.csv", "crd,n\n5,1\n", zipfile.ZIP_DEFLATED)
        with z.open(zipfile.ZipInfo("long.csv"), "w", force_zip64=True) as f:
            f.write(b"crd,text\n")
        info = zipfile.ZipInfo("packed.csv")
        info.compress_type = zipfile.ZIP_DEFLATED
        with z.open(info, "w", force_zip64=True) as f:
            f.write(b"crd,text\n")
            for _ in range(300):
                f.write((b"1," + b"a" * 9_998 + b"\n") * 100)
    found = archives.members(archives.list_archives(spark, str(path)), r".*\.csv")
    assert max(r.offset for r in found.collect()) > 3_000_000_000 and {r.member for r in found.collect()} == {"far.csv", "long.csv", "packed.csv"}

    def peak(batches):
        import resource

        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_pydict({"n": [n], "mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024]})

    rows = archives.member_rows(found, tasks=3)
    assert rows.where("fields['crd'] = '5'").count() == 1
    told = rows.select("member").mapInArrow(peak, "n long, mb long").collect()
    assert sum(r.n for r in told) == 30_001 and max(r.mb for r in told) < 500


def test_archives_are_loaded_once(spark, tmp_path, monkeypatch):
    """A batch that fails between its rows and its ledger entry is repeated, and each row is there once; a load that forgot what it read takes the ledger's word."""
    source, sink, ledger = tmp_path / "in", str(tmp_path / "rows"), str(tmp_path / "ledger")
    files = lambda *names: spark.createDataFrame([(f"{n}.zip", "m.csv", f"crd\n{n}\n{n}\n") for n in names], "path string, member string, text string")
    write = lambda *names: archives.write_archives(files(*names), f"file://{source}").collect()
    load = lambda checkpoint: ingest.load_archives(spark, str(source), sink, ledger, str(tmp_path / checkpoint), r"m\.csv").awaitTermination()
    rows = lambda: sorted(r.fields["crd"] for r in ingest.loaded(spark, sink, ledger).collect())
    write(1, 2)
    writer = type(spark.range(1).write)
    parquet = writer.parquet

    def failing(self, path, *a, **b):
        if path.startswith(ledger):
            raise RuntimeError("lost")
        return parquet(self, path, *a, **b)

    monkeypatch.setattr(writer, "parquet", failing)
    with pytest.raises(Exception, match="lost"):
        load("one")
    monkeypatch.setattr(writer, "parquet", parquet)
    assert spark.read.parquet(sink).count() == 4 and rows() == []  # written, not committed
    write(3)
    load("one")
    assert rows() == ["1", "1", "2", "2", "3", "3"]
    load("one")
    write(4)
    load("other")
    assert rows() == ["1", "1", "2", "2", "3", "3", "4", "4"]


def test_disclosures_of_three_kinds_have_one_shape(spark, tmp_path):
    data = zipped(
        IA_ADV_Base_A_1__csv="FilingID,1E1\n10,100\n11,\n", IA_DRP_Advisory_Affiliates_1__csv="FilingID,ReferenceID,Affiliate Name\n10,5,Beta\n10,5,Alpha\n10,6,N/A\n",
        IA_DRP_Regulatory_1__csv='FilingID,ReferenceID,Date Initiated,Initiated By,Principal Sanction,Principal Product,Filed Against,Monetary Amount,Remove-Filed in Error\n10,5,5/21/2024,SEC,,Notes,Affiliates,"$1,250.75",Y\n11,5,2024,SEC,x,,,,\n10,,2024,SEC,x,,,,\n',
        IA_DRP_Criminal_1__csv="FilingID,ReferenceID,Date First Charged,Court,Event Detail,Disposition\n10,6,05/2024,Court,Detail,Dismissed\n", IA_DRP_Civil_Judicial_1__csv="FilingID,ReferenceID,Filing Date,Resolution Type,Summary\n10,7,2023,Settled,NONE\n",
    )
    (tmp_path / "z.zip").write_bytes(data)
    out = disclosures.disclosure_events(archives.zipped_rows(archives.list_archives(spark, str(tmp_path)), "IA_.*"))
    got = {r.ref: r for r in out.collect()}
    assert set(got) == {"R5", "C6", "J7"}
    r, c, j = got["R5"], got["C6"], got["J7"]
    assert (r.crd, r.filing_id, r.against, r.date, r.by, r.what, r.amount, r.removed, r.affiliates) == ("100", 10, "A", "2024-05-21", "SEC", "Notes", 1250, True, ["Alpha", "Beta"])
    assert (c.kind, c.against, c.date, c.by, c.what, c.resolution, c.text, c.removed, c.affiliates) == ("C", "F", "2024-05", "Court", "Detail", "Dismissed", "Detail", False, [])
    assert (j.kind, j.date, j.resolution, j.text, j.amount) == ("J", "2023", "Settled", None, None)


def test_disclosures_of_packed_archives_are_not_broadcast(spark, tmp_path):
    """Spark takes files to be as large as they are packed: what looks like a few kilobytes is far more, and must not be sent to the driver. Rows meet in one shuffle of files that are read once."""
    n = 20_000
    data = zipped(
        IA_ADV_Base_A_1__csv="FilingID,1E1\n10,100\n10,\n11,\n,7\n", IA_DRP_Advisory_Affiliates_1__csv="FilingID,ReferenceID,Affiliate Name\n" + "".join(f"10,{i},A{j}\n" for i in range(n) for j in (2, 1)) + "10,,B\n,1,C\n",
        IA_DRP_Criminal_1__csv="FilingID,ReferenceID,Court\n" + "".join(f"10,{i},Court\n" for i in range(n)) + "10,1,Court\n11,1,x\n,1,x\n12,1,x\n",
    )
    (tmp_path / "z.zip").write_bytes(data)
    for parts in (None, 9):
        out = disclosures.disclosure_events(archives.zipped_rows(archives.list_archives(spark, str(tmp_path)), "IA_.*"), parts)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.count("FileScan") == 1 and plan.count("Sort [") == 1
        got = out.groupBy("crd", "filing_id", "affiliates", "by").count().collect()
        assert [tuple(r) for r in got] == [("100", 10, ["A1", "A2"], "Court", n + 1)]


def test_axes_are_bounded(spark):
    df = spark.createDataFrame([(1, 2001, 5.0), (1, 2003, 7.0), (2, 2002, 1.0)], "k int, y int, v double")
    assert {r.k: r.series for r in stats.aligned(df, df, "k", "y", "v").collect()} == {1: [5.0, None, 7.0], 2: [None, 1.0, None]}
    with pytest.raises(Exception, match="more than 2 periods"):
        stats.aligned(df, df, "k", "y", "v", most=2).collect()


def test_possessives_are_all_that_the_pattern_finds():
    rng = random.Random(5)
    parts = ["Ann Lee", "'s", "’S", " biographical information", " Biographical\ninformation", "\n", "x" * 61, "a", " and ", "'"]
    for _ in range(3000):
        said = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert bios.possessives(said) == [m[1] for m in bios.OWN.finditer(said)]


def test_means_to_sort_by_are_the_same_in_any_order(spark):
    rng = random.Random(1)
    values = [round(rng.random() * 10.0 ** rng.randrange(7), 2) for _ in range(999)]
    mean = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double").repartition(3).agg(stats.exact_avg("x").alias("m")).first()[0]
    assert len({mean(rng.sample(values, len(values))) for _ in range(8)}) == 1 and mean(values) == pytest.approx(sum(values) / 999)
    assert mean([1.0, None, 2.0]) == 1.5 and mean([None]) is None and mean([float("inf"), 1.0]) == float("inf") and mean([1e300, 1e300]) == 1e300


def test_rows_of_a_sheet_leave_nothing_behind():
    """However many rows a sheet has, what is held at once stays small."""
    import tracemalloc

    book = io.BytesIO()
    with zipfile.ZipFile(book, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", "<worksheet><sheetData>" + "".join(f'<row><c r="B{i}"><v>{i}</v></c><c t="inlineStr"><is><t>a</t><r><t>&amp;b</t></r></is></c></row>' for i in range(60_000)) + "</sheetData></worksheet>")
    book.seek(0)
    tracemalloc.start()
    try:
        n = sum(row == ["", str(i), "a&b"] for i, row in enumerate(archives.sheet_rows(book)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 60_000 and most < 2_000_000
