"""Growth, fits and series of yearly reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import annual_rate
from ..operators.ranks import mid_rank, ranked, with_median
from ..operators.stats import aligned, half_decade, indexed, log_fit
from .fixtures import Tables, query

MULTIPLES = """with i as (select *, dense_rank() over (order by year) as i from annual), m as (select n.crd, k as span, n.year, b.aum as base, n.aum / b.aum as multiple from (select unnest([3, 5]) as k) cross join i n join i b on b.crd = n.crd and b.i = n.i - k where n.year = (select max(year) from annual) and b.aum >= 100000)"""


def multiples(t: Tables, spans: list[int]) -> DataFrame:
    """Growth of each firm to the last report over so many report positions, for starters of at least 100,000."""
    a = t.annual()
    years = a.select("year").distinct().withColumn("i", F.row_number().over(Window.orderBy("year")))  # one row for each year
    a = a.join(years, "year")
    last = years.agg(F.max("i").alias("last"))
    now = a.join(F.broadcast(last), F.col("i") == F.col("last")).withColumn("span", F.explode(F.array(*map(F.lit, spans))))  # one row is broadcast
    base = a.select("crd", F.col("i").alias("bi"), F.col("aum").alias("base"))
    out = now.join(base, (now["crd"] == base["crd"]) & (base["bi"] == now["i"] - now["span"])).drop(base["crd"]).where("base >= 100000")
    return out.select("crd", "span", "year", "base", (F.col("aum") / F.col("base")).alias("multiple"))


@query("w12_multiples", MULTIPLES + " select crd, span, round(multiple, 9) as multiple, round_even((rank() over (partition by span order by multiple) - 1 + count(*) over (partition by span, multiple) / 2) / count(*) over (partition by span) * 100, 0)::bigint as percentile from m")
def w12(t: Tables) -> DataFrame:
    m = ranked(multiples(t, [3, 5]).select("crd", "span", "multiple"), {"place": ("multiple", ["span"])})
    return m.select("crd", "span", F.round("multiple", 9).alias("multiple"), mid_rank("place").alias("percentile"))


@query("w12_medians", MULTIPLES + " select span, count(*) as n, round(median(multiple), 9) as median from m group by 1")
def w12_medians(t: Tables) -> DataFrame:
    m = with_median(multiples(t, [3, 5]), ["span"], F.col("multiple"), {"n": F.lit(1)})
    return m.select("span", "n", F.round("median", 9).alias("median"))


@query("t05_growth_leaders", MULTIPLES + ", j as (select distinct crd from (select crd, aum / lag(aum) over (partition by crd order by year) as up, lag(aum) over (partition by crd order by year) as was from annual) where up >= 4 and was >= 50000) select crd, round(multiple, 9) as multiple, round(pow(multiple, 1.0 / 3) - 1, 9) as yearly from m where span = 3 and crd not in (select crd from j) order by multiple desc, crd limit 50")
def t05(t: Tables) -> DataFrame:
    """Fastest growers that had no jump."""
    jumped = jumps(t, 4.0).select("crd").distinct()
    m = multiples(t, [3]).join(jumped, "crd", "left_anti").orderBy(F.desc("multiple"), "crd").limit(50)
    return m.select("crd", F.round("multiple", 9).alias("multiple"), F.round(annual_rate(F.col("multiple"), 3), 9).alias("yearly"))


def jumps(t: Tables, times: float) -> DataFrame:
    w = Window.partitionBy("crd").orderBy("year")
    a = t.annual().withColumn("was", F.lag("aum").over(w))
    return a.where((F.col("was") >= 50000) & (F.col("aum") / F.col("was") >= times))


@query("w13_last_jump", "with j as (select crd, year, aum / lag(aum) over w as up, lag(aum) over w as was from annual window w as (partition by crd order by year)) select crd, max(year) as year from j where was >= 50000 and up >= 2 group by 1")
def w13(t: Tables) -> DataFrame:
    return jumps(t, 2.0).groupBy("crd").agg(F.max("year").alias("year"))


@query("w14_change_fit", """with c as (select crd, ln(aum / lag(aum, 4) over w) as x, ln(staff / lag(staff, 4) over w) as y from annual window w as (partition by crd order by year)), s as (select c.*, mix from c join firms using (crd) where x is not null and y is not null)
    select mix, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, count(*) as n from s group by 1 having count(*) >= 30""")
def w14(t: Tables) -> DataFrame:
    """Changes over five reports within a firm."""
    w = Window.partitionBy("crd").orderBy("year")
    c = t.annual().select("crd", F.ln(F.col("aum") / F.lag("aum", 4).over(w)).alias("x"), F.ln(F.col("staff") / F.lag("staff", 4).over(w)).alias("y")).where("x is not null and y is not null")
    fit = c.join(t.firms().select("crd", "mix"), "crd").groupBy("mix").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.count("*").alias("n"))
    return fit.where("n >= 30")


FIT = "with a as (select crd, mix, sum(x.aum) as aum, sum(staff) as staff from annual x join firms using (crd) group by 1, 2), f as (select mix, regr_slope(ln(staff), ln(aum)) as slope, regr_intercept(ln(staff), ln(aum)) as intercept, count(*) as n from a group by 1 having count(*) >= 3)"


@query("w15_staff_fit", FIT + " select crd, round(exp(intercept + slope * ln(aum)), 6) as expected, round((staff / exp(intercept + slope * ln(aum)) - 1) * 100, 6) as percent from a join f using (mix)")
def w15(t: Tables) -> DataFrame:
    """Staff against what firms of that value have in the segment."""
    a = t.annual().groupBy("crd").agg(F.sum("aum").alias("aum"), F.sum("staff").alias("staff")).join(t.firms().select("crd", "mix"), "crd")
    f = a.groupBy("mix").agg(*log_fit(F.col("aum"), F.col("staff"))).where("n >= 3")
    expected = F.exp(F.col("intercept") + F.col("slope") * F.ln("aum"))
    return a.join(f, "mix").select("crd", F.round(expected, 6).alias("expected"), F.round((F.col("staff") / expected - 1) * 100, 6).alias("percent"))


@query("w16_half_decades", FIT + " select floor(2 * log10(aum))::bigint as bin, count(*) as n, round(median(staff), 6) as staff, round(pow(10, floor(2 * log10(aum)) / 2 + 0.25), 4) as middle from a group by 1, 4 having count(*) >= 15")
def w16(t: Tables) -> DataFrame:
    a = t.annual().groupBy("crd").agg(F.sum("aum").alias("aum"), F.sum("staff").alias("staff"))
    b = with_median(a.withColumn("bin", half_decade(F.col("aum"))), ["bin"], F.col("staff"), {"n": F.lit(1)}, "staff").where("n >= 15")
    return b.withColumn("staff", F.round("staff", 6)).withColumn("middle", F.round(F.pow(F.lit(10.0), F.col("bin") / 2 + 0.25), 4))


@query("w17_aligned_series", "with y as (select distinct year from annual), s as (select crd, string_agg(coalesce(aum::decimal(18, 2)::varchar, '-'), ' ' order by y.year) as series from (select distinct crd from annual) c cross join y left join annual a using (crd, year) group by 1) select crd, series from s")
def w17(t: Tables) -> DataFrame:
    """Yearly values on a common axis, with gaps."""
    a = t.annual().withColumn("aum", F.col("aum").cast("decimal(18,2)").cast("string"))
    s = aligned(a, a.select("year").distinct(), "crd", "year", "aum")
    return s.select("crd", F.array_join(F.transform("series", lambda x: F.coalesce(x, F.lit("-"))), " ").alias("series"))


@query("w18_first_last", "select crd, arg_min(aum, year) filter (aum > 50000) as first, min(year) filter (aum > 50000) as first_year, arg_max(aum, year) filter (aum > 50000) as last, max(year) filter (aum > 50000) as last_year from annual group by 1 having count(*) filter (aum > 50000) > 0")
def w18(t: Tables) -> DataFrame:
    return t.annual().where("aum > 50000").groupBy("crd").agg(F.min_by("aum", "year").alias("first"), F.min("year").alias("first_year"), F.max_by("aum", "year").alias("last"), F.max("year").alias("last_year"))


@query("w19_indexed", "with a as (select * from annual where crd in (select crd from annual group by 1 having count(*) = 7 order by crd limit 4)), y as (select min(year) as year from (select year from a group by 1 having count(*) = (select count(distinct crd) from a))) select crd, a.year, round(aum / (select b.aum from a b, y where b.crd = a.crd and b.year = y.year), 9) as index from a")
def w19(t: Tables) -> DataFrame:
    """Four firms relative to their first common year."""
    a = t.annual()
    chosen = a.groupBy("crd").agg(F.count("*").alias("n")).where("n = 7").orderBy("crd").limit(4).select("crd")
    out = indexed(a.join(chosen, "crd", "left_semi"), "crd", "year", "aum")
    return out.select("crd", "year", F.round("index", 9).alias("index"))


@query("m02_trajectories", "select crd, count(*) as n, arg_max(aum, year) as last from annual semi join firms using (crd) group by 1 having count(aum) >= 2")
def m02(t: Tables) -> DataFrame:
    a = t.annual().join(t.firms().select("crd"), "crd", "left_semi")
    return a.groupBy("crd").agg(F.count("*").alias("n"), F.max_by("aum", "year").alias("last"), F.count("aum").alias("_k")).where("_k >= 2").drop("_k")


@query("s19_first_report_of_year", "select year(filed)::int as year, min(filed) as filed, count(*) as n from filings group by 1")
def s19(t: Tables) -> DataFrame:
    return t.filings().groupBy(F.year("filed").alias("year")).agg(F.min("filed").alias("filed"), F.count("*").alias("n"))


@query("a29_majority_band", "with s as (select crd, sum(aum) filter (kind = '1-URGENT') as urgent, sum(aum) filter (kind = '2-HIGH') as high, sum(aum) as total from filings group by 1) select crd, case when coalesce(urgent, 0) * 2 > total then 'urgent' when coalesce(high, 0) * 2 > total then 'high' else 'mixed' end as segment from s")
def a29(t: Tables) -> DataFrame:
    from ..functions.clean import majority_label

    s = t.filings().groupBy("crd").agg(F.sum(F.when(F.col("kind") == "1-URGENT", F.col("aum"))).alias("urgent"), F.sum(F.when(F.col("kind") == "2-HIGH", F.col("aum"))).alias("high"), F.sum("aum").alias("total"))
    return s.select("crd", majority_label([("urgent", F.col("urgent")), ("high", F.col("high"))], F.col("total")).alias("segment"))
