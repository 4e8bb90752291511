"""Holdings of securities, filed quarterly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.asof import effective
from ..operators.holdings import largest_positions, market_prices, scales
from .fixtures import Tables, query

PRICES = "with prices as (select cusip, median(value / shares) as price, count(*) as n from holdings where value > 0 and shares > 0 group by 1 having count(*) >= 5)"


@query("a17_positions", "select filing_id, cusip, option, round(sum(value), 2) as value, sum(shares) as shares, count(*) as n from holdings group by 1, 2, 3")
def a17(t: Tables) -> DataFrame:
    """A null option is a group of its own."""
    return t.holdings().groupBy("filing_id", "cusip", "option").agg(F.round(F.sum("value"), 2).alias("value"), F.sum("shares").alias("shares"), F.count("*").alias("n"))


@query("a18_market_prices", PRICES + " select cusip, round(price, 6) as price, n from prices")
def a18(t: Tables) -> DataFrame:
    p = market_prices(t.holdings(), "cusip", "value", "shares")
    return p.select("cusip", F.round("price", 6).alias("price"), "n")


@query("a19_modal_period", "select year(filed)::int as period, count(*) as n from filings where status = 'O' group by 1 order by n desc, period desc limit 1")
def a19(t: Tables) -> DataFrame:
    return t.filings().where("status = 'O'").groupBy(F.year("filed").alias("period")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("period")).limit(1)


def scaled(t: Tables) -> DataFrame:
    """Holdings, of some filers in thousands and of some far off."""
    m = F.col("filing_id") % 7
    return t.holdings().withColumn("value", F.when(m == 0, F.col("value") / 1000).when(m == 1, F.col("value") * 37).otherwise(F.col("value")))


SCALED = PRICES + """, h as (select filing_id, cusip, shares, option, case filing_id % 7 when 0 then value / 1000 when 1 then value * 37 else value end as value from holdings), r as (select filing_id, median(value / shares / price) as ratio, count(price) as k from h left join prices using (cusip) where value > 0 and shares > 0 group by 1),
    scales as (select filing_id, case when k < 3 then 1.0 when ratio between 0.5 and 2 then 1.0 when ratio * 1000 between 0.5 and 2 then 1000.0 when ratio * 0.001 between 0.5 and 2 then 0.001 end::double as scale from r)"""


@query("a20_scales", SCALED + " select filing_id, scale from scales")
def a20(t: Tables) -> DataFrame:
    return scales(scaled(t), market_prices(t.holdings(), "cusip", "value", "shares"), "filing_id", "cusip", "value", "shares")


@query("a21_largest_positions", "with p as (select filing_id, cusip, sum(value) as value from holdings where option is null group by 1, 2) select filing_id, cusip, round(value, 2) as value, round(value * 100 / sum(value) over (partition by filing_id), 6) as percent, (row_number() over (partition by filing_id order by value desc, cusip))::int as place from p qualify place <= 10")
def a21(t: Tables) -> DataFrame:
    return largest_positions(t.holdings(), "filing_id", "cusip", "value", "option").select("filing_id", "cusip", F.round("value", 2).alias("value"), F.round("percent", 6).alias("percent"), "place")


@query("r04_effective_filings", """with b as (select crd, max({'filed': filed, 'id': filing_id}) as base from filings where status in ('O', 'F') group by 1) select f.crd, f.filing_id, f.status from filings f join b using (crd)
    where ({'filed': filed, 'id': filing_id} = base and status in ('O', 'F')) or ({'filed': filed, 'id': filing_id} >= base and status = 'P')""")
def r04(t: Tables) -> DataFrame:
    """The latest original or restatement, and additions at or after it."""
    return effective(t.filings(), "crd", "status", ["filed", "filing_id"], ["O", "F"], ["P"]).select("crd", "filing_id", "status")


@query("r05_holdings_export", SCALED + """, e as (select crd, max({'filed': filed, 'id': filing_id}) as base from filings where status in ('O', 'F') group by 1), f as (select f.crd, f.filing_id from filings f join e using (crd) where ({'filed': filed, 'id': filing_id} = base and status in ('O', 'F')) or ({'filed': filed, 'id': filing_id} >= base and status = 'P')),
    p as (select crd, cusip, sum(value * scale) as value from f join h using (filing_id) join scales using (filing_id) where option is null and scale is not null group by 1, 2)
    select crd, count(*) as positions, round(sum(value), 2) as value, arg_max(cusip, {'v': value, 'c': -cusip}) as largest from p group by 1""")
def r05(t: Tables) -> DataFrame:
    """Positions of effective filings in dollars; filers whose scale can't be told are left out."""
    f = effective(t.filings(), "crd", "status", ["filed", "filing_id"], ["O", "F"], ["P"]).select("crd", "filing_id")
    s = scales(scaled(t), market_prices(t.holdings(), "cusip", "value", "shares"), "filing_id", "cusip", "value", "shares").where("scale is not null")
    h = scaled(t).where("option is null").join(s, "filing_id").join(f, "filing_id")
    p = h.groupBy("crd", "cusip").agg(F.sum(F.col("value") * F.col("scale")).alias("value"))
    return p.groupBy("crd").agg(F.count("*").alias("positions"), F.round(F.sum("value"), 2).alias("value"), F.max_by("cusip", F.struct("value", -F.col("cusip"))).alias("largest"))


@query("j03_cover_summary", "with s as (select filing_id, sum(value) as total, count(*) as entries from holdings where filing_id % 3 <> 0 group by 1) select f.filing_id, f.crd, name, round(total, 2) as total, entries from filings f join firms using (crd) left join s on s.filing_id = f.filing_id")
def j03(t: Tables) -> DataFrame:
    """Submissions with covers, and summaries where filed."""
    s = t.holdings().where("filing_id % 3 <> 0").groupBy("filing_id").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("entries"))
    return t.filings().join(t.firms().select("crd", "name"), "crd").join(s, "filing_id", "left").select("filing_id", "crd", "name", "total", "entries")


@query("m13_own_or_parent", "with h as (select filing_id % 1000 as cik, sum(value) as value from holdings group by 1) select crd, round(coalesce(o.value, p.value), 2) as value, case when o.value is not null then 'own' when p.value is not null then 'parent' end as via from firms left join h o on o.cik = crd left join h p on p.cik = crd // 10")
def m13(t: Tables) -> DataFrame:
    h = t.holdings().groupBy((F.col("filing_id") % 1000).alias("cik")).agg(F.sum("value").alias("value"))
    own, parent = h.select(F.col("cik").alias("crd"), F.col("value").alias("own")), h.select(F.col("cik").alias("_p"), F.col("value").alias("parent"))
    f = t.firms().select("crd", F.floor(F.col("crd") / 10).alias("_p")).join(own, "crd", "left").join(parent, "_p", "left")
    return f.select("crd", F.round(F.coalesce("own", "parent"), 2).alias("value"), F.when(F.col("own").isNotNull(), "own").when(F.col("parent").isNotNull(), "parent").alias("via"))
