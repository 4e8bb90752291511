"""Funds, their providers, and exempt offerings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import provider_key, suffix_stripped
from ..operators.asof import latest, latest_group, snapshots, top
from ..operators.ranks import one_if, with_median
from ..operators.resolve import league_table
from .fixtures import Tables, query

LATEST = "with latest as (select * from funds qualify row_number() over (partition by fund_id order by filed desc, filing_id desc, line, gav desc, role, qty, provider) = 1)"


def latest_funds(t: Tables) -> DataFrame:
    """The latest filing's row of each fund."""
    order = [F.desc("filed"), F.desc("filing_id"), F.col("line"), F.desc("gav"), F.col("role"), F.col("qty"), F.col("provider")]
    return latest(t.funds(), ["fund_id"], order)


@query("w01_latest_funds", LATEST + " select fund_id, filing_id, crd, type, gav, feeder from latest")
def w01(t: Tables) -> DataFrame:
    return latest_funds(t).select("fund_id", "filing_id", "crd", "type", "gav", "feeder")


@query("a05_fund_types", LATEST + " select type, count(*) filter (not feeder) as n, round(sum(gav) filter (not feeder), 2) as gav, round(median(gav) filter (not feeder), 4) as median_gav, count(*) filter (feeder) as feeders from latest group by 1")
def a05(t: Tables) -> DataFrame:
    """A null feeder flag counts on neither side."""
    own = F.when(~F.col("feeder"), F.col("gav"))
    out = with_median(latest_funds(t), ["type"], own, {"n": one_if(own.isNotNull()), "gav": own, "feeders": one_if(F.col("feeder"))})
    return out.select("type", "n", F.round("gav", 2).alias("gav"), F.round("median", 4).alias("median_gav"), "feeders")


@query("a06_domiciles", LATEST + """, d as (select coalesce(nullif(state, ''), region) as domicile, count(*) as n, sum(gav) as gav from latest join firms using (crd) where feeder is not true group by 1 order by n desc, domicile nulls last limit 10) select domicile, n, round(gav, 2) as gav from d where domicile is not null""")
def a06(t: Tables) -> DataFrame:
    """The limit comes before nulls are dropped."""
    f = latest_funds(t).where(~F.coalesce("feeder", F.lit(False))).join(t.firms().select("crd", "state", "region"), "crd")
    d = f.groupBy(F.coalesce(F.nullif("state", F.lit("")), "region").alias("domicile")).agg(F.count("*").alias("n"), F.round(F.sum("gav"), 2).alias("gav"))
    return d.orderBy(F.desc("n"), F.asc_nulls_last("domicile")).limit(10).where("domicile is not null")


@query("a07_top_advisers", LATEST + ", a as (select crd, count(*) as n, sum(gav) as gav from latest where feeder is not true group by 1) select crd, name, n, round(gav, 2) as gav from a left join firms using (crd) order by n desc, gav desc, crd limit 15")
def a07(t: Tables) -> DataFrame:
    """Advisers with most funds, with names where known."""
    a = latest_funds(t).where(~F.coalesce("feeder", F.lit(False))).groupBy("crd").agg(F.count("*").alias("n"), F.sum("gav").alias("gav"))
    return a.join(t.firms().select("crd", "name"), "crd", "left").orderBy(F.desc("n"), F.desc("gav"), "crd").limit(15).select("crd", "name", "n", F.round("gav", 2).alias("gav"))


@query("a08_global_counts", LATEST + " select count(*) filter (feeder is not true) as funds, count(distinct crd) as advisers from latest")
def a08(t: Tables) -> DataFrame:
    return latest_funds(t).agg(F.count_if(~F.coalesce("feeder", F.lit(False))).alias("funds"), F.countDistinct("crd").alias("advisers"))


@query("a09_fund_quarters", """with s as (select q.quarter, f.* from quarters q join funds f on f.filed <= q.quarter and f.filed >= (q.quarter - interval 15 months)::date qualify row_number() over (partition by fund_id, quarter order by f.filed desc, filing_id desc, line, gav desc, role, qty, provider) = 1)
    select quarter, type, count(*) as n, round(sum(gav), 2) as gav from s group by rollup (quarter, type) having quarter is not null""")
def a09(t: Tables) -> DataFrame:
    """Funds by quarter and type, and in all; J11 by fund."""
    f = t.funds().withColumns({"_1": -F.col("line"), "_2": F.col("gav"), "_3": F.ascii("role") * -1, "_4": -F.col("qty"), "_5": -F.col("provider")})
    s = snapshots(f, "fund_id", "filed", ["filing_id", "_1", "_2", "_3", "_4", "_5"], 15).where(F.col("quarter") <= t.filings().agg(F.max("filed")).scalar())
    return s.rollup("quarter", "type").agg(F.count("*").alias("n"), F.round(F.sum("gav"), 2).alias("gav")).where("quarter is not null")


@query("w03_top_funds", LATEST + " select crd, fund_id, gav, (row_number() over (partition by crd order by gav desc nulls last, fund_id))::int as place from latest qualify place <= 20")
def w03(t: Tables) -> DataFrame:
    return top(latest_funds(t), ["crd"], [F.desc_nulls_last("gav"), F.col("fund_id")], 20, "place").select("crd", "fund_id", "gav", "place")


@query("w02_latest_owner_rows", "select crd, filing_id, owner, stake, line from owners qualify dense_rank() over (partition by crd order by filed desc, filing_id desc) = 1")
def w02(t: Tables) -> DataFrame:
    return latest_group(t.owners(), ["crd"], [F.desc("filed"), F.desc("filing_id")]).select("crd", "filing_id", "owner", "stake", "line")


@query("a28_majority_type", LATEST + """, g as (select crd, type, sum(gav) as gav, count(*) as n from latest where feeder is not true group by 1, 2), t as (select *, sum(gav) over (partition by crd) as total, sum(n) over (partition by crd) as n_total from g)
    select crd, coalesce(max(case when case when total > 0 then gav * 2 > total else n * 2 > n_total end then type end), 'mixed') as type from t group by 1""")
def a28(t: Tables) -> DataFrame:
    """The type with more than half of a firm's value, by counts where there is no value."""
    g = latest_funds(t).where(~F.coalesce("feeder", F.lit(False))).groupBy("crd", "type").agg(F.sum("gav").alias("gav"), F.count("*").alias("n"))
    w = Window.partitionBy("crd")
    g = g.withColumns({"total": F.sum("gav").over(w), "n_total": F.sum("n").over(w)})
    most = F.when(F.col("total") > 0, F.col("gav") * 2 > F.col("total")).otherwise(F.col("n") * 2 > F.col("n_total"))
    return g.groupBy("crd").agg(F.coalesce(F.max(F.when(most, F.col("type"))), F.lit("mixed")).alias("type"))


@query("j02_winning_providers", LATEST + " select distinct l.fund_id, l.filing_id, f.role, f.provider from latest l join funds f on f.filing_id = l.filing_id and f.line = l.line")
def j02(t: Tables) -> DataFrame:
    """Providers of the winning filing, by both keys."""
    return latest_funds(t).select("fund_id", "filing_id", "line").join(t.dealt(t.funds().select("filing_id", "line", "role", "provider"), "lineitem", "filing_id", "line"), ["filing_id", "line"]).select("fund_id", "filing_id", "role", "provider").distinct()


@query("j14_nested_providers", LATEST + """, p as (select distinct filing_id, line, role, provider from funds), n as (select filing_id, line, string_agg(role || ':' || provider, ',' order by role, provider) as providers from p group by 1, 2)
    select fund_id, coalesce(providers, '') as providers from latest left join n using (filing_id, line)""")
def j14(t: Tables) -> DataFrame:
    """Each fund with its providers nested."""
    n = t.dealt(t.funds().select("filing_id", "line", "role", "provider"), "lineitem", "filing_id", "line").groupBy("filing_id", "line").agg(F.array_sort(F.collect_set(F.struct("role", "provider"))).alias("providers"))
    text = F.array_join(F.transform("providers", lambda p: F.concat(p["role"], F.lit(":"), p["provider"])), ",")
    return latest_funds(t).select("fund_id", "filing_id", "line").join(n, ["filing_id", "line"], "left").select("fund_id", F.coalesce(text, F.lit("")).alias("providers"))


@query("a14_league_table", """with p as (select f.*, s_name as name from funds f join supplier on s_suppkey = provider), k as (select *, substr(name, 10)::bigint % 37 as key from p),
    c as (select role, key, name, count(*) as n from k group by 1, 2, 3), s as (select role, key, arg_min(name, {'n': -n, 'name': name}) as spelling, count(*) as variants from c group by 1, 2),
    a as (select role, key, count(distinct crd) as firms, count(*) as funds, sum(gav) filter (feeder is not true) as value from k group by 1, 2)
    select role, key, firms, funds, round(value, 2) as value, spelling, variants, (row_number() over (partition by role order by firms desc, funds desc, spelling, key))::int as place from a join s using (role, key) qualify place <= 40""")
def a14(t: Tables) -> DataFrame:
    """Providers of each role by firms served."""
    s = t.raw("supplier").select(F.col("s_suppkey").alias("provider"), F.col("s_name").alias("name"))
    p = t.funds().join(s, "provider").withColumn("key", F.substring("name", 10, 9).cast("long") % 37)
    return league_table(p, "role", "key", "name", "crd", "gav", "feeder").select("role", "key", "firms", "funds", F.round("value", 2).alias("value"), "spelling", "variants", "place")


@query("a11_offering_quarters", "select (date_trunc('quarter', filed) + interval 3 months - interval 1 day)::date as quarter, count(*) as n, round(sum(sold), 2) as sold, round(median(sold) filter (sold > 0), 4) as median_sold, count(*) filter (pooled) as pooled, count(*) filter (sold = 0) as nothing from offerings where amendment is not true group by 1")
def a11(t: Tables) -> DataFrame:
    """A null amendment flag counts as none."""
    o = t.offerings().where(~F.coalesce("amendment", F.lit(False)))
    q = F.last_day(F.add_months(F.trunc("filed", "quarter"), 2))
    sums = {"n": F.lit(1), "sold": F.col("sold"), "pooled": one_if(F.col("pooled")), "nothing": one_if(F.col("sold") == 0)}
    out = with_median(o.withColumn("quarter", q), ["quarter"], F.when(F.col("sold") > 0, F.col("sold")), sums, "median_sold")
    return out.select("quarter", "n", F.round("sold", 2).alias("sold"), F.round("median_sold", 4).alias("median_sold"), "pooled", "nothing")


@query("a12_offering_industries", "select industry, count(*) as n, round(sum(sold), 2) as sold from offerings where amendment is not true group by 1 order by n desc, industry limit 10")
def a12(t: Tables) -> DataFrame:
    o = t.offerings().where(~F.coalesce("amendment", F.lit(False)))
    return o.groupBy("industry").agg(F.count("*").alias("n"), F.round(F.sum("sold"), 2).alias("sold")).orderBy(F.desc("n"), "industry").limit(10)


@query("a13_placement_agents", """with r as (select l_orderkey as accession, s_name as name, s_suppkey % 23 as key, nullif(s_nationkey, 5) as agent from lineitem join supplier on l_suppkey = s_suppkey),
    n as (select key, name, count(distinct accession) as n, min(agent) as agent from r group by 1, 2)
    select key, sum(n)::bigint as offerings, arg_min(name, {'n': -n, 'name': name}) as spelling, min(agent) as agent from n group by 1""")
def a13(t: Tables) -> DataFrame:
    """Offerings by spelling, then by key; the most frequent spelling is shown."""
    s = t.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 23).alias("key"), F.nullif("s_nationkey", F.lit(5)).alias("agent"))
    n = t.raw("lineitem").select("l_orderkey", "l_suppkey").join(s, "l_suppkey").groupBy("key", "name").agg(F.countDistinct("l_orderkey").alias("n"), F.min("agent").alias("agent"))
    return n.groupBy("key").agg(F.sum("n").alias("offerings"), F.min_by("name", F.struct(-F.col("n"), "name")).alias("spelling"), F.min("agent").alias("agent"))


@query("a35_completeness", "select count(distinct crd) as firms, count(*) as n, count(*) filter (amendment) as amendments from offerings")
def a35(t: Tables) -> DataFrame:
    return t.offerings().agg(F.countDistinct("crd").alias("firms"), F.count("*").alias("n"), F.count_if("amendment").alias("amendments"))


@query("f06_provider_keys", """with n as (select s_suppkey, case s_suppkey % 5 when 0 then s_name || ', L.L.C.' when 1 then 'The ' || s_name || ' Company, Inc.' when 2 then lower(s_name) || ' & Co' when 3 then s_name || ' LLC, LTD.' else 'J. P. ' || s_name || ' N.A.' end as name from supplier)
    select s_suppkey, name, case s_suppkey % 5 when 1 then 'THE ' || upper(s_name) || ' COMPANY' when 2 then upper(s_name) || ' & CO' when 4 then 'J. P. ' || upper(s_name) || ' N.A.' else upper(s_name) end as stripped, case s_suppkey % 5 when 1 then 'THE' when 4 then 'JP' else '' end || upper(replace(s_name, '#', '')) as key from n join supplier using (s_suppkey)""")
def f06(t: Tables) -> DataFrame:
    """spellings without legal forms, and keys without general words."""
    k, s = F.col("s_suppkey") % 5, F.col("s_name")
    name = F.when(k == 0, F.concat(s, F.lit(", L.L.C."))).when(k == 1, F.concat(F.lit("The "), s, F.lit(" Company, Inc."))).when(k == 2, F.concat(F.lower(s), F.lit(" & Co"))).when(k == 3, F.concat(s, F.lit(" LLC, LTD."))).otherwise(F.concat(F.lit("J. P. "), s, F.lit(" N.A.")))
    return t.raw("supplier").select("s_suppkey", name.alias("name")).select("s_suppkey", "name", suffix_stripped(F.col("name")).alias("stripped"), provider_key(F.col("name")).alias("key"))
