"""Cleaning of filed values, on values made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean as c
from .fixtures import Tables, query


@query("f01_numbers", "select c_custkey as k, case c_custkey % 6 when 0 then null when 1 then null when 2 then round(c_acctbal, 2) when 3 then round(c_acctbal, 2) when 4 then null else c_custkey::double end as v from customer")
def f01(t: Tables) -> DataFrame:
    """what isn't a plain number is null."""
    k, plain = F.col("c_custkey") % 6, F.format_string("%.2f", "c_acctbal")
    raw = F.when(k == 0, "-").when(k == 1, " ").when(k == 2, F.concat(F.lit(" $"), plain, F.lit(" "))).when(k == 3, plain).when(k == 4, F.concat(plain, F.lit("d"))).otherwise(F.format_number("c_custkey", 0))
    return t.raw("customer").select(F.col("c_custkey").alias("k"), c.to_number(raw).alias("v"))


@query("f02_booleans", "select c_custkey as k, case c_custkey % 5 when 0 then true when 1 then false when 2 then true when 3 then false end as b, c_custkey % 5 = 0 as y, c_custkey % 5 in (0, 2) as yes from customer")
def f02(t: Tables) -> DataFrame:
    """several ways to file yes and no."""
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, " y").when(k == 1, "No").when(k == 2, "TRUE").when(k == 3, "").otherwise("maybe")
    return t.raw("customer").select(F.col("c_custkey").alias("k"), c.to_bool(raw).alias("b"), c.is_y(raw).alias("y"), c.is_yes(raw).alias("yes"))


@query("f04_percent_ranges", "select c_custkey as k, case c_custkey % 5 when 0 then 18.0 when 1 then 87.5 when 2 then 0.0 when 3 then (c_custkey % 100)::double end as v from customer")
def f04(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, "11-25%").when(k == 1, "76-99%").when(k == 2, "None").when(k == 3, F.concat((F.col("c_custkey") % 100).cast("string"), F.lit("%"))).otherwise("n/a")
    return t.raw("customer").select(F.col("c_custkey").alias("k"), c.percent_midpoint(raw).alias("v"))


@query("f16_dates", "select o_orderkey as k, o_orderdate::date as d, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y') when 1 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y-%m-%d') end as partial from orders")
def f16(t: Tables) -> DataFrame:
    """F16: full dates in several forms, and partial ones as ISO prefixes."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    full = F.when(k == 0, F.upper(F.date_format(d, "dd-MMM-yyyy"))).when(k == 1, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    partial = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    return t.raw("orders").select(F.col("o_orderkey").alias("k"), c.filed_date(full).alias("d"), c.partial_iso(partial).alias("partial"))


@query("f17_months_back", "select o_orderkey as k, (o_orderdate::date - interval 15 months)::date as d, 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) as q from orders")
def f17(t: Tables) -> DataFrame:
    """months back clamp at the month's end."""
    return t.raw("orders").select(F.col("o_orderkey").alias("k"), F.add_months("o_orderdate", -15).alias("d"), c.quarter_label(F.col("o_orderdate")).alias("q"))


@query("f19_clean_text", "with t as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents), c as (select doc_id, case when upper(t) not in ('', 'N/A', 'NA', 'NONE') then t end as t from t) select doc_id, case when length(t) <= 60 then t else regexp_replace(t[1:60], '\\s+\\S*$', '') || '…' end as t from c")
def f19(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", c.clean_text(F.col("text"), 60).alias("t"))


@query("f20_positive", "select c_custkey as k, case when c_acctbal > 0 then c_acctbal end as v from customer")
def f20(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.col("c_custkey").alias("k"), c.positive(F.col("c_acctbal")).alias("v"))


@query("f21_first_filled", "select c_custkey as k, coalesce(case when c_custkey % 2 = 0 then c_mktsegment end, c_name) as v from customer")
def f21(t: Tables) -> DataFrame:
    return t.raw("customer").select(F.col("c_custkey").alias("k"), c.first_filled(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" "), F.lit(None).cast("string"), F.col("c_name")).alias("v"))


@query("f22_content_keys", "select kind, key, count(*) as n from (select event_type as kind, substr(props, 1, 160) || '|' || (user_id % 10) as key from events) group by 1, 2")
def f22(t: Tables) -> DataFrame:
    key = F.concat_ws("|", F.substring("props", 1, 160), (F.col("user_id") % 10).cast("string"))
    return t.raw("events").groupBy(F.col("event_type").alias("kind"), key.alias("key")).agg(F.count("*").alias("n"))


@query("f24_rounding", "select o_orderkey as k, round_even(o_totalprice / 1000000, 1) as m, round_even(o_orderkey / 2, 0)::bigint as half, floor(o_orderkey / 2 + 0.5)::bigint as up from orders")
def f24(t: Tables) -> DataFrame:
    """half to even for one, half up for the other."""
    k = F.col("o_orderkey")
    return t.raw("orders").select(k.alias("k"), F.bround(F.col("o_totalprice") / 1e6, 1).alias("m"), F.bround(k / 2, 0).cast("long").alias("half"), F.floor(k / 2 + 0.5).alias("up"))


SIZES = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))
USD = "case " + " ".join(f"when v >= {x!r} then '$' || case when v / {x!r} < 10 then printf('%.1f', round_even(v / {x!r}, 1)) else printf('%.0f', round_even(v / {x!r}, 0)) end || '{sign}'" for x, sign in SIZES) + " else '$' || printf('%.0f', round_even(v, 0)) end"


@query("f25_formats", f"with c as (select c_custkey as k, (c_custkey * c_custkey * 7.0)::double as v from customer) select k, k || case when k % 100 between 11 and 13 then 'th' when k % 10 = 1 then 'st' when k % 10 = 2 then 'nd' when k % 10 = 3 then 'rd' else 'th' end as place, {USD} as usd from c")
def f25(t: Tables) -> DataFrame:
    """amounts of up to ten digits, all sizes of them."""
    k = F.col("c_custkey")
    return t.raw("customer").select(k.alias("k"), c.ordinal(k).alias("place"), c.compact_usd((k * k * 7.0).cast("double")).alias("usd"))


@query("f08_gentle_names", "select s_suppkey as k, trim(regexp_replace(upper(s_name || ' & Co., L.L.C. ' || (s_suppkey % 3)), '[^A-Z0-9]+', ' ', 'g')) as name from supplier")
def f08(t: Tables) -> DataFrame:
    """legal forms stay."""
    return t.raw("supplier").select(F.col("s_suppkey").alias("k"), c.gentle_name(F.concat(F.col("s_name"), F.lit(" & Co., L.L.C. "), (F.col("s_suppkey") % 3).cast("string"))).alias("name"))


CASED = "array_to_string(list_transform(regexp_extract_all(lower({0}), '([a-z]+|[^a-z]+)'), lambda x: upper(x[1]) || x[2:]), '')"


@query("f23_cased_names", f"select n_nationkey as k, {CASED.format(chr(39) + 'O' + chr(39) * 2 + chr(39) + ' || n_name || ' + chr(39) + '-smith jr ' + chr(39) + ' || n_nationkey')} as name from nation")
def f23(t: Tables) -> DataFrame:
    """O'Brien-Smith."""
    return t.raw("nation").select(F.col("n_nationkey").alias("k"), c.cased_name(F.concat(F.lit("O'"), F.col("n_name"), F.lit("-smith jr "), F.col("n_nationkey").cast("string"))).alias("name"))


@query("f26_tags", "select crd, array_to_string(list_filter([case when aum > 5000 then 'large' end, case when mix in ('BUILDING', 'MACHINERY') then 'industry' end, case when regexp_matches(name, '7$') then 'seven' end], lambda x: x is not null), ',') as tags from firms")
def f26(t: Tables) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.col("aum") > 5000, "large"), F.when(F.col("mix").isin("BUILDING", "MACHINERY"), "industry"), F.when(F.rlike("name", F.lit("7$")), "seven")))
    return t.firms().select("crd", F.array_join(tags, ",").alias("tags"))


@query("f27_largest_group", "with s as (select o_custkey as crd, sum(o_totalprice) filter (o_orderstatus = 'O') as o, sum(o_totalprice) filter (o_orderstatus = 'F') as f, sum(o_totalprice) filter (o_orderstatus = 'P') as p from orders group by 1) select crd, case when coalesce(o, 0) >= greatest(coalesce(f, 0), coalesce(p, 0)) then 'open' when coalesce(f, 0) >= coalesce(p, 0) then 'final' else 'pending' end as mix from s")
def f27(t: Tables) -> DataFrame:
    sums = [F.sum(F.when(F.col("o_orderstatus") == k, F.col("o_totalprice"))).alias(k) for k in "OFP"]
    s = t.raw("orders").groupBy(F.col("o_custkey").alias("crd")).agg(*sums)
    return s.select("crd", c.largest_label([("open", F.col("O")), ("final", F.col("F")), ("pending", F.col("P"))]).alias("mix"))


@query("f31_labels", "select l_returnflag as stake, l_linestatus as title, case when l_returnflag = 'R' and l_linestatus = 'F' then 'returned' when l_returnflag = 'A' then 'accepted' else 'unknown' end as label, count(*) as n from lineitem group by 1, 2")
def f31(t: Tables) -> DataFrame:
    """a label by a pair of codes."""
    pairs = t.spark.createDataFrame([("R", "F", "returned"), ("A", "F", "accepted"), ("A", "O", "accepted")], "stake string, title string, label string")
    g = t.raw("lineitem").groupBy(F.col("l_returnflag").alias("stake"), F.col("l_linestatus").alias("title")).agg(F.count("*").alias("n"))
    return g.join(F.broadcast(pairs), ["stake", "title"], "left").select("stake", "title", F.coalesce("label", F.lit("unknown")).alias("label"), "n")  # three rows are broadcast


@query("a31_yes_counts", "select c_custkey as k, (c_custkey % 2 = 0)::int + (c_custkey % 3 = 0)::int + (c_custkey % 5 = 0)::int as n from customer")
def a31(t: Tables) -> DataFrame:
    """How many of several columns say yes."""
    cols = [F.when(F.col("c_custkey") % m == 0, "Y").otherwise("N") for m in (2, 3, 5)]
    return t.raw("customer").select(F.col("c_custkey").alias("k"), F.aggregate(F.array(*[c.is_yes(x).cast("int") for x in cols]), F.lit(0), lambda a, x: a + x).alias("n"))


@query("a32_client_mix", "with s as (select o_custkey as crd, count(*) filter (o_orderpriority = '1-URGENT') as u, count(*) filter (o_orderpriority = '2-HIGH') as h, count(*) as n from orders group by 1) select crd, round_even(u * 100 / n, 1) as pct_urgent, round_even(h * 100 / n, 1) as pct_high, round_even((n - u - h) * 100 / n, 1) as pct_other from s")
def a32(t: Tables) -> DataFrame:
    s = t.raw("orders").groupBy(F.col("o_custkey").alias("crd")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"), F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("h"), F.count("*").alias("n"))
    share = lambda x: F.bround(x * 100 / F.col("n"), 1)
    return s.select("crd", share(F.col("u")).alias("pct_urgent"), share(F.col("h")).alias("pct_high"), share(F.col("n") - F.col("u") - F.col("h")).alias("pct_other"))
