"""Percentiles, cohorts, top and outlier lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import band
from ..operators.cohort import in_cohort
from ..operators.methodology import LEAST_COHORT, METHODS, outlier_firms, top_firms
from ..operators.ranks import at_or_below, below, mid_rank, ranked
from ..operators.stats import exact_avg, quantiles, upper_median
from .fixtures import Tables, query

BAND = "case when coalesce(aum, 0) < 2000 then 's' when coalesce(aum, 0) < 6000 then 'm' else 'l' end"
FIRMS = f"""with o as (select crd, count(*) as orders, avg(aum) as per_order, avg(case when filed >= date '2000-01-01' then 1.0 else 0.0 end) as late_share from filings group by 1),
    u as (select f.*, {BAND} as band, coalesce(orders, 0) as orders, per_order, late_share from firms f left join o using (crd))"""


def universe(t: Tables) -> DataFrame:
    """Firms with their bands and what their filings tell."""
    o = t.filings().groupBy("crd").agg(F.count("*").alias("orders"), exact_avg("aum").alias("per_order"), F.avg((F.col("filed") >= F.lit("2000-01-01").cast("date")).cast("double")).alias("late_share"))
    f = t.firms().withColumn("band", band(F.col("aum"), [2000.0, 6000.0], ["s", "m", "l"]))
    return f.join(o, "crd", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


@query("w05_w06_shares", FIRMS + " select crd, round(case when count(aum) over (partition by mix) >= 2 then cume_dist() over (partition by mix order by aum) else 0 end, 9) as at_or_below, round(percent_rank() over (partition by mix order by orders), 9) as below from u")
def w05(t: Tables) -> DataFrame:
    """Of a group of fewer than two values the first share is 0."""
    u = ranked(universe(t).select("crd", "mix", "aum", "orders"), {"a": ("aum", ["mix"]), "o": ("orders", ["mix"])})
    return u.select("crd", F.round(F.when(F.col("a.total") >= 2, at_or_below("a")).otherwise(0.0), 9).alias("at_or_below"), F.round(below("o"), 9).alias("below"))


@query("w07_mid_ranks", FIRMS + " select crd, round_even((rank() over (partition by mix order by orders) - 1 + count(*) over (partition by mix, orders) / 2) / count(*) over (partition by mix) * 100, 0)::bigint as percentile from u")
def w07(t: Tables) -> DataFrame:
    return ranked(universe(t).select("crd", "mix", "orders"), {"o": ("orders", ["mix"])}).select("crd", mid_rank("o").alias("percentile"))


@query("w08_quantiles", FIRMS + " select mix, round(quantile_cont(aum, 0.05), 6) as p5, round(quantile_cont(aum, 0.25), 6) as p25, round(quantile_cont(aum, 0.5), 6) as p50, round(quantile_cont(aum, 0.75), 6) as p75, round(quantile_cont(aum, 0.95), 6) as p95 from u group by 1")
def w08(t: Tables) -> DataFrame:
    q = universe(t).groupBy("mix").agg(quantiles("aum", [0.05, 0.25, 0.5, 0.75, 0.95]).alias("q"))
    return q.select("mix", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))])


LEVEL = "case when mix is not null and region is not null and count(*) over (partition by band, mix, region) >= 10 then 3 when mix is not null and count(*) over (partition by band, mix) >= 10 then 2 when count(*) over (partition by band) >= 10 then 1 else 0 end"
NULLED = FIRMS + ", v as (select u.* replace (nullif(region, 'ASIA') as region, nullif(mix, 'BUILDING') as mix, case when name like '%7' then null else aum end as aum) from u), l as (select *, " + LEVEL + " as level from v)"


def nulled(t: Tables) -> DataFrame:
    """The universe with unknown regions, mixes and values."""
    u = universe(t)
    return u.withColumns({"region": F.nullif("region", F.lit("ASIA")), "mix": F.nullif("mix", F.lit("BUILDING")), "aum": F.when(~F.endswith("name", F.lit("7")), F.col("aum"))})


LEVELS = [["band"], ["band", "mix"], ["band", "mix", "region"]]


@query("w09_cohort_rank", NULLED + """ select crd, level, round(case when aum is null then null else case level when 3 then cume_dist() over (partition by band, mix, region, aum is null order by aum) when 2 then cume_dist() over (partition by band, mix, aum is null order by aum)
    when 1 then cume_dist() over (partition by band, aum is null order by aum) else cume_dist() over (partition by aum is null order by aum) end end, 9) as share from l""")
def w09(t: Tables) -> DataFrame:
    """Rank in the deepest cohort of ten or more."""
    return in_cohort(nulled(t), {"share": "aum"}, LEVELS, 10, level="level").select("crd", "level", F.round("share", 9).alias("share"))


@query("w10_peer_fallback", NULLED + " select crd, case when mix is not null and count(*) over (partition by mix, band) >= 30 then 'narrow' else 'wide' end as peers, round(case when mix is not null and count(*) over (partition by mix, band) >= 30 then percent_rank() over (partition by mix, band order by orders) else percent_rank() over (partition by mix order by orders) end, 9) as share from l")
def w10(t: Tables) -> DataFrame:
    """Rank in the segment's band of thirty or more, else in the segment; an unknown segment is one too."""
    u = nulled(t).withColumn("segment", F.coalesce("mix", F.lit("")))
    out = in_cohort(u, {"share": "orders"}, [["segment"], ["mix", "band"]], [1, 30], lower=True, level="level")
    return out.select("crd", F.when(F.col("level") == 2, "narrow").otherwise("wide").alias("peers"), F.round("share", 9).alias("share"))


@query("w11_compare_strip", FIRMS + """, c as (select *, count(*) over (partition by band, mix) as n2, count(*) over (partition by band) as n1 from u)
    select crd, round(case when n2 >= 10 then cume_dist() over (partition by band, mix order by orders) when n1 >= 10 then cume_dist() over (partition by band order by orders) end, 9) as share from c""")
def w11(t: Tables) -> DataFrame:
    """No rank where even the band is too small."""
    u = universe(t)
    return in_cohort(u, {"share": "orders"}, [["band"], ["band", "mix"]], 10, whole=False).select("crd", F.round("share", 9).alias("share"))


RATED = """with o as (select crd, count(*) as orders from filings group by 1), u as (select f.crd, f.name, aum * 5000000.0 as aum_total, case when f.crd % 11 <> 0 then (f.crd % 40)::int end as employees_advisory, (f.crd % 90)::int as employees_total, coalesce(orders, 0) * (f.crd % 17) as accounts_total,
    case when f.crd % 13 <> 0 then f.crd % 3 <> 0 end as fee_pct_of_aum, f.crd % 4 = 0 as fee_commissions, f.crd % 10 < 3 as fee_performance_based, (f.crd % 6)::int as affil_count, case when f.crd % 29 <> 0 then greatest(0, f.crd % 8 - 4)::int end as disciplinary_flag_count,
    case when f.crd % 19 <> 0 then (f.crd % 100) / 100.0 end as pct_clients_individuals, case when f.crd % 23 <> 0 then (f.crd % 37) / 100.0 end as pct_clients_hnw_individuals, case when coalesce(aum, 0) < 2000 then 's' when coalesce(aum, 0) < 6000 then 'm' else 'l' end as aum_band, nullif(mix, 'BUILDING') as client_mix, region,
    (f.crd % 60)::int as advisors, (f.crd % 7)::int as flagged_advisors, case when f.crd % 9 = 0 then (f.crd % 5)::int else 0 end as recent_events from firms f left join o using (crd)), s as (select *, coalesce(employees_advisory, employees_total) as staff, coalesce(disciplinary_flag_count, 0) as flags from u)"""


def rated(t: Tables) -> DataFrame:
    """Firms with what the methodology looks at."""
    crd, k = F.col("crd"), lambda n: F.col("crd") % n
    f = t.firms().join(t.filings().groupBy("crd").agg(F.count("*").alias("orders")), "crd", "left")
    return f.select(
        "crd", "name", (F.col("aum") * 5000000.0).alias("aum_total"), F.when(k(11) != 0, k(40).cast("int")).alias("employees_advisory"), k(90).cast("int").alias("employees_total"), (F.coalesce("orders", F.lit(0)) * k(17)).alias("accounts_total"),
        F.when(k(13) != 0, k(3) != 0).alias("fee_pct_of_aum"), (k(4) == 0).alias("fee_commissions"), (k(10) < 3).alias("fee_performance_based"), k(6).cast("int").alias("affil_count"), F.when(k(29) != 0, F.greatest(F.lit(0), k(8) - 4).cast("int")).alias("disciplinary_flag_count"),
        F.when(k(19) != 0, k(100) / 100.0).alias("pct_clients_individuals"), F.when(k(23) != 0, k(37) / 100.0).alias("pct_clients_hnw_individuals"), band(F.col("aum"), [2000.0, 6000.0], ["s", "m", "l"]).alias("aum_band"), F.nullif("mix", F.lit("BUILDING")).alias("client_mix"), "region",
        k(60).cast("int").alias("advisors"), k(7).cast("int").alias("flagged_advisors"), F.when(crd % 9 == 0, k(5)).otherwise(0).cast("int").alias("recent_events"),
    )


def compact_sql(v: str) -> str:
    sizes = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))
    return "case " + " ".join(f"when {v} >= {x!r} then '$' || case when {v} / {x!r} < 10 then printf('%.1f', round_even({v} / {x!r}, 1)) else printf('%.0f', round_even({v} / {x!r}, 0)) end || '{sign}'" for x, sign in sizes) + f" else '$' || printf('%.0f', round_even({v}, 0)) end"


# The factors and signals of the methodology in SQL, from its published rule.
FACTORS = {
    "scale": "aum_total", "productivity": "case when staff > 0 then aum_total / staff end", "fee_alignment": "case when not coalesce(fee_pct_of_aum, false) then 0.0 when coalesce(fee_commissions, false) then 0.5 else 1.0 end",
    "disciplinary_record": "1 - least(flags, 4) / 4", "hnw_focus": "case when pct_clients_individuals is not null or pct_clients_hnw_individuals is not null then coalesce(pct_clients_individuals, 0) + coalesce(pct_clients_hnw_individuals, 0) end",
}
SIGNALS = {
    "advisor_disclosures": "case when rate is not null and p_rate >= 0.9 then floor({0} * (0.4 + 0.6 * (p_rate - 0.9) / (1 - 0.9)) + 0.5) else 0 end", "recent_firm_disclosures": "case when recent_events > 0 and p_events >= 0.95 then floor({0} * (0.4 + 0.6 * (p_events - 0.95) / (1 - 0.95)) + 0.5) else 0 end",
    "commissions_plus_performance": "case when fee_commissions and fee_performance_based then {0} else 0 end", "disclosures": "case when flags > 0 then least(flags, 4) * {0} else 0 end",
}


def _top_sql(name: str) -> str:
    m = METHODS[name]
    levels = [m.cohorts[:i] for i in range(len(m.cohorts), 0, -1)]
    fits = " ".join(f"when {' and '.join(f'{c} is not null' for c in keys)} and count(*) over (partition by {', '.join(keys)}) >= {LEAST_COHORT} then {len(keys)}" for keys in levels)
    known = ", ".join(f"{sql} as v_{k}" for k, sql in FACTORS.items() if k in m.weights)
    total = sum(m.weights.values())

    def share(k: str) -> str:
        if k in ("fee_alignment", "disciplinary_record"):
            return f"least(1.0, greatest(0.0, v_{k}))"
        of = lambda keys: f"cume_dist() over (partition by {', '.join([*keys, f'v_{k} is null'])} order by v_{k})"
        deep = " ".join(f"when {len(keys)} then {of(keys)}" for keys in levels)
        return f"coalesce(case when v_{k} is null then null else {f'case level {deep} else {of([])} end' if levels else of([])} end, 0)"

    score = "100 * (" + " + ".join(f"{share(k)} * {w / total!r}" for k, w in m.weights.items()) + ")"
    return RATED + f", p as (select *, {known}, {f'case {fits} else 0 end' if levels else '0'} as level from s where coalesce(aum_total, 0) >= {m.min_aum}), l as (select *, {score} as score from p), top as (select * from l where coalesce(staff, 0) >= {m.min_staff} and flags <= {m.max_disclosures})"


def _outlier_sql(name: str) -> str:
    m = METHODS[name]
    size = "case when aum_total < 1e9 then 0 when aum_total < 1e10 then 1 when aum_total < 1e11 then 2 else 3 end"
    points = ", ".join(f"({SIGNALS[k].format(x)})::double as g_{k}" for k, x in m.points.items())
    names = ", ".join(f"case when g_{k} > 0 then '{k}' end" for k in m.points)
    return f""", q as (select *, {size} as size, case when advisors >= 20 then flagged_advisors / advisors end as rate from s where coalesce(aum_total, 0) >= {m.risk_min_aum}),
    r as (select *, percent_rank() over (partition by rate is null order by rate) as p_rate, percent_rank() over (partition by size order by recent_events) as p_events from q), g as (select *, {points} from r), out as (select *, {" + ".join(f"g_{k}" for k in m.points)} as points, array_to_string(list_filter([{names}], lambda x: x is not null), ',') as signals from g)"""


@query("r01_top_list", _top_sql("default") + " select crd, name, round(score, 6) as score from top order by top.score desc, aum_total desc, crd limit 10")
def r01(t: Tables) -> DataFrame:
    """The published default. Percentiles come from all above the floor, the list from those that pass the screens."""
    return top_firms(rated(t), METHODS["default"]).select("crd", "name", F.round("score", 6).alias("score"))


@query("r02_outliers", RATED + _outlier_sql("default") + " select crd, name, points as score, signals from out where points >= 40")
def r02(t: Tables) -> DataFrame:
    """All outliers of the published default, with the signals that count."""
    return outlier_firms(rated(t), METHODS["default"], None).select("crd", "name", "score", F.array_join("signals", ",").alias("signals"))


def _preset(name: str) -> None:
    m = METHODS[name]
    sql = _top_sql(name) + _outlier_sql(name) + f" select 'top' as list, crd, round(score, 6) as score, '' as signals from top union all select 'outliers', crd, points, signals from out where points >= {m.threshold}"

    @query(f"r03_{name}", sql)
    def r03(t: Tables) -> DataFrame:
        """A published preset: every firm that it ranks, and every outlier."""
        f = rated(t)
        best = top_firms(f, m, None).select(F.lit("top").alias("list"), "crd", F.round("score", 6).alias("score"), F.lit("").alias("signals"))
        return best.unionByName(outlier_firms(f, m, None).select(F.lit("outliers").alias("list"), "crd", "score", F.array_join("signals", ",").alias("signals")))


for _name in METHODS:
    _preset(_name)


@query("a26_homepage", FIRMS + """, m as (select quantile_disc(-aum, 0.5) * -1 as median_aum from u) select median_aum, count(*) filter (aum >= 6000) as large, round(sum(aum) filter (aum >= 6000) / sum(aum), 9) as large_share, count(*) filter (region <> 'AMERICA') as abroad, round(avg(case when region <> 'AMERICA' then 1.0 else 0 end), 9) as abroad_share from u, m group by 1""")
def a26(t: Tables) -> DataFrame:
    """The median of an even number is the upper of the two."""
    u = universe(t)
    large = F.when(F.col("aum") >= 6000, F.col("aum"))
    return u.agg(
        upper_median("aum").alias("median_aum"), F.count(large).alias("large"), F.round(F.sum(large) / F.sum("aum"), 9).alias("large_share"),
        F.count_if(F.col("region") != "AMERICA").alias("abroad"), F.round(F.avg((F.col("region") != "AMERICA").cast("double")), 9).alias("abroad_share"),
    )


@query("a22_rates_by_band", """with f as (select doc_id % 3 as g, doc_id % 150 as crd, quality, toxic from labels), b as (select crd, toxic, """ + BAND + """ as band from f join firms using (crd)) select band, count(*) as n, round(avg(toxic) * 100, 6) as percent from b group by 1""")
def a22(t: Tables) -> DataFrame:
    """Only what was scanned (here: labelled) counts; empty bands are left out."""
    f = t.raw("labels").select((F.col("doc_id") % 150).alias("crd"), "toxic").join(t.firms(), "crd")
    return f.groupBy(band(F.col("aum"), [2000.0, 6000.0], ["s", "m", "l"]).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("toxic") * 100, 6).alias("percent"))


@query("t02_table_sort", FIRMS + " select crd, (row_number() over (order by per_order desc nulls last, name))::int as by_size, (row_number() over (order by state nulls last, name))::int as by_state from u qualify by_size <= 100 or by_state <= 100")
def t02(t: Tables) -> DataFrame:
    """Missing values last in both directions, ties by name in binary order, then by number; the places of the first hundred of either order in both.

    Only those rows are numbered: for each order the others are counted by how many of them come before, a row for each of two hundred places.
    """
    u = universe(t)
    orders = {"by_size": [F.desc_nulls_last("per_order"), F.col("name"), F.col("crd")], "by_state": [F.asc_nulls_last("state"), F.col("name"), F.col("crd")]}
    # as one value that sorts in that order; text and number of a null sort last by the flag before them
    keys = {"by_size": F.struct(F.col("per_order").isNull().alias("a"), (-F.col("per_order")).alias("b"), F.col("name").alias("c"), F.col("crd").alias("d")), "by_state": F.struct(F.col("state").isNull().alias("a"), F.col("state").alias("b"), F.col("name").alias("c"), F.col("crd").alias("d"))}
    chosen = [u.orderBy(*o).limit(100).select("crd") for o in orders.values()]
    rows = u.select("crd", *[k.alias(n) for n, k in keys.items()]).join(chosen[0].union(chosen[1]).distinct(), "crd", "left_semi")
    for n, k in keys.items():
        ends = rows.agg(F.array_sort(F.collect_list(n))).scalar()  # two hundred at most
        at = F.size(F.filter("_ends", lambda e: e < k))
        counts = u.withColumn("_ends", ends).select(at.alias("_at")).groupBy("_at").agg(F.count("*").alias("_n")).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_n")))).scalar()
        own = F.sequence(F.lit(0), F.size(F.filter("_ends", lambda e: e < F.col(n))))
        place = F.aggregate(own, F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.try_element_at("_counts", i), F.lit(0).cast("long")))
        rows = rows.withColumns({"_ends": ends, "_counts": counts}).withColumn(f"_{n}", place).drop("_ends", "_counts")
    return rows.select("crd", *[F.col(f"_{n}").cast("int").alias(n) for n in keys])
