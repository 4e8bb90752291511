"""A few firms side by side, from all that is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import compact_usd, ordinal
from ..operators.asof import latest
from ..operators.documents import compare_sources, count_text, multiple_text, share_text
from ..operators.ranks import mid_rank, ranked
from .cohorts import RATED, compact_sql, rated
from .fixtures import Tables, query
from .growth import MULTIPLES, jumps, multiples

COMPARED = [7, 58, 120, 33]
#: AUM by segment: a firm's share in percent, by its number; null for those that report none.
SEGMENTS = {"AUM from individuals & HNW": (5, 10), "AUM in private funds": (4, 7), "AUM in mutual funds, ETFs & BDCs": (3, 6), "AUM from institutions": (6, 3)}
PARENT = "In {}’s filing"

COMMA = "printf('%,d', ({0})::bigint)"
MULTIPLE = "case when {0} < 10 then printf('%.1f', round_even({0}, 1)) else printf('%.0f', round_even({0}, 0)) end || '×'"
YES = "case when {0} then 'Yes' when not {0} then 'No' end"
GROWN = MULTIPLE.format("m{0}") + " || coalesce(' · faster than ' || greatest(1, least(99, p{0})) || '% of peers', '')"
# (group, label): what SQL reads it from, and how it is told
TEXTS = {
    ("Overview", "Business model"): ("s", "coalesce(client_mix, 'Mixed')"),
    ("Overview", "Tags"): ("s", "nullif(array_to_string(list_filter([case when name like '%7' then 'Family office' end, case when coalesce(pct_clients_hnw_individuals, 0) >= 0.25 then 'Wealth' end, case when fee_performance_based then 'Funds' end], lambda x: x is not null), ', '), '')"),
    ("Overview", "State"): ("(select s.crd, coalesce(f.state, f.region) as place from s join firms f on f.crd = s.crd)", "place"),
    ("Overview", "Regulatory AUM"): ("s", compact_sql("aum_total")),
    ("Overview", "Discretionary"): ("s", "case when aum_total <> 0 then round_even(aum_total * (crd % 10) / 10 / aum_total * 100, 0)::int || '%' end"),
    ("Overview", "Accounts"): ("s", COMMA.format("accounts_total")),
    ("Staffing", "Employees"): ("s", COMMA.format("employees_total")),
    ("Staffing", "Advisory staff"): ("s", COMMA.format("staff")),
    ("Staffing", "Non-advisory staff"): ("s", COMMA.format("case when employees_advisory <= employees_total then employees_total - employees_advisory end")),
    ("Staffing", "AUM per advisory professional"): ("s", f"case when staff > 0 then {compact_sql('(aum_total / staff)')} end"),
    ("Staffing", "AUM per non-advisory employee"): ("leverage", f"case when non = 0 then 'No support staff' else {compact_sql('per')} || ' · ' || place || case when place % 100 between 11 and 13 then 'th' when place % 10 = 1 then 'st' when place % 10 = 2 then 'nd' when place % 10 = 3 then 'rd' else 'th' end || ' percentile' end"),
    ("Growth", "3-report AUM growth"): ("grown", GROWN.format(3)),
    ("Growth", "5-report AUM growth"): ("grown", GROWN.format(5)),
    ("Growth", "3-report headcount change"): ("heads", MULTIPLE.format("e")),
    ("Growth", "Largest one-year jump"): ("heads", "case when jump is null then 'None since ' || (last_year - 5) else jump || ' (AUM at least doubled)' end"),
    **{("Clients", label): ("s", f"case when crd % 7 > 0 then ((crd % {m}) * {k}) || '%' end") for label, (m, k) in SEGMENTS.items()},
    ("Fees", "% of AUM"): ("s", YES.format("fee_pct_of_aum")), ("Fees", "Performance-based"): ("s", YES.format("fee_performance_based")), ("Fees", "Commissions"): ("s", YES.format("fee_commissions")),
    ("Holdings & funds", "13F reported value"): ("held", f"case when own then {compact_sql('(value * 1000)')} else '{PARENT.split('{}')[0]}' || cik || '{PARENT.split('{}')[1]}' end"),
    ("Holdings & funds", "Largest 13F position"): ("held", "case when own then 'Security ' || top end"),
    ("Holdings & funds", "Private funds advised"): ("fund_counts", COMMA.format("n")),
    ("Record", "Disciplinary disclosures"): ("s", COMMA.format("flags")), ("Record", "Financial-industry affiliations"): ("s", COMMA.format("affil_count")),
}
MANY = f"""{RATED}, lev as (select crd, client_mix, employees_total - employees_advisory as non, case when employees_total > employees_advisory then aum_total / (employees_total - employees_advisory) end as per from s where employees_advisory <= employees_total),
    leverage as (select crd, non, per, case when per is not null then round_even((rank() over (partition by client_mix, per is null order by per) - 1 + count(*) over (partition by client_mix, per) / 2) / count(per) over (partition by client_mix) * 100, 0)::bigint end as place from lev),
    {MULTIPLES.strip()[5:]}, spans as (select crd, span, multiple, round_even((rank() over (partition by span order by multiple) - 1 + count(*) over (partition by span, multiple) / 2) / count(*) over (partition by span) * 100, 0)::bigint as p from m),
    grown as (select crd, max(multiple) filter (span = 3) as m3, max(multiple) filter (span = 5) as m5, max(p) filter (span = 3) as p3, max(p) filter (span = 5) as p5 from spans group by 1),
    up as (select crd, year, aum / lag(aum) over w as up, lag(aum) over w as was from annual window w as (partition by crd order by year)), jumped as (select crd, max(year) as jump from up where was >= 50000 and up >= 2 group by 1),
    heads as (select crd, max(staff) filter (year = (select max(year) from annual)) / max(staff) filter (year = (select max(year) from annual) - 3) as e, jump, (select max(year) from annual) as last_year from annual left join jumped using (crd) group by crd, jump),
    h as (select filing_id % 1000 as cik, cusip, sum(value) as v from holdings where option is null group by 1, 2), filers as (select cik, sum(v) as value, arg_max(cusip, (v, -cusip)) as top from h group by 1),
    held as (select crd, coalesce(o.cik, p.cik) as cik, o.cik is not null as own, coalesce(o.value, p.value) as value, o.top from firms left join filers o on o.cik = crd left join filers p on p.cik = crd // 10 where coalesce(o.cik, p.cik) is not null),
    fund_counts as (select crd, count(distinct fund_id) as n from funds group by 1)"""


def _sql() -> str:
    parts = " union all ".join(f"""select '{group}' as "group", '{label}' as label, crd, ({sql})::varchar as text from {source} where crd in ({', '.join(map(str, COMPARED))})""" for (group, label), (source, sql) in TEXTS.items())
    return MANY + f""", c as ({parts}), l as (select unnest([{', '.join(f"{{'g': '{g}', 'l': '{x}'}}" for g, x in TEXTS)}]) as r)
    select r.g as "group", r.l as label, """ + ", ".join(f"coalesce(max(text) filter (crd = {k}), '—') as f{i}" for i, k in enumerate(COMPARED, 1)) + """ from l left join c on c."group" = r.g and c.label = r.l group by 1, 2"""


def _yes(c: Column) -> Column:
    return F.when(c, "Yes").when(~c, "No")


def leverage(t: Tables) -> DataFrame:
    """crd, employees who don't advise, AUM for each, and that figure's place among firms of the segment."""
    non = F.col("employees_total") - F.col("employees_advisory")
    f = rated(t).where("employees_advisory <= employees_total").select("crd", "client_mix", non.alias("non"), F.when(non > 0, F.col("aum_total") / non).alias("per"))
    return ranked(f, {"place": ("per", ["client_mix"])}).select("crd", "non", "per", mid_rank("place").alias("place"))


def grown(t: Tables) -> DataFrame:
    """crd, multiples over three and five reports and their places among all firms that have them."""
    m = ranked(multiples(t, [3, 5]).select("crd", "span", "multiple"), {"place": ("multiple", ["span"])}).withColumn("p", mid_rank("place"))
    of = lambda c, n: F.max(F.when(F.col("span") == n, F.col(c)))
    return m.groupBy("crd").agg(*[of(c, n).alias(f"{a}{n}") for n in (3, 5) for c, a in (("multiple", "m"), ("p", "p"))])


def heads(t: Tables) -> DataFrame:
    """crd, the change of staff over three years, the latest jump and the last year of all."""
    a = t.annual()
    last = t.filings().agg(F.max(F.year("filed"))).scalar()
    at = lambda back: F.max(F.when(F.col("year") == last - back, F.col("staff")))
    own = a.groupBy("crd").agg((at(0) / at(3)).alias("e"))
    jumped = jumps(t, 2.0).groupBy("crd").agg(F.max("year").alias("jump"))
    return own.join(jumped, "crd", "left").withColumn("last_year", last)


def held(t: Tables, firms: list[int]) -> DataFrame:
    """crd, whose filing tells a firm's holdings, own or its parent's, their value and the largest one; filers of these firms only."""
    ciks = sorted({*firms, *(k // 10 for k in firms)})
    h = t.holdings().withColumn("cik", F.col("filing_id") % 1000).where(F.col("cik").isin(*ciks) & F.col("option").isNull()).groupBy("cik", "cusip").agg(F.sum("value").alias("v"))
    filers = h.groupBy("cik").agg(F.sum("v").alias("value"), F.max_by("cusip", F.struct("v", -F.col("cusip"))).alias("top"))
    own, parent = (filers.select(F.col("cik").alias(f"{x}cik"), F.col("value").alias(f"{x}value"), F.col("top").alias(f"{x}top")) for x in ("o", "p"))
    f = t.firms().select("crd").join(own, F.col("crd") == F.col("ocik"), "left").join(parent, F.floor(F.col("crd") / 10) == F.col("pcik"), "left").where("ocik is not null or pcik is not null")
    return f.select("crd", F.coalesce("ocik", "pcik").alias("cik"), F.col("ocik").isNotNull().alias("own"), F.coalesce("ovalue", "pvalue").alias("value"), F.col("otop").alias("top"))


def sources(t: Tables, firms: list[int]) -> list[tuple[DataFrame, str, str, Column]]:
    """The rows of the comparison: where each is read, its group and label, and how it is told."""
    staff, c = F.coalesce("employees_advisory", "employees_total"), F.col
    firm = rated(t).join(t.firms().select("crd", F.coalesce("state", "region").alias("place")), "crd")
    lever, grow, head, hold = leverage(t), grown(t), heads(t), held(t, firms)
    own = latest(t.funds(), ["crd", "fund_id"], [F.desc("filed"), F.desc("filing_id"), c("line")]).groupBy("crd").agg(F.count("*").alias("n"))
    tags = F.nullif(F.array_join(F.array_compact(F.array(F.when(F.endswith("name", F.lit("7")), "Family office"), F.when(F.coalesce("pct_clients_hnw_individuals", F.lit(0.0)) >= 0.25, "Wealth"), F.when(c("fee_performance_based"), "Funds"))), ", "), F.lit(""))
    faster = lambda n: F.concat(multiple_text(c(f"m{n}")), F.coalesce(F.concat(F.lit(" · faster than "), F.greatest(F.lit(1), F.least(F.lit(99), c(f"p{n}"))), F.lit("% of peers")), F.lit("")))
    before, after = PARENT.split("{}")
    texts = {
        "Business model": (firm, F.coalesce("client_mix", F.lit("Mixed"))), "Tags": (firm, tags), "State": (firm, c("place")), "Regulatory AUM": (firm, compact_usd(c("aum_total"))),
        "Discretionary": (firm, share_text(c("aum_total") * (c("crd") % 10) / 10, c("aum_total"))), "Accounts": (firm, count_text(c("accounts_total"))), "Employees": (firm, count_text(c("employees_total"))), "Advisory staff": (firm, count_text(staff)),
        "Non-advisory staff": (firm, count_text(F.when(c("employees_advisory") <= c("employees_total"), c("employees_total") - c("employees_advisory")))), "AUM per advisory professional": (firm, F.when(staff > 0, compact_usd(c("aum_total") / staff))),
        "AUM per non-advisory employee": (lever, F.when(c("non") == 0, "No support staff").otherwise(F.concat(compact_usd(c("per")), F.lit(" · "), ordinal(c("place")), F.lit(" percentile")))),
        "3-report AUM growth": (grow, faster(3)), "5-report AUM growth": (grow, faster(5)), "3-report headcount change": (head, multiple_text(c("e"))),
        "Largest one-year jump": (head, F.when(c("jump").isNull(), F.concat(F.lit("None since "), (c("last_year") - 5).cast("string"))).otherwise(F.concat(c("jump").cast("string"), F.lit(" (AUM at least doubled)")))),
        **{label: (firm, F.when(c("crd") % 7 > 0, F.concat(((c("crd") % m) * k).cast("string"), F.lit("%")))) for label, (m, k) in SEGMENTS.items()},
        "% of AUM": (firm, _yes(c("fee_pct_of_aum"))), "Performance-based": (firm, _yes(c("fee_performance_based"))), "Commissions": (firm, _yes(c("fee_commissions"))),
        "13F reported value": (hold, F.when(c("own"), compact_usd(c("value") * 1000)).otherwise(F.concat(F.lit(before), c("cik").cast("string"), F.lit(after)))), "Largest 13F position": (hold, F.when(c("own"), F.concat(F.lit("Security "), c("top").cast("string")))),
        "Private funds advised": (own, count_text(c("n"))), "Disciplinary disclosures": (firm, count_text(F.coalesce("disciplinary_flag_count", F.lit(0)))), "Financial-industry affiliations": (firm, count_text(c("affil_count"))),
    }
    return [(texts[label][0], group, label, texts[label][1]) for group, label in TEXTS]


@query("r06_compare_table", _sql())
def r06(t: Tables) -> DataFrame:
    """All that is told of a few firms, side by side: of themselves, their growth, holdings and funds, and their places among peers."""
    return compare_sources("crd", COMPARED, sources(t, COMPARED))
