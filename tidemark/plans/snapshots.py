"""Quarterly snapshots of filings and what is told of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import band
from ..operators.asof import quarter_ends, snapshots, without_withdrawn
from ..operators.ranks import one_if, with_median
from ..operators.stats import change, complete_periods
from .fixtures import Tables, query

CUTS, LABELS = [100_000.0, 200_000.0, 300_000.0], ["a", "b", "c", "d"]
BAND = "case when coalesce(aum, 0) < 100000 then 'a' when coalesce(aum, 0) < 200000 then 'b' when coalesce(aum, 0) < 300000 then 'c' else 'd' end"


def current(t: Tables) -> DataFrame:
    """The snapshot at every quarter-end, without withdrawn firms."""
    filings = t.filings()
    rows = snapshots(filings, "crd", "filed", ["filing_id"], 15).where(F.col("quarter") <= filings.agg(F.max("filed")).scalar())
    return without_withdrawn(rows, t.withdrawals(), "crd", "gone")


@query("j11_quarterly_snapshot", "select quarter, count(*) as firms, round(sum(aum), 2) as aum, round(median(aum), 4) as median_aum, count(*) filter (aum >= 300000) as large, round(count(*) filter (aum >= 300000) / count(*), 9) as large_share from snapshots group by 1")
def headline(t: Tables) -> DataFrame:
    """Firms, value, median and share of large firms at each quarter-end."""
    out = with_median(current(t), ["quarter"], F.col("aum"), {"firms": F.lit(1), "aum": F.col("aum"), "large": one_if(F.col("aum") >= 300000)})
    return out.select("quarter", "firms", F.round("aum", 2).alias("aum"), F.round("median", 4).alias("median_aum"), "large", F.round(F.col("large") / F.col("firms"), 9).alias("large_share"))


@query("w20_quarter_calendar", "select quarter from quarters")
def calendar(t: Tables) -> DataFrame:
    return quarter_ends(t.filings(), "filed")


@query("a02_quarter_bands", f"with bands as (select unnest(['a','b','c','d']) as band) select q.quarter, b.band, count(s.crd) as n, round(coalesce(sum(s.aum), 0), 2) as aum, round(median(s.aum), 4) as median_aum from quarters q cross join bands b left join (select *, {BAND} as band from snapshots) s on s.quarter = q.quarter and s.band = b.band group by 1, 2")
def bands(t: Tables) -> DataFrame:
    """Figures of each band, with zeroes where a band is empty."""
    s = with_median(current(t).withColumn("band", band(F.col("aum"), CUTS, LABELS)), ["quarter", "band"], F.col("aum"), {"n": F.lit(1), "aum": F.col("aum")}, "median_aum")
    grid = quarter_ends(t.filings(), "filed").withColumn("band", F.explode(F.array(*map(F.lit, LABELS))))
    out = grid.join(s, ["quarter", "band"], "left")
    return out.select("quarter", "band", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("aum", F.lit(0.0)), 2).alias("aum"), F.round("median_aum", 4).alias("median_aum"))


@query("a10_complete_quarters", "with c as (select quarter, count(*) as n from snapshots group by 1) select quarter, n from c where n >= 0.93 * (select arg_max(n, quarter) from c)")
def complete(t: Tables) -> DataFrame:
    """A10: quarters as complete as the last."""
    return complete_periods(current(t).groupBy("quarter").agg(F.count("*").alias("n")), "quarter", "n")


@query("j07_appeared_disappeared", """with q as (select quarter, row_number() over (order by quarter) as i from quarters), s as (select crd, i from snapshots join q using (quarter)),
    a as (select s.i, count(*) as appeared from s where i > 1 and not exists (select 1 from s p where p.crd = s.crd and p.i = s.i - 1) group by 1),
    d as (select s.i + 1 as i, count(*) as gone from s where i < (select max(i) from q) and not exists (select 1 from s p where p.crd = s.crd and p.i = s.i + 1) group by 1)
    select q.quarter, coalesce(appeared, 0) as appeared, coalesce(gone, 0) as gone from q left join a using (i) left join d using (i) where q.i > 1""")
def moves(t: Tables) -> DataFrame:
    """Firms that appeared or disappeared since the quarter before, by the quarters around each in the firm's own order."""
    w = Window.partitionBy("crd").orderBy("quarter")
    before, after = F.last_day(F.add_months("quarter", -3)), F.last_day(F.add_months("quarter", 3))
    event = lambda at, appeared, gone: F.struct(at.alias("quarter"), appeared.cast("int").alias("appeared"), gone.cast("int").alias("gone"))
    new, ended = ~F.coalesce(F.lag("quarter").over(w) == before, F.lit(False)), ~F.coalesce(F.lead("quarter").over(w) == after, F.lit(False))
    rows = current(t).select("crd", "quarter").select("quarter", new.alias("new"), ended.alias("ended"))
    events = rows.select(F.explode(F.array(event(F.col("quarter"), F.col("new"), F.lit(False)), event(after, F.lit(False), F.col("ended")))).alias("e")).select("e.*")
    out = events.groupBy("quarter").agg(F.sum("appeared").alias("appeared"), F.sum("gone").alias("gone"))
    axis = quarter_ends(t.filings(), "filed")
    axis = axis.where(F.col("quarter") > axis.agg(F.min("quarter")).scalar())
    return axis.join(out, "quarter", "left").select("quarter", F.coalesce("appeared", F.lit(0)).alias("appeared"), F.coalesce("gone", F.lit(0)).alias("gone"))


@query("a03_new_firms", f"""with p as (select crd, min(quarter) as first from snapshots group by 1), s as (select s.*, {BAND} as band, s.quarter = p.first as is_new from snapshots s join p using (crd))
    select quarter, is_new, count(*) as n, round(median(aum), 4) as median_aum, round(avg(case when status = 'O' then 1.0 else 0 end), 9) as open_rate, round(avg(case when kind = '1-URGENT' then 1.0 else 0 end), 9) as urgent_rate, round(avg(case when band = 'd' then 1.0 else 0 end), 9) as large_share from s group by 1, 2""")
def new_firms(t: Tables) -> DataFrame:
    """How firms in their first quarter differ from the others."""
    s = current(t)
    first = F.min("quarter").over(Window.partitionBy("crd"))
    s = s.withColumn("is_new", F.col("quarter") == first)
    told = {"open_rate": F.col("status") == "O", "urgent_rate": F.col("kind") == "1-URGENT", "large_share": band(F.col("aum"), CUTS, LABELS) == "d"}
    out = with_median(s, ["quarter", "is_new"], F.col("aum"), {"n": F.lit(1), **{k: one_if(c) for k, c in told.items()}})
    return out.select("quarter", "is_new", "n", F.round("median", 4).alias("median_aum"), *[F.round(F.col(k) / F.col("n"), 9).alias(k) for k in told])


@query("a04_top_states", """with s as (select quarter, crd, state from snapshots join firms using (crd) where state is not null), last as (select state, count(*) as n from s where quarter = (select max(quarter) from s) group by 1 order by n desc, state limit 12)
    select s.state, s.quarter, count(*) as n from s join last using (state) group by 1, 2""")
def top_states(t: Tables) -> DataFrame:
    """The largest states of the last quarter, and their counts in every quarter."""
    s = current(t).select("quarter", "crd").join(t.firms().select("crd", "state"), "crd").where("state is not null and trim(state) <> '' and state <> 'None'")
    counts = s.groupBy("quarter", "state").agg(F.count("*").alias("n"))
    last = counts.groupBy("state").agg(F.max_by("n", "quarter").alias("n"), F.max("quarter").alias("quarter"))
    final = counts.agg(F.max("quarter").alias("quarter"))
    best = last.join(F.broadcast(final), "quarter").orderBy(F.desc("n"), "state").limit(12).select("state")  # one row is broadcast
    return counts.join(best, "state", "left_semi").select("state", "quarter", "n")


@query("j10_band_transitions", f"""with b as (select crd, quarter, {BAND} as band from snapshots), n as (select crd, (date_trunc('quarter', quarter) + interval 6 months - interval 1 day)::date as quarter, band as before from b)
    select before, band as after, count(*) as n from b join n using (crd, quarter) group by 1, 2""")
def transitions(t: Tables) -> DataFrame:
    """How firms move between bands from one quarter to the next."""
    w = Window.partitionBy("crd").orderBy("quarter")
    b = current(t).select("crd", "quarter", band(F.col("aum"), CUTS, LABELS).alias("after"))
    b = b.withColumns({"before": F.lag("after").over(w), "last": F.lag("quarter").over(w)})
    return b.where(F.col("last") == F.last_day(F.add_months("quarter", -3))).groupBy("before", "after").agg(F.count("*").alias("n"))


@query("j12_withdrawals_in_quarter", "select quarter, count(w.crd) as n from quarters left join withdrawals w on w.gone <= quarter and w.gone > (quarter - interval 3 months)::date group by 1")
def withdrawn(t: Tables) -> DataFrame:
    """Withdrawals in the three months up to each quarter-end; clamped month-ends may count one twice."""
    ends = F.filter(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.last_day(F.add_months(F.trunc("gone", "quarter"), 2 + 3 * i))), lambda q: (F.col("gone") <= q) & (F.col("gone") > F.add_months(q, -3)))
    counts = t.withdrawals().select(F.explode(ends).alias("quarter")).groupBy("quarter").agg(F.count("*").alias("n"))
    return quarter_ends(t.filings(), "filed").join(counts, "quarter", "left").select("quarter", F.coalesce("n", F.lit(0)).alias("n"))


@query("w04_quarter_changes", "with q as (select quarter, count(*) as n from snapshots group by 1) select quarter, n, round(n / nullif(lag(n, 1) over (order by quarter), 0) - 1, 9) as qoq, round(n / nullif(lag(n, 4) over (order by quarter), 0) - 1, 9) as yoy from q")
def changes(t: Tables) -> DataFrame:
    """Changes against the quarter before and four before, by position."""
    q = current(t).groupBy("quarter").agg(F.count("*").alias("n"))  # one row for each quarter
    return q.select("quarter", "n", F.round(change("n", "quarter", 1), 9).alias("qoq"), F.round(change("n", "quarter", 4), 9).alias("yoy"))


@query("a27_concentration", "select quarter, round(sum(aum) filter (aum >= 300000) / nullif(sum(aum), 0), 9) as share from snapshots group by 1")
def concentration(t: Tables) -> DataFrame:
    """The share of value that large firms have."""
    return current(t).groupBy("quarter").agg(F.round(F.try_divide(F.sum(F.when(F.col("aum") >= 300000, F.col("aum"))), F.sum("aum")), 9).alias("share"))


@query("j11_latest_known", "select crd, filing_id, filed, aum from filings f where not exists (select 1 from withdrawals w where w.crd = f.crd) qualify row_number() over (partition by crd order by filed desc, filing_id desc) = 1")
def latest_known(t: Tables) -> DataFrame:
    """J11 without an upper bound: the latest filing of each firm that never withdrew."""
    from ..operators.asof import latest

    f = t.filings().join(t.withdrawals(), "crd", "left_anti")
    return latest(f, ["crd"], [F.desc("filed"), F.desc("filing_id")]).select("crd", "filing_id", "filed", "aum")


@query("r09_pulse", f"""with q as (select quarter, count(*) as n, sum(aum) as aum from snapshots group by 1), g as (select * from q where n >= 0.93 * (select arg_max(n, quarter) from q)),
    w as (select quarter, count(*) as gone from quarters join withdrawals on gone <= quarter and gone > (quarter - interval 3 months)::date group by 1)
    select g.quarter, g.n, round(g.aum, 2) as aum, coalesce(gone, 0) as gone, round(g.n / nullif(lag(g.n) over (order by g.quarter), 0) - 1, 9) as qoq from g left join w using (quarter)""")
def pulse(t: Tables) -> DataFrame:
    """Complete quarters with value, withdrawals and change."""
    q = current(t).groupBy("quarter").agg(F.count("*").alias("n"), F.sum("aum").alias("aum"))
    out = complete_periods(q, "quarter", "n").join(withdrawn(t).withColumnRenamed("n", "gone"), "quarter", "left")
    return out.select("quarter", "n", F.round("aum", 2).alias("aum"), F.coalesce("gone", F.lit(0)).alias("gone"), F.round(change("n", "quarter", 1), 9).alias("qoq"))
