"""Point-in-time reads of append-only filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarter_ends(df: DataFrame, date: str, out: str = "quarter") -> DataFrame:
    """Quarter-ends from the first to the last date of df: a row for each."""
    span = df.agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    starts = F.sequence(F.trunc("lo", "quarter"), F.trunc("hi", "quarter"), F.expr("interval 3 months"))
    ends = span.select(F.explode(starts).alias("s"), "hi").select(F.last_day(F.add_months("s", 2)).alias(out), "hi")
    return ends.where(F.col(out) <= F.col("hi")).select(out)


def served_quarters(date: Column, months: int) -> Column:
    """The quarter-ends that a filing of this date can serve: those on or after it for which it is no older than so many months."""
    first = F.trunc(date, "quarter")
    # one more than months / 3: clamping at a month's end may let another in
    ends = F.transform(F.sequence(first, F.add_months(first, months + 3), F.expr("interval 3 months")), lambda s: F.last_day(F.add_months(s, 2)))
    return F.filter(ends, lambda q: (q >= date) & (date >= F.add_months(q, -months)))


def snapshots(filings: DataFrame, key: str, date: str, order: list[str], months: int, last: Column | None = None, quarter: str = "quarter") -> DataFrame:
    """The latest filing of each key at each quarter-end, not older than so many months.

    A window by key tells each filing's successor; the filing is the latest at the quarter-ends from its own date to the day before that, and only to those is it
    sent. So each filing is shuffled once, and there is no join with the calendar. order breaks ties, largest first. last bounds the quarter-ends.
    """
    w = Window.partitionBy(key).orderBy(date, *order)
    rows = filings.withColumn("_next", F.lead(date).over(w))
    served = F.filter(served_quarters(F.col(date), months), lambda q: (F.col("_next").isNull() | (q < F.col("_next"))) & (q <= last if last is not None else F.lit(True)))
    return rows.withColumn(quarter, F.explode(served)).drop("_next")


def without_withdrawn(snapshot: DataFrame, withdrawals: DataFrame, key: str, date: str, quarter: str = "quarter") -> DataFrame:
    """Leaves out keys that were withdrawn on or before the quarter-end."""
    first = withdrawals.groupBy(F.col(key).alias("_key")).agg(F.min(date).alias("_gone"))
    return snapshot.join(first, (snapshot[key] == first["_key"]) & (first["_gone"] <= snapshot[quarter]), "left_anti")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order given; the order should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank or "_n", F.row_number().over(w)).where(F.col(rank or "_n") <= n)
    return out if rank else out.drop("_n")


def latest_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows of each key that tie for first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.dense_rank().over(w)).where("_n = 1").drop("_n")


def effective(filings: DataFrame, key: str, kind: str, order: list[str], replaces: list[str], adds: list[str]) -> DataFrame:
    """Filings that count for each key: the latest that replaces, and those that add at or after it."""
    place = F.struct(*order)
    base = filings.where(F.col(kind).isin(*replaces)).groupBy(key).agg(F.max(place).alias("_base"))
    out = filings.join(base, key).withColumn("_at", place)
    return out.where((F.col("_at") == F.col("_base")) & F.col(kind).isin(*replaces) | (F.col("_at") >= F.col("_base")) & F.col(kind).isin(*adds)).drop("_base", "_at")
