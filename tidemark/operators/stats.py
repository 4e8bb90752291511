"""Medians, changes, fits and series. Names say which of several definitions is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(value: str) -> Column:
    """The middle value, of an even number the larger of the two: the discrete percentile from the largest down."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value} desc)")


def quantiles(value: str, at: list[float]) -> Column:
    """Quantiles interpolated between neighbours, as an array."""
    return F.percentile(F.col(value), F.array(*map(F.lit, at)))


def exact_avg(value: str) -> Column:
    """The mean of amounts, summed up as decimals of ten places, so that it is the same in whatever order they meet, to be sorted by; where one of a group can't be that, the mean of doubles."""
    places = F.col(value).try_cast("decimal(28,10)")
    whole = F.when(F.count(places) == F.count(value), F.try_sum(places).cast("double") / F.count(value))
    return F.coalesce(whole, F.avg(value))


def change(value: str, order: str, back: int, by: list[str] | None = None) -> Column:
    """Relative change against the value so many rows before; null where that is missing or zero."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    before = F.lag(value, back).over(w)
    return F.col(value) / F.nullif(before, F.lit(0)) - 1


def complete_periods(counts: DataFrame, period: str, n: str, share: float = 0.93) -> DataFrame:
    """Periods with at least the given share of the last period's count."""
    last = counts.agg(F.max_by(n, period).alias("_last"))
    return counts.join(F.broadcast(last), F.col(n) >= share * F.col("_last")).drop("_last")  # one row is broadcast


def log_fit(x: Column, y: Column) -> list[Column]:
    """Slope, intercept and count of a fit of ln y on ln x over rows where both are positive."""
    ok = (x > 0) & (y > 0)
    lx, ly = F.when(ok, F.ln(x)), F.when(ok, F.ln(y))
    return [F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.count_if(ok).alias("n")]


def half_decade(value: Column) -> Column:
    """The number of the half decade that a positive value lies in."""
    return F.when(value > 0, F.floor(2 * F.log10(value)))


def aligned(df: DataFrame, axis: DataFrame, key: str, period: str, value: str, out: str = "series", most: int = 10_000) -> DataFrame:
    """For each key its values along the axis in order, null where it has none; an axis of more periods than most is an error, since it is sent to every task."""
    periods = axis.select(period).distinct().agg(F.array_sort(F.collect_list(period)).alias("_axis"))
    periods = periods.select(F.when(F.size("_axis") > most, F.raise_error(F.lit(f"the axis has more than {most} periods"))).otherwise(F.col("_axis")).alias("_axis"))
    own = df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(period, value))).alias("_own"))
    return own.join(F.broadcast(periods)).select(key, F.transform("_axis", lambda p: F.try_element_at("_own", p)).alias(out))  # one row is broadcast


def indexed(df: DataFrame, key: str, period: str, value: str, out: str = "index") -> DataFrame:
    """Every key's values relative to its value in the first period that all keys have."""
    keys = df.agg(F.countDistinct(key).alias("_keys"))
    full = df.where(F.col(value).isNotNull()).groupBy(period).agg(F.countDistinct(key).alias("_n")).join(F.broadcast(keys), F.col("_n") == F.col("_keys"))
    first = full.agg(F.min(period).alias("_first"))
    base = df.join(F.broadcast(first), F.col(period) == F.col("_first")).select(F.col(key).alias("_key"), F.col(value).alias("_base"))
    return df.join(base, F.col(key) == F.col("_key")).withColumn(out, F.try_divide(F.col(value), F.col("_base"))).drop("_key", "_base")
