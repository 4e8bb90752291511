"""Securities holdings: market prices across filers, the scale a filer reports in, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def market_prices(holdings: DataFrame, security: str, value: str, shares: str, least: int = 5) -> DataFrame:
    """The median price of each security over at least so many holdings.

    A group is those who hold one security, few enough for Spark's own median; ranks.with_median() is for groups that grow with the table.
    """
    price = F.try_divide(F.col(value), F.col(shares))
    out = holdings.where((F.col(value) > 0) & (F.col(shares) > 0)).groupBy(security).agg(F.median(price).alias("price"), F.count("*").alias("n"))
    return out.where(F.col("n") >= least)


def scales(holdings: DataFrame, prices: DataFrame, filer: str, security: str, value: str, shares: str, least: int = 3) -> DataFrame:
    """filer, scale: 1, 1000 or 0.001, what its values must be taken times to meet the market, within a factor of 2; 1 for too few prices, null for none that fits."""
    rows = holdings.where((F.col(value) > 0) & (F.col(shares) > 0)).join(prices.select(security, "price"), security, "left")
    ratio = F.try_divide(F.col(value) / F.col(shares), F.col("price"))
    agg = rows.groupBy(filer).agg(F.median(ratio).alias("ratio"), F.count("price").alias("n"))
    near = lambda s: (F.col("ratio") * s).between(0.5, 2.0)
    scale = F.when(F.col("n") < least, 1.0)
    for s in (1.0, 1000.0, 0.001):
        scale = scale.when(near(s), s)
    return agg.select(filer, scale.alias("scale"))


def largest_positions(holdings: DataFrame, filer: str, security: str, value: str, option: str, n: int = 10) -> DataFrame:
    """The n largest positions of each filer with their share of all its positions; options are left out of both."""
    plain = holdings.where(F.col(option).isNull()).groupBy(filer, security).agg(F.sum(value).alias("value"))
    w = Window.partitionBy(filer)
    share = F.try_divide(F.col("value") * 100, F.sum("value").over(w))
    out = plain.withColumns({"percent": share, "place": F.row_number().over(w.orderBy(F.desc("value"), security))})
    return out.where(F.col("place") <= n)
