"""Spellings, providers and entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modal_spelling(df: DataFrame, keys: list[str], name: str, aggs: list[Column]) -> DataFrame:
    """For each key the spelling found most often (of equal ones the first by name), how many there are, and the aggregates."""
    counts = df.groupBy(*keys, name).agg(F.count("*").alias("_n"))
    spelled = counts.groupBy(*keys).agg(F.min_by(name, F.struct(-F.col("_n"), F.col(name))).alias("spelling"), F.count("*").alias("variants"))
    return df.groupBy(*keys).agg(*aggs).join(spelled, keys)


def league_table(df: DataFrame, role: str, key: str, name: str, firm: str, value: str, feeder: str, n: int = 40) -> DataFrame:
    """Providers of each role by how many firms they serve: firms, rows, value outside feeders (a null feeder flag counts as none)."""
    aggs = [F.countDistinct(firm).alias("firms"), F.count("*").alias("funds"), F.sum(F.when(~F.coalesce(F.col(feeder), F.lit(False)), F.col(value))).alias("value")]
    out = modal_spelling(df, [role, key], name, aggs)
    w = Window.partitionBy(role).orderBy(F.desc("firms"), F.desc("funds"), "spelling", key)
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def only_candidate(links: DataFrame, left: str, right: str) -> DataFrame:
    """left, right of those left sides that lead to one right side only."""
    return links.groupBy(left).agg(F.min(right).alias(right), F.max(right).alias("_most")).where(F.col(right) == F.col("_most")).drop("_most")


@dataclass(frozen=True)
class Tier:
    """Links (left, right, matched) of one kind of evidence; of several links to one right side the first in the order given counts.

    A fresh tier is for left sides that no earlier tier gave any link; in one that isn't, a left side may stand for several right sides.
    """

    links: DataFrame
    order: list[Column]
    fresh: bool = True


def cascade(tiers: list[Tier], left: str, right: str) -> DataFrame:
    """right, left, matched, tier: for each right side the link of the first tier that has one for it.

    A right side is settled once; a left side isn't, so one filer may be linked with the firms that it includes as well as with its own.
    """
    found = used = None
    for i, tier in enumerate(tiers, 1):
        t = tier.links
        if found is not None:
            t = t.join(used, left, "left_anti") if tier.fresh else t
        seen = t.select(left).distinct()
        used = seen if used is None else used.union(seen).distinct()
        if found is not None:
            t = t.join(found.select(right), right, "left_anti")
        t = t.withColumn("_n", F.row_number().over(Window.partitionBy(right).orderBy(*tier.order))).where("_n = 1").select(right, left, "matched", F.lit(i).alias("tier"))
        found = t if found is None else found.unionByName(t)
    return found


def unique_names(df: DataFrame, names: list[str], key: str, least: int = 5) -> DataFrame:
    """name, key: each key under all its names, without short or numeric ones; names of several keys are left out."""
    rows = df.select(F.explode(F.array_distinct(F.array(*names))).alias("name"), key).where((F.length("name") >= least) & ~F.rlike("name", F.lit("^[0-9 ]+$"))).distinct()
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("name"))).where("_n = 1").drop("_n")
