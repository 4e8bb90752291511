"""What changed between consecutive filings of one filer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapsed(df: DataFrame, keys: list[str], identity: str, label: str, code: str, order: list[str]) -> DataFrame:
    """One row for each identity of a filing: all its labels, sorted and joined, and the code of its first row."""
    return df.groupBy(*keys, identity).agg(F.array_join(F.array_sort(F.collect_set(label)), "; ").alias(label), F.min_by(code, F.struct(*order)).alias(code))


def identity_key(schedule: Column, id_: Column, name: Column, owned: Column) -> Column:
    """Who an owner is: by id if there is one, else by normalised name; beside the schedule and what is owned."""
    return F.concat_ws("|", schedule, F.when(id_.isNotNull() & (id_ != ""), F.concat(F.lit("id:"), id_)).otherwise(F.concat(F.lit("nm:"), name)), F.coalesce(owned, F.lit("")))


def consecutive_changes(df: DataFrame, key: str, order: list[str], identity: str, value: str) -> DataFrame:
    """added, removed and changed identities between each filing of a key and the one before it.

    df has one row for each filing and identity. Columns: key, turn (the number of the later filing), identity, event, old, new. Each identity is looked
    at in the order of its own filings, so a key's rows are shuffled once.
    """
    by_key = Window.partitionBy(key)
    rows = df.select(key, F.dense_rank().over(by_key.orderBy(*order)).alias("turn"), identity, F.col(value).alias("value"))
    rows = rows.withColumn("_last", F.max("turn").over(by_key))
    own = Window.partitionBy(key, identity).orderBy("turn")
    follows = F.coalesce(F.lag("turn").over(own) == F.col("turn") - 1, F.lit(False))
    ends = ~F.coalesce(F.lead("turn").over(own) == F.col("turn") + 1, F.lit(False))
    rows = rows.withColumns({"_follows": follows, "_ends": ends, "_old": F.lag("value").over(own)})
    one = lambda turn, event, old, new: F.struct(turn.alias("turn"), F.lit(event).alias("event"), old.alias("old"), new.alias("new"))
    now, value_, none = F.col("turn"), F.col("value"), F.lit(None).cast(df.schema[value].dataType)
    events = F.array_compact(F.array(
        F.when((now > 1) & ~F.col("_follows"), one(now, "added", none, value_)),
        F.when(F.col("_follows") & ~F.col("_old").eqNullSafe(value_), one(now, "changed", F.col("_old"), value_)),
        F.when(F.col("_ends") & (now < F.col("_last")), one(now + 1, "removed", value_, none)),
    ))
    return rows.select(key, identity, F.explode(events).alias("_e")).select(key, "_e.turn", identity, "_e.event", "_e.old", "_e.new")


def latest_versions(df: DataFrame, keys: list[str], version: str, removed: str) -> DataFrame:
    """The version of each event with the largest version number, unless that one removes it."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & ~F.coalesce(F.col(removed), F.lit(False))).drop("_n")


def unique_in_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows whose value is found only once in their group."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(group, value))).where("_n = 1").drop("_n")
