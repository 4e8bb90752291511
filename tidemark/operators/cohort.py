"""Peer groups with a fallback for small ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import at_or_below, below, dealt, for_salts, group_of, place, with_counts

#: Kinds of counted places that one value has: the number of its level is added.
KINDS = 100


def with_level(df: DataFrame, levels: list[list[str]], least: int | list[int], out: str = "level") -> DataFrame:
    """Adds the number of the deepest level whose keys are known and whose group has at least so many members; 0 is the whole universe.

    levels go from coarse to fine; each is the list of its key columns, and least may be a list too. Members are counted by all keys at once, with partial sums;
    levels are told on these counts, a row for each combination of keys.
    """
    if not levels:
        return df.withColumn(out, F.lit(0))
    keys = list(dict.fromkeys(k for level in levels for k in level))
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    told = F.lit(0)
    for i, own in enumerate(levels, 1):
        known = F.lit(True)
        for k in own:
            known = known & F.col(k).isNotNull()
        size = F.sum("_n").over(Window.partitionBy(*own))
        told = F.when(known & (size >= (least[i - 1] if isinstance(least, list) else least)), i).otherwise(told)
    df = dealt(df, "_salt", {k: k for k in keys}, groups, "_n")
    groups = groups.select(*[F.col(k).alias(f"_of_{k}") for k in keys], told.alias(out), F.explode(for_salts("_n")).alias("_of_salt"))
    match = F.col("_salt") == F.col("_of_salt")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return df.join(groups, match).drop("_salt", "_of_salt", *[f"_of_{k}" for k in keys])


def in_cohort(df: DataFrame, values: dict[str, str], levels: list[list[str]], least: int | list[int], lower: bool = False, whole: bool = True, level: str | None = None) -> DataFrame:
    """Adds, for each value (new column: column), its share at or below, or with lower the share of the others below it, in the group that with_level() names.

    Without whole it is null where no level is large enough. Null values get no rank and don't count in the ranks of others. All values are counted at all levels in
    one aggregation; a row looks up the counts of its own level only, so no group meets in one task. With level the level's number is kept under that name.
    """
    told = level or "_level"
    rows = with_level(df, levels, least, told)
    if not values:
        return rows if level else rows.drop(told)
    places = [place(KINDS * n + i, keys, F.col(v)) for n, v in enumerate(values.values()) for i, keys in enumerate([[], *levels]) if i or whole]
    counted = df.select(F.explode(F.array(*places)).alias("_p")).select("_p.*")

    def own(n: int, v: str) -> Column:
        group = group_of([])
        for i, keys in enumerate(levels, 1):
            group = F.when(F.col(told) == i, group_of(keys)).otherwise(group)
        return F.struct((F.lit(KINDS * n) + F.col(told)).alias("_i"), group.alias("_g"), F.col(v).cast("double").alias("_v"))

    rows = with_counts(rows, {f"_count_{name}": own(n, v) for n, (name, v) in enumerate(values.items())}, counted)
    share = below if lower else at_or_below
    rows = rows.withColumns({name: share(f"_count_{name}") for name in values}).drop(*[f"_count_{name}" for name in values])
    return rows if level else rows.drop(told)
