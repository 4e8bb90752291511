"""Exact ranks and medians in groups of any size, by counting.

Rows are first summed up by group and value. A value's rank is the number of rows in the steps below its own, and of rows below it in its step. A step is a value with its
significant bits cut to STEP_BITS, so steps follow from values alone: nothing is sampled, no pass finds bounds, and every task, also one that is run again, cuts alike. A group has about a thousand
steps for each power of two that its values span; within a step values are put in order by one task, so a group's tasks are as many as its steps.
Only a step's sums, not its values, meet in one window of their group. Values are taken as doubles; nulls count in no rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Significant bits of a step.
STEP_BITS = 11
#: Of how many rows with one key a task gets about as many at most.
TIES = 50_000


def step(value: Column) -> Column:
    """A double rounded to STEP_BITS significant bits: never falling as values rise. Beyond what the rounding can hold, infinities among them, the value itself."""
    scaled = value * (2.0 ** (53 - STEP_BITS) + 1)
    return F.when(F.abs(value) < 1e290, scaled - (scaled - value)).otherwise(value)


def group_of(keys: list[str]) -> Column:
    """A group's keys as one value; null keys are a group of their own."""
    return F.array(*[F.col(k).cast("string") for k in keys]) if keys else F.array().cast("array<string>")


def place(kind: int | Column, keys: list[str], value: Column) -> Column:
    """One thing to be counted: the kind tells values of one group from others."""
    return F.struct((F.lit(kind) if isinstance(kind, int) else kind).alias("_i"), group_of(keys).alias("_g"), value.cast("double").alias("_v"))


def summed_up(places: DataFrame) -> DataFrame:
    """_i, _g, _v, the number of rows of each different value, and its step."""
    counts = places.where("_v is not null").groupBy("_i", "_g", "_v").agg(F.count("*").alias("equal")).withColumn("_c", step(F.col("_v")))
    # what joins would ask for, asked for here, so that all who use these counts have one shuffle of them
    return counts.where("_c is not null and _g is not null and _i is not null")


def counts_below(places: DataFrame) -> DataFrame:
    """_i, _g, _v and the counts below, equal and total of each different value."""
    counts = summed_up(places)
    steps = counts.groupBy("_i", "_g", "_c").agg(F.sum("equal").alias("_size"))
    # a few thousand sums of a group
    w = Window.partitionBy("_i", "_g")
    steps = steps.withColumns({"_before": F.sum("_size").over(w.orderBy("_c")) - F.col("_size"), "total": F.sum("_size").over(w)}).drop("_size")
    upto = F.sum("equal").over(Window.partitionBy("_i", "_g", "_c").orderBy("_v"))
    out = counts.withColumn("_upto", upto).join(steps, ["_i", "_g", "_c"])
    return out.select("_i", "_g", "_v", (F.col("_before") + F.col("_upto") - F.col("equal")).alias("below"), "equal", "total")


def dealt(rows: DataFrame, name: str, key: dict[str, str], sizes: DataFrame, size: str) -> DataFrame:
    """Adds a salt to rows, so that no task of a join by their key and salt gets many rows of one key: below salts() of the rows that share the key.

    key tells the columns of sizes, a row for each key with how many rows have it, from those of rows. Only keys of more than TIES rows are sent along; they are at most as many as the rows over TIES.
    """
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    many = sizes.where(F.col(size) > TIES).select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(key)], salts(F.col(size)).alias("_m"))
    match = F.lit(True)
    for i, c in enumerate(key.values()):
        match = match & F.col(c).eqNullSafe(F.col(f"_of{i}"))
    salt = F.when(F.col("_m").isNotNull(), F.pmod(F.xxhash64(*plain), F.col("_m"))).otherwise(0)
    return rows.join(F.broadcast(many), match, "left").withColumn(name, salt.cast("int")).drop("_m", *[f"_of{i}" for i in range(len(key))])


def salts(size: Column) -> Column:
    """Into how many parts the rows of a key go."""
    return (F.floor((size - 1) / TIES) + 1).cast("int")


def for_salts(size: str) -> Column:
    """All salts of a key, to be exploded."""
    return F.sequence(F.lit(0), salts(F.col(size)) - 1)


def with_counts(rows: DataFrame, asked: dict[str, Column], counted: DataFrame) -> DataFrame:
    """Adds, for each new column, the struct (below, equal, total) of a place among the counted ones; null where the value is null.

    Places that many rows share are dealt by salts, and nulls over keys of their own, so ties of any number are looked up by many tasks.
    """
    counts, sizes = counts_below(counted), summed_up(counted)
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    for n, (name, at) in enumerate(asked.items()):
        # the same counts for every name, so they are made and shuffled once
        spread = F.when(at["_v"].isNull(), 1 + F.pmod(F.xxhash64(*plain), F.lit(1000))).otherwise(0).cast("int")
        rows = rows.withColumns({f"_k{n}": F.when(at["_v"].isNotNull(), at["_i"]), f"_g{n}": at["_g"], f"_v{n}": F.coalesce(at["_v"], F.lit(0.0)), f"_n{n}": spread})
    for n, name in enumerate(asked):
        rows = dealt(rows, f"_s{n}", {"_i": f"_k{n}", "_g": f"_g{n}", "_v": f"_v{n}"}, sizes, "equal").withColumn(f"_s{n}", F.col(f"_s{n}") + F.col(f"_n{n}"))
        told = counts.select("_i", "_g", "_v", F.struct("below", "equal", "total").alias(name), F.explode(for_salts("equal")).alias("_s"))
        match = (F.col(f"_k{n}") == F.col("_i")) & (F.col(f"_g{n}") == F.col("_g")) & (F.col(f"_v{n}") == F.col("_v")) & (F.col(f"_s{n}") == F.col("_s"))
        rows = rows.join(told, match, "left").drop("_i", "_g", "_v", "_s", *[f"_{x}{n}" for x in "kgvsn"])
    return rows


def ranked(df: DataFrame, asked: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Adds, for each new column, the struct (below, equal, total) of a row's value in its group: name -> (value, keys)."""
    if not asked:
        return df
    places = [place(i, keys, F.col(v)) for i, (v, keys) in enumerate(asked.values())]
    return with_counts(df, dict(zip(asked, places)), df.select(F.explode(F.array(*places)).alias("_p")).select("_p.*"))


def at_or_below(count: str) -> Column:
    """The share of values that are not larger, as cume_dist gives; null for a null value."""
    return (F.col(count)["below"] + F.col(count)["equal"]) / F.col(count)["total"]


def below(count: str) -> Column:
    """The share of the others that are smaller, as percent_rank gives; 0 for a value that is alone."""
    return F.when(F.col(count)["total"] > 1, F.col(count)["below"] / (F.col(count)["total"] - 1)).when(F.col(count).isNotNull(), 0.0)


def mid_rank(count: str) -> Column:
    """Percentile by the smaller values and half of the equal ones, rounded half to even."""
    return F.bround((F.col(count)["below"] + F.col(count)["equal"] / 2) / F.col(count)["total"] * 100).cast("long")


def one_if(condition: Column) -> Column:
    """1 where it holds, else 0, to be summed up."""
    return F.coalesce(condition, F.lit(False)).cast("long")


def with_median(df: DataFrame, keys: list[str], value: Column, sums: dict[str, Column], median: str = "median") -> DataFrame:
    """A row for each group: its keys, the sums of the given columns (of 1 for a count), and the exact interpolated median of a value.

    One aggregation by group and value carries the sums along. A group's histogram by steps tells in which step its middle values lie, and only values of that step are put in
    order, by group and step. Null values count in no median; a group of nulls only has none. Null keys are a group.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], value.cast("double").alias("_v"), *[c.alias(f"_sum_{n}") for n, c in sums.items()])
    counts = rows.groupBy(*names, "_v").agg(F.count("_v").alias("_n"), *[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in sums]).withColumn("_c", step(F.col("_v")))
    steps = counts.groupBy(*names, "_c").agg(F.sum("_n").alias("_n"), *[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in sums])
    w = Window.partitionBy(*names)
    all_, upto = F.sum("_n").over(w), F.sum("_n").over(w.orderBy("_c"))
    # places of the lower and the upper middle, from 1
    steps = steps.withColumns({"_low": F.floor((all_ + 1) / 2), "_high": F.floor(all_ / 2) + 1, "_before": upto - F.col("_n"), "_upto": upto})
    holds = lambda r: (F.col("_before") < F.col(r)) & (F.col(r) <= F.col("_upto"))
    out = steps.groupBy(*names).agg(*[F.sum(f"_sum_{n}").alias(n) for n in sums])
    middle = steps.where(holds("_low") | holds("_high")).select(*[F.col(n).alias(f"{n}m") for n in names], F.col("_c").alias("_cm"), "_low", "_high", "_before")
    same = lambda a, b: [F.col(f"{n}{a}").eqNullSafe(F.col(f"{n}{b}")) for n in names]
    near = counts.where("_v is not null").select(*names, "_v", "_c", F.col("_n").alias("_own"))
    match = F.col("_c") == F.col("_cm")
    for s in same("", "m"):
        match = match & s
    near = near.join(middle, match).select(*names, "_v", "_c", "_own", "_low", "_high", "_before")
    ends = F.col("_before") + F.sum("_own").over(Window.partitionBy(*names, "_c").orderBy("_v"))
    near = near.withColumns({"_upto": ends, "_before": ends - F.col("_own")})
    at = lambda r: F.max(F.when(holds(r), F.col("_v")))
    found = near.groupBy(*[F.col(n).alias(f"{n}f") for n in names]).agg(((at("_low") + at("_high")) / 2).alias(median))
    match = F.lit(True)
    for s in same("", "f"):
        match = match & s
    return out.join(found, match, "left").select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *sums, median)
