"""Which of a firm's filed addresses is its own site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import host_of, is_platform, registrable

# Legal forms and small words, words too common to tell a firm, first bytes of images.
SMALL_WORDS = "llc lp llp lllp inc corp corporation co company ltd limited plc the and of pc pllc na ab sa ag bv gmbh".split()
GENERIC_WORDS = "first capital wealth global american national investment investments financial advisors advisers asset assets management partners group private united north south east west great trust fund funds family office planning retirement money strategic premier summit legacy heritage".split()
IMAGE_STARTS = ["89504E47", "00000100", "47494638", "FFD8FF", "52494646", "3C737667", "3C3F786D6C"]


def name_words(name: Column) -> Column:
    """Words of a name, lower case; letters with points between are one word."""
    t = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "(?<=\\b[a-z])\\.(?=[a-z]\\.)|(?<=\\.[a-z])\\.", "")
    return F.filter(F.split(F.regexp_replace(t, "[^a-z0-9 ]", " "), " +"), lambda w: w != "")


def with_match_level(df: DataFrame, label: str, name: str, out: str) -> DataFrame:
    """Adds how strongly a domain's label tells a firm's name: 4 it is the name, 3 its first two words, 2 its telling first word or its initials,
    1 one holds the other, 0 not at all."""
    words = name_words(F.col(name))
    core = F.filter(words, lambda w: ~w.isin(SMALL_WORDS))
    letters = lambda ws: F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), "")
    df = df.withColumns({"_l": F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]", ""), "_w": words, "_c": core, "_f": F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]", "")})
    some = F.filter("_w", lambda w: ~w.isin("the", "and", "of"))
    forms = F.array_join(F.filter("_w", lambda w: w.isin(SMALL_WORDS) & ~w.isin("the", "and", "of")), "")
    df = df.withColumns({"_j": F.array_join("_c", ""), "_two": F.array_join(F.slice("_c", 1, 2), ""), "_first": F.coalesce(F.get("_c", F.lit(0)), F.lit("")), "_i": F.array(letters(F.col("_c")), letters(some), F.concat(letters(F.col("_c")), forms))})
    lab, full, two, first = F.col("_l"), F.col("_f"), F.col("_two"), F.col("_first")
    telling = (F.length(first) >= 5) & ~first.isin(GENERIC_WORDS)
    n = F.length(lab)
    part = ((n >= 4) & F.contains(full, lab)) | ((n >= 3) & F.startswith(full, lab)) | ((F.length(two) >= 5) & F.contains(lab, two)) | (telling & F.startswith(lab, first))
    level = (
        F.when((lab == "") | (F.size("_c") == 0), 0).when((lab == full) | (lab == F.col("_j")), 4).when((lab == two) & (F.length(two) >= 5), 3)
        .when((telling & (lab == first)) | ((n >= 3) & F.array_contains("_i", lab)), 2).when(part, 1).otherwise(0)
    )
    return df.withColumn(out, level).drop("_l", "_w", "_c", "_f", "_j", "_two", "_first", "_i")


def pick_websites(df: DataFrame, key: str, addresses: str, business: str, legal: str) -> DataFrame:
    """key, website: the best of each firm's addresses that is no platform; firms without one are left out.

    Best is, in order: the address that tells a name most, and the business name (or the only one) most; .com before other general endings before the
    rest; a bare domain; a home page; the order filed, which alone decides where no address tells a name.
    """
    parts = F.filter(F.transform(F.flatten(F.transform(addresses, lambda a: F.split(F.trim(F.coalesce(a, F.lit(""))), "[;\\s]+"))), lambda p: F.regexp_replace(p, "[.,;:)]+$", "")), lambda p: p != "")
    rows = df.select(key, F.coalesce(business, legal).alias("_n1"), F.col(legal).alias("_n2"), F.posexplode(parts).alias("_at", "_address"))
    rows = rows.withColumn("_host", host_of(F.col("_address"))).where(F.col("_host").isNotNull() & ~is_platform(F.col("_host")))
    rows = rows.withColumns({"_domain": registrable(F.col("_host")), "_url": F.when(F.rlike("_address", F.lit("(?i)^https?://")), F.col("_address")).otherwise(F.concat(F.lit("http://"), F.col("_address")))})
    rows = rows.withColumn("_label", F.substring_index("_domain", ".", 1))
    rows = with_match_level(with_match_level(rows, "_label", "_n1", "_m1"), "_label", "_n2", "_m2")
    ending = F.substring_index("_host", ".", -1)
    tail = F.regexp_extract("_url", "^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    port = F.rlike("_url", F.lit("^[a-zA-Z]+://[^/?#]*:[0-9]+"))
    order = [F.greatest("_m1", "_m2"), F.col("_m1"), F.when(ending == "com", 2).when(ending.isin("net", "org", "co", "us", "io"), 1).otherwise(0), (F.col("_host") == F.col("_domain")).cast("int"), (tail.isin("", "/") & ~port).cast("int")]
    some = F.max(order[0]).over(Window.partitionBy(key)) > 0
    rank = F.when(some, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], (-F.col("_at")).alias("at"))).otherwise(F.struct(*[F.lit(0).alias(f"o{i}") for i in range(len(order))], (-F.col("_at")).alias("at")))
    return rows.withColumn("_rank", rank).groupBy(key).agg(F.max_by("_url", "_rank").alias("website"))


def is_real_icon(status: Column, body: Column) -> Column:
    """Whether an answer is an image of more than a few bytes."""
    head = F.regexp_replace(F.hex(F.substring(body, 1, 16)), "^(?:20|09|0A|0B|0C|0D)+(?=(?:..)*$)", "")
    starts = F.lit(False)
    for s in IMAGE_STARTS:
        starts = starts | F.startswith(head, F.lit(s))
    return F.coalesce((status == 200) & (F.octet_length(body) >= 64) & starts, F.lit(False))
