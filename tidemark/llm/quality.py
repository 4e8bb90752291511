"""Quality rules: base counts of a text, and the divergence of its histograms from its language's reference.

A text is compared in two histograms: of character classes, and of its language's common words (the last
bin takes all other words). The reference of a language is the middle histogram of its documents that pass the
base rules, over the whole corpus. Distances are Jensen-Shannon distances with base 2, so they lie in 0 to 1.
Everything is an expression of Spark's own functions; a text never leaves its row, so there is no shuffle but that of the
references, which are one row for each language that has a word list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, saved

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["class_counts", "common_counts"]
VERDICT = ["base_failed", "class_distance", "common_distance", "kept"]

# Frequent function words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    "en": "the of and to in a is that for it was on are as with be at by this from".split(),
    "es": "de la que el en y a los del se las por un para con no una su al es".split(),
    "fr": "de la le et les des en un du une que est dans qui par pour au sur pas plus".split(),
}
# The character classes; what fits none of them is counted as other.
CLASSES = {"lower": "a-zß-öø-ÿ", "upper": "A-ZÀ-ÖØ-Þ", "digit": "0-9", "point": ".,;:!?'\"()\\-", "symbol": "#*$%&|<>@^~_=+{}\\[\\]\\\\/`"}
#: Parts of one at which shares are told apart in the references.
GRAIN = 10_000


@dataclass(frozen=True)
class Limits:
    """Bounds of the verdict. The guards are numbers of words: the common words count only from theirs on, the classes have a wider bound below theirs."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_class_distance: float = 0.2
    class_guard_words: int = 150
    short_class_distance: float = 0.28  # for texts under that guard, whose histograms vary more
    max_common_distance: float = 0.27
    common_guard_words: int = 150


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long); a null text counts as empty."""
    taken = set(df.columns)
    tmp = {k: next(c for c in (f"_{k}{i}" for i in range(99)) if c not in taken) for k in ("t", "w", "h", "s", "d", "l")}
    t, w, h, s, d, lines = (F.col(tmp[k]) for k in ("t", "w", "h", "s", "d", "l"))
    bare = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )
    no_longs = F.array().cast("array<bigint>")
    df = df.withColumn(tmp["t"], F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(tmp["w"], F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+")))
    df = df.withColumn(tmp["l"], F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""))
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, f"[{SPACE}]+", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        tmp["h"]: F.when(F.size(w) >= 3, windows).otherwise(no_longs),
    })
    df = df.withColumn(tmp["s"], F.sort_array(h))
    # windows found twice or more, by their neighbours in sorted order
    df = df.withColumn(tmp["d"], F.array_distinct(F.filter(s, lambda x, j: (j > 0) & (x == F.get(s, j - 1)))))
    df = df.withColumn("n_repeat_words", F.when(F.size(d) == 0, F.lit(0)).otherwise(_covered(_places(h, d))).cast("long"))
    return df.drop(*tmp.values())


def _places(hashes: Column, twice: Column) -> Column:
    """Ordered positions of the windows that are found twice: by search in a short list, else by sorting."""
    none = F.lit(None).cast("int")
    found = F.filter(F.transform(hashes, lambda x, i: F.when(F.array_contains(twice, x), i).otherwise(none)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))
    # bound once by the outer lambda, so the sort isn't done again for each element
    by_sort = F.flatten(F.transform(F.array(pairs), lambda p: F.transform(F.filter(p, lambda x, j: same(x, F.get(p, j + 1)) | ((j > 0) & same(x, F.get(p, j - 1)))), lambda x: x["i"])))
    return F.when(F.size(twice) <= 32, found).otherwise(F.sort_array(by_sort))


def _covered(places: Column) -> Column:
    """Words that windows of three, beginning at these ordered places, cover."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, start, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")), lambda acc: acc["n"])


def class_counts(text: Column) -> Column:
    """How many characters that aren't white space fall in each class, those of no class last."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")
    known = lambda t: F.array(F.length(t), *[F.length(t) - F.length(F.regexp_replace(t, f"[{x}]+", "")) for x in CLASSES.values()])
    rest = lambda k: F.concat(F.slice(k, 2, len(CLASSES)), F.array(2 * k[0] - F.aggregate(k, F.lit(0), lambda a, x: a + x)))
    return _bound(_bound(bare, known), rest)


def common_counts(text: Column, lang: Column) -> Column:
    """How often each common word is found: a list for the document's language, or for every language if it has none."""
    every = sorted({w for words in COMMON.values() for w in words})
    line = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-zß-ÿ]+", " ")
    found = F.filter(F.split(line, " "), lambda w: w.isin(every))
    lists = F.array(*[F.struct(F.lit(k).alias("lang"), F.array(*map(F.lit, v)).alias("words")) for k, v in COMMON.items()])
    own = F.filter(lists, lambda x: (x["lang"] == lang) | F.coalesce(~lang.isin(*COMMON), F.lit(True)))
    count = lambda f, w: F.size(f) - F.size(F.array_remove(f, w))
    return _bound(found, lambda f: F.transform(own, lambda x: F.struct(x["lang"].alias("lang"), F.transform(x["words"], lambda w: count(f, w)).alias("n"))))


def _bound(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shares(counts: Column, total: Column, rest: bool) -> Column:
    """Counts as shares of a total, with what is left of 1 in a last bin if so wished."""
    out = F.transform(counts, lambda c: F.least(F.lit(1.0), F.coalesce(F.try_divide(c, total), F.lit(0.0))))
    return _bound(out, lambda s: F.concat(s, F.array(F.greatest(F.lit(0.0), 1.0 - F.aggregate(s, F.lit(0.0), lambda a, x: a + x))))) if rest else out


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length, by base 2."""

    def part(x: Column, y: Column) -> Column:
        mean = (x + y) / 2
        of = lambda v: F.when(v > 0, v * F.log2(v / mean)).otherwise(0.0)
        return of(x) + of(y)

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda a, x: a + x) / 2))


def _base_failed(limits: Limits) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))


def features(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds the base counts, class_counts and common_counts."""
    df = base_counts(df.drop(*BASE, *FEATURES, *VERDICT), text)
    return df.withColumns({"class_counts": class_counts(F.col(text)), "common_counts": common_counts(F.col(text), F.col(lang))})


def fit_references(counted: DataFrame, limits: Limits = Limits(), lang: str = "lang") -> DataFrame:
    """Of what features() gives, the middle histogram of each language over all documents that pass the base rules.

    Each bin is the median of its shares, exact at a grain of 1 / GRAIN: documents are counted by language, bin and share, which any order of
    partitions gives alike, and the counts are as many as there are shares at most. The bins are scaled to sum to one, so junk that is less than half of a language's
    documents hardly moves it. A row for each language in COMMON at most.
    """
    known = counted.where(F.col(lang).isin(*COMMON) & ~_base_failed(limits))
    every = F.concat(_classes(), shares(F.col("common_counts")[0]["n"], F.col("n_words"), True))
    counts = known.select(F.col(lang).alias("lang"), F.posexplode(every).alias("i", "v")).groupBy("lang", "i", F.floor(F.col("v") * GRAIN).alias("v")).agg(F.count("*").alias("n"))
    one = Window.partitionBy("lang", "i")
    middle = counts.withColumns({"up": F.sum("n").over(one.orderBy("v")), "all": F.sum("n").over(one)}).where(2 * F.col("up") >= F.col("all"))
    middle = middle.groupBy("lang", "i").agg(F.min("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("h"))
    scaled = lambda first, n: _bound(F.transform(F.slice("h", first, n), lambda x: x["v"].cast("double")), lambda a: F.transform(a, lambda x: F.coalesce(F.try_divide(x, F.aggregate(a, F.lit(0.0), lambda s, y: s + y)), F.lit(0.0))))
    return middle.select("lang", scaled(1, len(CLASSES) + 1).alias("c"), scaled(len(CLASSES) + 2, 2**30).alias("w"))


def _classes() -> Column:
    return shares(F.col("class_counts"), F.col("word_chars"), False)


def judged(counted: DataFrame, references: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds base_failed, class_distance, common_distance and kept to what features() gives."""
    refs = references.collect()  # at most one row for each language in COMMON
    numbers = lambda xs: F.array(*[F.lit(float(x)) for x in xs if x is not None])
    near = {"class_distance": F.lit(None).cast("double"), "common_distance": F.lit(None).cast("double")}
    if refs:
        every = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), numbers(r["c"]).alias("c"), numbers(r["w"]).alias("w")) for r in refs])
        own = F.filter(every, lambda r: F.exists("common_counts", lambda x: x["lang"] == r["lang"]))
        # where the document's own language has no reference, the nearest of the others counts
        own = F.when(F.size(own) > 0, own).otherwise(every)
        by_class = _bound(_classes(), lambda h: F.array_min(F.transform(own, lambda r: js_distance(h, r["c"]))))
        pair = lambda x: F.transform(F.filter(every, lambda r: r["lang"] == x["lang"]), lambda r: js_distance(shares(x["n"], F.col("n_words"), True), r["w"]))
        by_word = F.array_min(F.flatten(F.transform("common_counts", pair)))
        near = {
            "class_distance": F.when(F.col("n_words") > 0, by_class),
            "common_distance": F.when(F.col("n_words") >= limits.common_guard_words, by_word),
        }
    most = F.when(F.col("n_words") >= limits.class_guard_words, limits.max_class_distance).otherwise(limits.short_class_distance)
    far = F.coalesce(F.col("class_distance") > most, F.lit(False)) | F.coalesce(F.col("common_distance") > limits.max_common_distance, F.lit(False))
    return counted.withColumns(near | {"base_failed": _base_failed(limits)}).withColumn("kept", ~F.col("base_failed") & ~far)


def quality(df: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Adds the base counts, base_failed, class_distance, common_distance (double, null under its guard) and kept.

    The columns in keep, or else all, are carried along. A document whose language has no word list is compared with
    every reference and takes the nearest; where there is no reference at all (an empty table) the distances are null and
    the base rules alone decide. Null and empty texts have no words and fail. Repeated rows give repeated results. The columns
    that it adds replace columns of the same names. What is counted is written to the shared folder once, and read for both the
    references and the verdict.
    """
    keep = [c for c in (keep or df.columns) if c not in BASE + FEATURES + VERDICT]
    counted = features(df, text, lang)
    names = {"lang": next(c for c in (f"_lang{i}" for i in range(99)) if c not in keep)}
    counted = saved(counted.select(*keep, F.col(lang).alias(names["lang"]), *BASE, *FEATURES), "quality", "zstd")
    return judged(counted, fit_references(counted, limits, names["lang"]), limits).drop(names["lang"], *FEATURES)
