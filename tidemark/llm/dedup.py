"""Near-duplicate classes: DartMinHash bands, exact checks of weighted shingles, connected components.

A text is a weighted set: its word shingles, each with the number of times that it stands there as weight. Equal texts (by their words) are one node
from the start, so a group of copies of any size costs one node. Nodes that share a band's hash are candidates. Within a bucket no list of all pairs is
made. First its centre, the node that meets most others in its buckets, is compared with the others, which takes as many comparisons as there are
members and settles most buckets; large buckets that still hold several classes get further centres, one each round. What is
then left are pairs of different classes, tested inside a join by bits of their sketches and then exactly, so only links leave it; large buckets
are spread over tasks by a salt.

A check is exact: the weighted Jaccard similarity, the sum of the lesser weights over the sum of the greater. A pair is left out if both already are in
one class, and otherwise by chance only: a pair at 0.8 lacks a common band 1 time in 30,000, and the bits of its sketch miss it 1 time in 7 million (both less above).
Every step is a join or a grouping by bucket or node, whose hot keys Spark splits or sums up beforehand; results of steps are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, saved, small, small_batches, spaced
from .darts import band_keys, mix, sketches

#: Words and texts worked on at once in a Python worker; longer texts are taken alone, whole.
WORDS_AT_ONCE, TEXTS_AT_ONCE = 150_000, 100
#: Longs of two bits a coordinate that tell about how alike two nodes are.
PRINT = 4
#: By how much a pair's similarity by those bits may fall short of the threshold. Of a pair at 0.8 each of 128 places agrees with 0.85, and fewer
#: than 86 do so with 1.3e-7 (binomial).
PRINT_SLACK = 0.24
#: Members in the open from which a bucket gets a further centre before its pairs are tested, at most so many times.
LARGE, ROUNDS = 20_000, 3
#: Members of a bucket that one task compares with the others.
SALTED = 500
#: Ids of candidates up to which they are broadcast to find their texts; more are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of so many word hashes; of all words where there are fewer."""
    out = np.zeros(max(1, len(words) - size + 1), np.uint64)
    for i in range(min(size, len(words))):
        out = mix(out ^ words[i : i + len(out)])
    return out


def bands_udf(size: int, k: int, rows: int, counted: bool):
    """line of words -> band hashes, then PRINT longs of two bits of 32 coordinates each; none for a line without words."""

    width = k // rows + PRINT

    def some(words: np.ndarray, at: np.ndarray) -> np.ndarray:
        owner, element, weight = [], [], []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            if b > a:
                e, n = np.unique(shingle_hashes(words[a:b], size), return_counts=True)
                owner.append(np.full(len(e), i))
                element.append(e)
                weight.append(n if counted else np.ones(len(e)))
        if not owner:
            return np.zeros((len(at) - 1, width), np.int64)
        found = sketches(np.concatenate(owner), np.concatenate(element), np.concatenate(weight).astype(float), len(at) - 1, k)
        bits = (found[:, : 32 * PRINT].astype(np.uint64) >> np.uint64(9) & np.uint64(3)).reshape(len(found), PRINT, 32)
        prints = (bits << (2 * np.arange(32, dtype=np.uint64))).sum(2, dtype=np.uint64)
        return np.concatenate([band_keys(found, rows), prints.view(np.int64)], 1)

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lines in batches:
            full = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
            split = pc.split_pattern(lines, " ")
            coded = split.flatten().dictionary_encode()
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
            words = hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64)
            ends = split.offsets.to_numpy().astype(np.int64)
            out, first = [], 0
            for last in range(1, len(lines) + 1):
                if last == len(lines) or ends[last + 1] - ends[first] > WORDS_AT_ONCE or last - first == TEXTS_AT_ONCE:
                    out.append(some(words, ends[first : last + 1]))
                    first = last
            keys = np.concatenate(out)[full] if out else np.zeros((0, width), np.int64)
            at = np.concatenate(([0], np.cumsum(full * width))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1)))

    return run


def weighted_shingles(line: str, size: int, counted: bool) -> np.ndarray:
    """A line's shingles as hashes, those found again with their number of times hashed in: two such sets have the Jaccard similarity of the weighted ones."""
    words = np.array([xxhash.xxh64_intdigest(w) for w in line.split(" ")], np.uint64)
    found = np.sort(shingle_hashes(words, size))
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    if not counted:
        return found[first].view(np.int64)
    again = np.arange(len(found)) - np.repeat(first, np.diff(np.append(first, len(found))))
    return np.where(again > 0, mix(found ^ mix(again.astype(np.uint64))), found).view(np.int64)


def shingles_udf(size: int, counted: bool):
    """line of words -> its set for exact checks"""

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lines in batches:
            sets = [weighted_shingles(x, size, counted) if x else np.zeros(0, np.int64) for x in lines.to_pylist()]
            at = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, class: every node of the edges (a, b) with the least node of its connected component.

    Large and small stars in turn: each round links all neighbours of a node to the least of them; a hub's neighbours are
    never put in one list.
    """
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    state = None
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("b > a").join(least, both.a == least.u).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: a node and its lower neighbours go to the least of them
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        joined = large.join(low, large.b == low.u)
        small = joined.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        edges = saved(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("class"))
        state = now


def _similar(x: Column, y: Column, threshold: float) -> Column:
    """Whether the Jaccard similarity of two sets reaches the threshold; where weights are counted in, that of the weighted sets."""
    n, least = F.size(x) + F.size(y), threshold / (1 + threshold)
    fits = (F.size(x) >= threshold * F.size(y)) & (F.size(y) >= threshold * F.size(x))
    return fits & (F.size(F.array_intersect(x, y)) >= least * n - 1e-9)


def _alike(prints: list[tuple[Column, Column]], threshold: float) -> Column:
    """Whether two sketches may be of sets of that similarity, by two bits of each coordinate; a quarter of unlike ones agree by chance."""
    low = 0x5555555555555555
    same = sum(F.bit_count(F.bitwise_not((x.bitwiseXOR(y)).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1))).bitwiseAND(F.lit(low))) for x, y in prints)
    return same >= 32 * len(prints) * (0.25 + 0.75 * threshold)


def _checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("_x"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("_y"))
    return pairs.join(one, "a").join(two, "b").where(_similar(F.col("_x"), F.col("_y"), threshold)).select("a", "b").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, rows: int = 5, bands: int = 26, weights: str = "count", key: str | None = None) -> DataFrame:
    """doc_id and class_id of each row: the least doc_id of all rows linked to it by similarity of the threshold or more.

    Two texts are linked if the Jaccard similarity of their word shingles, weighted by their counts, reaches the threshold; weights = "set" gives each weight 1. A text of
    fewer words than a shingle is one shingle. Null texts and texts without words are linked with nothing and have their own id as class. Texts, not ids, are linked: rows that share a doc_id but not their
    words may be of different classes. Repeated rows give repeated results. A row with a null id takes the class of
    its text's copies, null if there are none with an id; texts that only such rows have are linked with nothing. Texts of any length are compared whole. Other columns
    don't matter, whatever their names. With key the hash of a row's words is a third column of that name. An empty table gives an empty result.
    """
    if weights not in ("count", "set"):
        raise ValueError("weights are count or set")
    spark, counted = df.sparkSession, weights == "count"
    small_batches(spark)
    docs = df.select(F.col(doc_id).alias("id"), spaced(F.col(text)).alias("line"))
    all_rows = saved(docs.select("id", F.when(F.col("line") != "", F.unhex(F.md5("line"))).alias("key"), bands_udf(size, bands * rows, rows, counted)(F.col("line")).alias("bands")), "bands")
    nodes = all_rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands")).where("id is not null")
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once
    member = nodes.select("node", F.explode(F.slice("bands", 1, bands)).alias("bucket"))
    shared = member.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n")
    shared = saved(shared, "buckets")
    member = saved(member.join(shared, "bucket", "left_semi"), "members")
    sets = _sets(df, doc_id, text, nodes, member, shingles_udf(size, counted))

    # first each bucket's centre with the others: the node that meets most others in all its buckets
    weight = member.join(shared, "bucket").groupBy("node").agg(F.sum("n").alias("w"))
    member = saved(member.join(weight, "node"), "weighed")
    centre = F.min_by("node", F.struct(-F.col("w"), F.col("node")))
    tried = saved(member.groupBy("bucket").agg(centre.alias("centre")), "centres")
    classes = components(_checked(_pairs(member.join(tried, "bucket").where("node <> centre")), sets, threshold))
    known, largest = _open(member, classes)
    # large buckets that still hold several classes get further centres
    for _ in range(ROUNDS if largest > LARGE else 0):
        some = known.where(F.col("n") > LARGE)
        new = some.join(tried.withColumnRenamed("centre", "node"), ["bucket", "node"], "left_anti").groupBy("bucket").agg(centre.alias("centre"), F.min_by("c", F.struct(-F.col("w"), F.col("node"))).alias("own"))
        new = saved(new, "centres")
        links = _checked(_pairs(some.join(new, "bucket").where("c <> own")), sets, threshold)
        classes = components(links.union(classes.select(F.col("class").alias("a"), F.col("node").alias("b"))))
        (known, largest), tried = _open(member, classes), tried.union(new.select("bucket", "centre"))
        if largest <= LARGE:
            break
    # then all pairs of different classes in such buckets; the join itself checks them, so only links come out
    print_ = nodes.select("node", *[F.get("bands", F.lit(bands + i)).alias(f"p{i}") for i in range(PRINT)])
    open_ = known.join(print_, "node").join(sets, "node").withColumn("salts", F.ceil(F.col("n") / SALTED).cast("int"))
    open_ = saved(open_.drop("w", "n"), "open")
    # most buckets meet themselves as they are, in one exchange for both sides; large ones are dealt out
    few = open_.where("salts = 1").repartition("bucket")
    links = _links(few, few, ["bucket"], threshold)
    if largest > SALTED:
        many, keys = open_.where("salts > 1"), ["bucket", "salt"]
        one, two = many.withColumn("salt", F.pmod(F.hash("node"), F.col("salts"))), many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        links = links.union(_links(one.repartition(*keys), two.repartition(*keys), keys, threshold))
    classes = components(links.union(classes.select(F.col("class").alias("a"), F.col("node").alias("b"))))

    label = nodes.select("key", "node", "id").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = label.groupBy("class").agg(F.min("id").alias("class_id"))
    label = label.join(least, "class").select("key", "class_id")
    out = all_rows.select("id", "key").join(label, "key", "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), *([F.col("key").alias(key)] if key else []))


def _sets(df: DataFrame, doc_id: str, text: str, nodes: DataFrame, member: DataFrame, sets) -> DataFrame:
    """node and set of every node that shares a bucket, from the text of one of its rows."""
    wanted = nodes.select("node", "id", F.xxhash64("key").alias("hash")).join(member.select("node").distinct(), "node", "left_semi")
    wanted = small(saved(wanted, "wanted"), MAX_BROADCAST_IDS)
    lines = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(wanted, "id").select("node", "hash", spaced(F.col("text")).alias("line"))
    # an id may have other texts; repeated rows are put together
    lines = lines.where(F.xxhash64(F.unhex(F.md5("line"))) == F.col("hash")).groupBy("node").agg(F.first("line").alias("line"))
    return saved(lines.select("node", sets(F.col("line")).alias("set")), "shingles")


def _pairs(stars: DataFrame) -> DataFrame:
    return stars.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()


def _links(one: DataFrame, two: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Links (a, b) between different classes of the members (node, c, set and bits) that share the keys.

    Both sides are dealt out by their keys, whose groups are bounded, so there is no skew left for Spark to split.
    """
    one, two = one.alias("x"), two.alias("y")
    near = _alike([(F.col(f"x.p{i}"), F.col(f"y.p{i}")) for i in range(PRINT)], threshold - PRINT_SLACK)
    exact = _similar(F.col("x.set"), F.col("y.set"), threshold)
    match = (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & near & exact
    for k in keys:
        match = (F.col(f"x.{k}") == F.col(f"y.{k}")) & match
    return one.hint("merge").join(two, match).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()


def _open(member: DataFrame, classes: DataFrame) -> tuple[DataFrame, int]:
    """bucket, node, w, class c and n of the n members of each bucket that holds several classes, and the largest n."""
    known = member.join(classes, "node", "left").select("bucket", "node", "w", F.coalesce("class", "node").alias("c"))
    several = known.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n")
    known = saved(known.join(several, "bucket"), "known")
    return known, known.agg(F.max("n")).first()[0] or 0


by_value(__name__)
