"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint's 64 bits are cut into two blocks of 23 and one of 18. If two fingerprints differ in at most four places, then the first block differs in one place at most, or the second does, or
the third not at all: otherwise they would differ in five. For each block the fingerprints meet at the words of a covering code, its anchors. The code of 23 bits is
the binary Golay code: 4096 words, and every block is within three places of exactly one of them. A fingerprint's home is that anchor. Another fingerprint whose block differs in one place
lies within four places of that home, so it visits all anchors within four, 5.3 on average. The 18 bits are their own anchors. At each
anchor those at home are compared with all who visit, by all 64 bits.

Equal fingerprints are one node from the start, so copies of any number cost one. An anchor with many at home is dealt out by a salt. What leaves
an anchor isn't each link but stars: everyone whom its links join is linked to the first of them, which makes the same components and at most one row for each visitor.
For many fingerprints `fine` takes the first two blocks together: three places, shared out between their two anchors, or an equal third block. That compares a
hundred times fewer and replicates 26 times more; what is found is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, lower_ascii, saved, small, small_batches
from .dedup import components
from .periodic import words_of

#: The Golay code's generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a fixed value; bits of a block, and places within which every block has an anchor.
GENERATOR, BITS, RADIUS = 0xAE3, 23, 3
#: Bits that may differ.
DISTANCE = 4
#: At an anchor, fingerprints at home that one task compares with the visitors; more are dealt out.
SALTED = 4096
#: Words worked on at once in a Python worker, and entries of one comparison.
WORDS_AT_ONCE, CELLS = 100_000, 2_000_000
#: Different fingerprints from which `fine` pays: comparing them the plain way takes longer than replicating them.
FINE_FROM = 20_000_000


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each text's fingerprint: the bits set in over half of its hashes; zero for none."""
    out = np.zeros(len(first) - 1, np.uint64)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, first[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * counts > np.diff(first)[some, None], axis=1).view(">u8").reshape(-1)
    return out


def fingerprints(texts: pa.Array, size: int, seed: int) -> np.ndarray:
    """Of each text: XXH64 of every run of so many words, one space between, or of all words where there are fewer."""
    data, at, first = words_of(texts)
    lengths = np.diff(at)
    line = np.full(len(data) + len(lengths), 32, np.uint8)
    line[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data
    at = at + np.arange(len(at))
    n = np.diff(first)
    runs = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    ends = np.concatenate(([0], np.cumsum(runs)))
    own = np.repeat(np.arange(len(n)), runs)
    word = first[own] + np.arange(len(own)) - ends[own]
    begin, end = at[word], at[np.minimum(word + size, first[own + 1])] - 1
    raw, digest = line.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], seed) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(own))
    return majority(hashes, ends)


def fingerprint_udf(size: int, seed: int):
    """text -> fingerprint, as a signed long"""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // 6
            out, a = np.zeros(len(texts), np.uint64), 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WORDS_AT_ONCE)))
                out[a:b] = fingerprints(texts.slice(a, b - a), size, seed)
                a = b
            yield pa.array(out.view(np.int64))

    return run


@cache
def errors() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The remainder of each block's bits by the generator, as a table for its lower and upper bits; all patterns of up to six places by remainder and weight, with where each remainder's begin."""

    def remainder(x: int) -> int:
        for k in range(BITS - 1, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    one = [remainder(1 << k) for k in range(BITS)]
    table = np.zeros(1 << BITS, np.uint16)
    for k in range(BITS):
        table[1 << k : 2 << k] = table[: 1 << k] ^ np.uint16(one[k])
    patterns = np.array([sum(1 << k for k in places) for w in range(RADIUS + DISTANCE) for places in combinations(range(BITS), w)], np.int64)
    weight = np.bitwise_count(patterns.astype(np.uint64)).astype(np.int64)
    order = np.lexsort((patterns, weight, table[patterns]))
    starts = np.searchsorted(table[patterns][order], np.arange((1 << 11) + 1))
    return table, patterns[order], np.maximum(weight[order] - RADIUS, 0), starts


def anchors(block: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which block, which anchor, and how many places further than the radius it is: all anchors of 23-bit blocks within the radius and so many places more."""
    table, patterns, beyond, starts = errors()
    of = table[block].astype(np.int64)
    n = starts[of + 1] - starts[of]
    row = np.repeat(np.arange(len(block)), n)
    at = starts[of[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    near = beyond[at] <= most
    row, at = row[near], at[near]
    return row, block[row] ^ patterns[at], beyond[at]


def blocks(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two blocks of 23 bits and one of 18."""
    u = prints.view(np.uint64)
    low = np.uint64((1 << BITS) - 1)
    return (u & low).astype(np.int64), (u >> np.uint64(BITS) & low).astype(np.int64), (u >> np.uint64(2 * BITS)).astype(np.int64)


def visits(prints: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which fingerprint, the anchor's key (the block's number above), and whether the anchor is its home."""
    one, two, three = blocks(prints)
    out = [(np.arange(len(prints)), three, np.ones(len(prints), bool))]
    if fine:
        row, a, x = anchors(one, 3)
        # each anchor of the first block with those of the second that are left so many places
        other, b, y = anchors(two, 3)
        start = np.searchsorted(other, np.arange(len(prints) + 1))
        n = (start[1:] - start[:-1])[row]
        i = np.repeat(np.arange(len(row)), n)
        j = start[row[i]] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        fits = x[i] + y[j] <= 3
        i, j = i[fits], j[fits]
        out.append((row[i], (1 << 60) | (a[i] << BITS) | b[j], (x[i] == 0) & (y[j] == 0)))
    else:
        for k, block in enumerate((one, two)):
            row, anchor, x = anchors(block, 1)
            out.append((row, ((k + 1) << 60) | anchor, x == 0))
    row, key, home = (np.concatenate(x) for x in zip(*out))
    # every home block within the radius has one anchor only, so a home is told by no distance beyond it
    return row, key, home


def visits_udf(fine: bool):
    """fingerprint -> anchors that it visits, and of each whether it is at home there"""

    @F.arrow_udf("array<struct<anchor:bigint,home:boolean>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prints in batches:
            row, key, home = visits(prints.to_numpy(zero_copy_only=False), fine)
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(len(prints) + 1)).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(key[order]), pa.array(home[order])], ["anchor", "home"]))

    return run


def stars(prints: np.ndarray, home: np.ndarray, distance: int) -> np.ndarray:
    """Rows (first, other): what the links between one anchor's homes and all its visitors join, each linked to the least."""
    prints = prints.view(np.uint64)
    at_home = np.flatnonzero(home)
    label = np.arange(len(prints))
    step = max(1, CELLS // max(1, len(prints)))
    for a in range(0, len(at_home), step):
        some = at_home[a : a + step]
        near = np.bitwise_count(prints[some, None] ^ prints[None, :]) <= distance
        for r in np.flatnonzero(near.sum(1) > 1):
            own = np.unique(label[near[r]])
            if len(own) > 1:
                label[np.isin(label, own)] = own[0]
    other = np.flatnonzero(label != np.arange(len(prints)))
    return np.stack([prints[label[other]], prints[other]], 1).view(np.int64)


def compare(distance: int):
    """Sorted rows (anchor, salt, home, fp) -> stars (a, b) of each anchor and salt. A task holds one of these at a time."""

    def told(key: np.ndarray, prints: np.ndarray, home: np.ndarray) -> np.ndarray:
        edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True])))
        out = [np.zeros((0, 2), np.int64)]
        size = np.diff(edge)
        count = np.add.reduceat(home.astype(np.int64), edge[:-1]) if len(size) else size
        for g in np.flatnonzero((size > 1) & (count > 0)):
            out.append(stars(prints[edge[g] : edge[g + 1]], home[edge[g] : edge[g + 1]], distance))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(links: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

        kept: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2)], 1), batch.column(3).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            if kept and (kept[-1][0][-1] != now[0][-1]).any():
                key, prints, home = (np.concatenate(x) for x in zip(*kept, now))
                last = int(np.flatnonzero((key != key[-1]).any(1))[-1]) + 1
                yield send(told(key[:last], prints[:last], home[:last]))
                kept = [(key[last:], prints[last:], home[last:])]
            else:
                kept.append(now)
        if kept:
            yield send(told(*(np.concatenate(x) for x in zip(*kept))))

    return run


def links(nodes: DataFrame, fine: bool, distance: int = DISTANCE) -> DataFrame:
    """(a, b): pairs of fingerprints (column fp, all different) that make the components of those at the distance or less."""
    spark = nodes.sparkSession
    met = saved(nodes.select("fp", F.explode(visits_udf(fine)("fp")).alias("v")).select("v.anchor", "v.home", "fp"), "anchors")
    # few anchors have many at home; each task of these takes a part of the homes and all visitors
    many = saved(met.where("home").groupBy("anchor").count().where(F.col("count") > SALTED).select("anchor", F.ceil(F.col("count") / SALTED).cast("int").alias("salts")), "large-anchors")
    met = met.join(small(many), "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    parts = met.select("anchor", "fp", "home", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), own.alias("own"))
    parts = parts.select("anchor", "salt", (F.col("home") & (F.col("salt") == F.col("own"))).alias("home"), "fp")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return parts.repartition(width, "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(compare(distance), "a long, b long")


def simhash_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, seed: int = 42, distance: int = DISTANCE, fine: bool | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row: the least doc_id of all rows linked to it, over any number of links.

    A text's fingerprint has the bits set in over half of the XXH64 hashes of its shingles: runs of `size` words, repeats included, of the text with A-Z in lower case. A text of fewer words is one
    shingle; null and empty texts have none and the fingerprint zero, which is linked like any other. Fingerprints that differ in `distance` bits or fewer (four at most) are
    linked. Texts of any length are hashed whole. Repeated rows give repeated results. A row with a null id takes the component of what it is linked to, null where nothing
    there has an id. Other columns don't matter, whatever their names. An empty table gives an empty result. `fine` chooses between two sets of anchors that find
    the same; if null, by the number of different fingerprints.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the anchors find what differs in up to {DISTANCE} bits")
    small_batches(df.sparkSession)
    rows = saved(df.select(F.col(doc_id).alias("doc_id"), fingerprint_udf(size, seed)(lower_ascii(F.col(text))).alias("fp")), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    fine = nodes.count() >= FINE_FROM if fine is None else fine
    joined = components(links(nodes.select("fp"), fine, distance))
    # linked fingerprints take their component's least id, all others their own
    linked = nodes.join(joined, nodes.fp == joined.node).select("fp", "least", "class")
    # the component's node may be none of those that point to it
    heads = joined.select(F.col("class").alias("node")).distinct().join(nodes, F.col("node") == nodes.fp).select("fp", "least", F.col("node").alias("class"))
    linked = saved(linked.union(heads).distinct(), "linked")
    least = linked.groupBy("class").agg(F.min("least").alias("component_id"))
    label = nodes.join(linked.select("fp", "class").join(least, "class").select("fp", F.col("component_id").alias("_c")), "fp", "left").select("fp", F.when(F.col("_c").isNotNull(), F.col("_c")).otherwise(F.col("least")).alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(label, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


by_value(__name__)
