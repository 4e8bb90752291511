"""Runs of repeated words by Karp-Miller-Rosenberg names.

All texts of an Arrow batch are worked on as one array of words. A name of level k stands for the 2**k words from a place on: two places of a text have
the same name where those words are the same. Level 0 numbers a text's words, and each further level numbers pairs of names of the one below by sorting
them. A place whose words stand only once in its text gets a name of its own and is left out above, so prose, whose longer passages hardly repeat, takes few levels.

A run of period q and of at least e periods is a stretch of places whose words are those q places on, at least (e - 1) q long. So some point of a grid lies in it, a
little closer than that stretch is long, at which the block of 2**k words, the largest with at most q words, equals the block q on. Points where the names
of these blocks agree are candidates: neighbours on the grid whose common extension reaches the next are one, and its ends are found by descending
the levels. A stretch found for several periods has the least, since the others are its multiples (Fine and Wilf).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, small_batches

#: Words worked on at once in a Python worker; longer texts are taken alone, whole.
WORDS_AT_ONCE = 200_000
#: The highest level of names; longer common extensions take several steps of it. It bounds what is kept to so many integers a word.
TOP = 12
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RESULT = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
ADDED = ["n_words", "runs", "collapsed"]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' bytes without what separates them, where each word begins in these (and the end), and each text's first word (and the end)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    b = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    word = ~((b == 32) | ((b >= 9) & (b <= 13)))
    begins = np.concatenate(([True], ~word[:-1]))[: len(b)]
    begins[at[at < len(b)]] = True
    begins &= word
    starts = np.flatnonzero(begins)
    before = np.concatenate(([0], np.cumsum(word)))
    return b[word], np.append(before[starts], before[-1]), np.searchsorted(starts, at)


def ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each key in their order, and whether it stands there more than once."""
    _, name, n = np.unique(keys, return_inverse=True, return_counts=True)
    return name, n[name] > 1


def levels(code: np.ndarray, text: np.ndarray, top: int = TOP) -> list[np.ndarray]:
    """Names of each level: equal where a text's words repeat, below zero and all different elsewhere. One more place ends each."""
    n = len(code)
    alone = -1 - np.arange(n + 1, dtype=np.int32)
    out = []
    at, keys = np.arange(n), text.astype(np.int64) * (int(code.max(initial=0)) + 1) + code
    while len(at) and len(out) <= top:
        name, twice = ranks(keys)
        if not twice.any():
            break
        level = alone.copy()
        level[at[twice]] = name[twice]
        out.append(level)
        step = 1 << (len(out) - 1)
        at = at[twice]
        at = at[at + step < n]
        at = at[level[at + step] >= 0]
        keys = level[at].astype(np.int64) * (n + 1) + level[at + step]
    return out


def extension(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, level: int, most: int, back: bool = False) -> np.ndarray:
    """How many words from places i on equal those from j on (or those before them, backwards), told up to about `most`; from the given level down."""
    f = np.zeros(len(i), np.int64)
    todo = np.arange(len(i))
    for k in range(level, -1, -1):
        own, todo = names[k], np.arange(len(i)) if k < level else todo
        for _ in range(-(-most >> k) if k == level else 1):
            x, y = (i[todo] - f[todo] - (1 << k), j[todo] - f[todo] - (1 << k)) if back else (i[todo] + f[todo], j[todo] + f[todo])
            same = own[np.maximum(x, 0)] == own[np.maximum(y, 0)]
            if back:
                same &= x >= 0
            todo = todo[same]
            f[todo] += 1 << k
            if not len(todo):
                break
    return f


def runs_of(code: np.ndarray, first: np.ndarray, least: int = 6, periods: int = 4, top: int = TOP) -> np.ndarray:
    """(text, start, length, period) of every run of the texts whose words begin at first[text]; by text, start and period."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    names = levels(code, text, top)
    found = []
    for k in range((int(sizes.max(initial=0)) // periods).bit_length()):
        if not names:
            break
        level = min(k, len(names) - 1)
        if level < k and len(names) <= top:  # no block of so many words repeats
            break
        # texts in which a block of this level repeats, and each of their periods from 2**k to below 2**(k+1)
        some = np.unique(text[names[level][:-1] >= 0])
        last = np.minimum((2 << k) - 1, np.where(sizes[some] >= least, sizes[some] // periods, 0))
        n_q = np.maximum(0, last - (1 << k) + 1)
        own = np.repeat(some, n_q)
        q = (1 << k) + np.arange(len(own)) - np.repeat(np.cumsum(n_q) - n_q, n_q)
        need = np.maximum(least, periods * q)
        step = need - q - (1 << level) + 1
        points = np.maximum(0, (sizes[own] - q - (1 << level)) // step + 1)
        pair = np.repeat(np.arange(len(own)), points)
        place = (np.arange(len(pair)) - np.repeat(np.cumsum(points) - points, points)) * step[pair] + first[own[pair]]
        hit = (names[level][place] >= 0) & (names[level][place] == names[level][place + q[pair]])
        pair, place = pair[hit], place[hit]
        if not len(place):
            continue
        most = int((step + (1 << level)).max())
        ahead = extension(names, place, place + q[pair], level, most)
        # points of one grid whose extension reaches the next point are one stretch
        joined = (pair[1:] == pair[:-1]) & (place[1:] == place[:-1] + step[pair[1:]]) & (ahead[:-1] >= step[pair[:-1]])
        one, other = np.flatnonzero(np.concatenate(([True], ~joined))), np.flatnonzero(np.concatenate((~joined, [True])))
        start = place[one] - extension(names, place[one], place[one] + q[pair[one]], level, most, back=True)
        length = place[other] + ahead[other] + q[pair[one]] - start
        long = length >= need[pair[one]]
        found.append(np.stack([own[pair[one]], start - first[own[pair[one]]], length, q[pair[one]]], 1)[long])
    if not found:
        return np.zeros((0, 4), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.concatenate(([True], (runs[1:, :3] != runs[:-1, :3]).any(1)))[: len(runs)]]  # the least period of a stretch
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def kept_words(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word is in no run, or in the first period of all that it is in."""
    change = np.zeros(first[-1] + 1, np.int64)
    start = first[runs[:, 0]] + runs[:, 1]
    np.add.at(change, start + runs[:, 3], 1)
    np.add.at(change, start + runs[:, 2], -1)
    return np.cumsum(change)[:-1] == 0


def joined_words(data: np.ndarray, at: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each text's kept words, one space between."""
    sizes = np.diff(at)
    spaced = np.full(len(data) + len(sizes), 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
    out = spaced[np.repeat(kept, sizes + 1)]
    ends = np.concatenate(([0], np.cumsum(np.where(kept, sizes + 1, 0))))[first]
    last = np.zeros(len(out), bool)  # the space after each text's last word goes
    full = ends[1:] > ends[:-1]
    last[ends[1:][full] - 1] = True
    ends = ends - np.concatenate(([0], np.cumsum(full)))
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out[~last])).cast(pa.string())


def found_in(texts: pa.Array, least: int, periods: int) -> pa.StructArray:
    data, at, first = words_of(texts)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    code = words.dictionary_encode().indices.to_numpy()
    runs = runs_of(code, first, least, periods)
    ends = np.searchsorted(runs[:, 0], np.arange(len(first)))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(RUN)))
    return pa.StructArray.from_arrays([pa.array(np.diff(first).astype(np.int64)), lists, joined_words(data, at, first, kept_words(runs, first))], ADDED)


def runs_udf(least: int, periods: int):
    """text -> n_words, runs, collapsed"""

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // 6
            cuts, last = [0], 0
            for i in range(len(texts)):
                if i > cuts[-1] and size[i] - last > WORDS_AT_ONCE:
                    cuts.append(i)
                    last = size[i - 1]
            cuts.append(len(texts))
            parts = [found_in(texts.slice(a, b - a), least, periods) for a, b in zip(cuts, cuts[1:]) if b > a]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())]))

    return run


def periodic_runs(df: DataFrame, text: str = "text", least: int = 6, periods: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Adds n_words, runs (start, length and period in words, by start and period) and collapsed (the words left, one space between) to the columns in keep, or else all.

    Words are what space and the control characters tab to carriage return separate. A run is a stretch of words with a least period q, at least `least` words and `periods` periods
    long (two at least), that can't be extended on either side. Collapsing drops what each run has after its first period. Null and empty texts have no words, no runs and an empty
    collapsed text. Texts of any length are looked at whole, with memory in proportion to the longest text; runs that overlap or nest are all told. Repeated rows
    give repeated results, an empty table an empty one. The columns that it adds replace columns of the same names.
    """
    if periods < 2 or least < 1:
        raise ValueError("a run has two periods at least")
    small_batches(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c not in ADDED]
    name = next(c for c in (f"_found{i}" for i in range(99)) if c not in keep)
    out = df.select(*keep, runs_udf(least, periods)(F.col(text)).alias(name))
    return out.select(*keep, *[F.col(name)[c].alias(c) for c in ADDED])


by_value(__name__)
