"""Toxicity: a weighted lexicon matched by one Aho-Corasick automaton on folded text.

Folding makes look-alike letters, accents, digits and signs used as letters, and letters set apart by points into plain letters, in the
text and the lexicon alike. The lexicon is learned from labelled rows: starts of words that tell toxic documents from others, taken greedily while they
explain documents that no earlier one does. Words inside an exception phrase don't count. Each hit weighs by how rare its entry is in clean
texts, normalised by the text's length: what counts is by how much an entry is found more often than in a clean text of as many words. The score is a
logistic function of that.

The fit takes a bounded sample of labelled rows, about rows_per_class of each label, and gets counts of them; scoring covers every whole text.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value, saved, small_batches, worker_cache

# For a Latin letter those of other scripts that look like it, and digits and signs read as letters.
LOOK_ALIKES = {
    "a": "аαɑ",
    "b": "бвβ",
    "c": "сⅽ",
    "d": "ԁⅾ",
    "e": "еёε",
    "g": "ɡ",
    "h": "нһ",
    "i": "іїιɩⅰ",
    "j": "ј",
    "k": "кκ",
    "l": "ʟⅼ",
    "m": "мμⅿ",
    "n": "η",
    "o": "оөο",
    "p": "рρ",
    "q": "ԛ",
    "s": "ѕ",
    "t": "тτ",
    "u": "υ",
    "v": "νѵ",
    "w": "ԝω",
    "x": "хχ",
    "y": "уγ",
    "z": "з",
}
AS_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i", "|": "i", "@": "a", "$": "s", "€": "e", "£": "l"}
# Phrases in which a word of the lexicon isn't meant as an insult.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "clown fish", "clown nose", "circus clown", "idiot proof", "not stupid", "not an idiot", "not a loser", "not worthless", "not disgusting"]


def fold_table() -> dict[str, str]:
    """What each character becomes, by rule: the base letter of its compatibility form, then look-alikes and signs."""
    out, look_alikes = {}, {c: latin for latin, others in LOOK_ALIKES.items() for c in others}
    blocks = (range(0xAA, 0x250), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0x2460, 0x2500), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800))
    for c in [chr(i) for b in blocks for i in b] + list(look_alikes) + list(AS_LETTERS):
        base = unicodedata.normalize("NFKD", c).lower()[:1]
        base = look_alikes.get(base, base)
        base = AS_LETTERS.get(base, base)
        if base != c and base.isascii() and base.isalnum():
            out[c] = base
    return out


def folded(text: Column) -> Column:
    """The words of a text in plain letters a-z, and others beyond ASCII, one space between."""
    t = F.lower(F.coalesce(text, F.lit("")))
    # zero-width characters and combining marks go; signs count as letters only next to one
    t = F.regexp_replace(t, "[\\u00AD\\u200B-\\u200F\\u2060\\uFEFF\\u0300-\\u036F]+", "")
    t = F.regexp_replace(t, "(?<=\\p{L})!(?=\\p{L})", "i")
    t = F.regexp_replace(t, "[|@$](?!\\p{L})(?<!\\p{L}.(?=\\d))", " ")
    table = fold_table()
    t = F.translate(t, "".join(table), "".join(table.values()))
    # letters set apart: t.r.a.s.h
    t = F.regexp_replace(t, "(?<=(?<![a-z])[a-z])[.\\-_*](?=[a-z](?![a-z]))", "")
    return F.btrim(F.regexp_replace(t, "[\\x00-\\x60\\x7B-\\x7F]+", " "), F.lit(" "))


def fold_words(text: str) -> str:
    """folded() for a lexicon's entries, which have plain letters only."""
    return " ".join("".join(AS_LETTERS.get(c, c) for c in w) for w in text.lower().split())


@dataclass(frozen=True)
class Lexicon:
    """Starts of words (or words, with a space behind) and how often they are found in a word of a clean text."""

    rates: dict[str, float]
    exceptions: tuple[str, ...]
    bias: float
    slope: float

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + self.slope * np.log1p(evidence), -30, 30)))


def evidence(counts: Counter, n: int, rates: dict[str, float]) -> float:
    """By how much a text of n words has more of the lexicon than a clean text of that length: log likelihood ratios against the clean rates."""
    out = 0.0
    for p, c in counts.items():
        usual = n * rates[p]
        if c > usual:
            out += c * math.log(c / usual) - (c - usual)
    return out


def matcher(entries: Iterable[str], exceptions: tuple[str, ...]):
    a = ahocorasick.Automaton()
    for p in entries:
        a.add_word(f" {p}", (p, len(p)))
    for p in exceptions:
        if f" {p} " not in a:
            a.add_word(f" {p} ", (None, len(p) + 1))
    if len(a):
        a.make_automaton()
    return a if len(a) else None


def hits_of(line: str, a) -> Counter:
    """How often each entry is found in a folded line, outside exception phrases; in one pass over what is found."""
    found, but = [], []
    for end, (p, n) in a.iter(f" {line} "):
        (but if p is None else found).append((end - n, end, p))
    if not but:
        return Counter(p for _, _, p in found)
    found.sort(key=lambda x: x[0])
    but.sort(key=lambda x: x[0])
    out, i, reach = Counter(), 0, -1  # reach: how far the phrases go that begin at or before the hit
    for s, e, p in found:
        while i < len(but) and but[i][0] <= s:
            reach = max(reach, but[i][1])
            i += 1
        if e > reach:
            out[p] += 1
    return out


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows_per_class: int = 3000, least: int = 5, exceptions: list[str] = EXCEPTIONS) -> Lexicon:
    """Learns from the rows of df that labels (doc_id, label 0 or 1) name; other labels and null texts are left out.

    rows_per_class bounds the labels, taken by a hash of their id, whose rows are looked at, and again the different texts of each label that they lead to; so few ids are
    broadcast to find their texts. Spark counts what is found in these rows; the driver gets counts, no text. least is the fewest times that an entry, or documents that an exception, must be found. Entries are
    starts of four to ten letters, or shorter words. Rows of one label with the same folded text count once.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    sizes = {int(r[0]): r[1] for r in known.groupBy("y").count().collect()}
    taken = _bounded(known, "id", sizes, rows_per_class)
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(taken), "id")
    rows = saved(rows.select("y", folded(F.col("text")).alias("line")).where("line <> ''").distinct(), "labelled")
    found = {int(r[0]): r[1] for r in rows.groupBy("y").count().collect()}
    if max(found.values(), default=0) > 2 * rows_per_class:  # ids that many texts share
        rows = saved(_bounded(rows, "line", found, rows_per_class), "labelled")
    words = rows.select("y", F.explode(F.split("line", " ")).alias("w")).groupBy("w").agg(F.count_if(F.col("y") == 1).alias("c1"), F.count_if(F.col("y") == 0).alias("c0"))
    n1, n0 = words.agg(F.coalesce(F.sum("c1"), F.lit(0)), F.coalesce(F.sum("c0"), F.lit(0))).first()
    starts = F.when(F.length("w") < 4, F.array(F.concat("w", F.lit(" ")))).otherwise(F.transform(F.sequence(F.lit(4), F.least(F.lit(10), F.length("w"))), lambda k: F.substring("w", F.lit(1), k)))
    counts = words.select(F.explode(starts).alias("p"), "c1", "c0").groupBy("p").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    sure = odds / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    best = counts.where(F.col("c1") >= least).select("p", "c0", odds.alias("x"), sure.alias("z")).where("x > 0.7 and z > 2.5").orderBy(F.desc("z"), "p")  # all of them: words of one copied text may rank first
    rates = {r["p"]: (r["c0"] + 0.5) / (n0 + 1) for r in best.collect()}
    but = {fold_words(p) for p in exceptions} | _learned_exceptions(rows, rates, least)
    clean = _clean_counts(rows, rates, tuple(sorted(but)))
    rates = {p: (clean.get(p, 0) + 0.5) / (n0 + 1) for p in rates}  # without hits in exception phrases
    rates = {p: rates[p] for p in _covering(_strong(rows, rates, tuple(sorted(but))), least)}
    but = tuple(sorted(x for x in but if any(f" {x} ".find(f" {p}") >= 0 for p in rates)))
    # of a line only its label and a number
    seen = rows.select("y", _told(rates, but)(F.col("line")).alias("x")).groupBy("y", F.round("x", 6).alias("x")).count().orderBy("y", "x").collect()
    y, x, n = (np.array([r[c] for r in seen], float) for c in ("y", "x", "count"))
    return Lexicon(rates, but, *_logistic(x, y, n, sizes))


def _bounded(df: DataFrame, by: str, sizes: dict[int, int], most: int) -> DataFrame:
    """About so many rows of each label y, by a hash of a column."""
    part = F.when(F.col("y") == 1, min(1.0, most / max(1, sizes.get(1, 0)))).otherwise(min(1.0, most / max(1, sizes.get(0, 0))))
    return df.where(F.pmod(F.xxhash64(by), F.lit(1_000_000)) < part * 1_000_000)


def _told(rates: dict[str, float], exceptions: tuple[str, ...]):
    """line -> evidence"""

    @F.arrow_udf("double")
    def run(lines: pa.Array) -> pa.Array:
        a = worker_cache(("toxicity-fit", "evidence", tuple(sorted(rates.items())), exceptions), lambda: matcher(rates, exceptions))
        return pa.array([evidence(hits_of(x, a), x.count(" ") + 1, rates) if a else 0.0 for x in lines.to_pylist()], pa.float64())

    return run


def _clean_counts(rows: DataFrame, rates: dict[str, float], exceptions: tuple[str, ...]) -> dict[str, int]:
    """How often each entry stands in lines of label 0."""

    @F.arrow_udf("array<struct<p:string,n:bigint>>")
    def run(lines: pa.Array) -> pa.Array:
        a = worker_cache(("toxicity-fit", "clean", tuple(rates), exceptions), lambda: matcher(rates, exceptions))
        return pa.array([[{"p": p, "n": n} for p, n in hits_of(x, a).items()] if a else [] for x in lines.to_pylist()], pa.list_(pa.struct([("p", pa.string()), ("n", pa.int64())])))

    found = rows.where("y = 0").select(F.explode(run("line")).alias("f")).groupBy("f.p").agg(F.sum("f.n").alias("n"))
    return {r["p"]: r["n"] for r in found.collect()}


def _strong(rows: DataFrame, rates: dict[str, float], exceptions: tuple[str, ...], sure: float = 5.0) -> list[tuple[int, frozenset[str], int]]:
    """Label and entries of which a line has much more than a clean one, with the number of such lines; the entries of lines that have any."""
    names = sorted(rates)
    number = {p: i for i, p in enumerate(names)}

    @F.arrow_udf("array<int>")
    def run(lines: pa.Array) -> pa.Array:
        a = worker_cache(("toxicity-fit", "strong", tuple(sorted(rates.items())), exceptions), lambda: matcher(rates, exceptions))
        out = []
        for x in lines.to_pylist():
            n = x.count(" ") + 1
            out.append(sorted(number[p] for p, c in hits_of(x, a).items() if evidence(Counter({p: c}), n, rates) >= sure) if a else [])
        return pa.array(out, pa.list_(pa.int32()))

    found = rows.select("y", run("line").alias("ps")).groupBy("y", "ps").count().orderBy("y", "ps").collect()
    return [(r["y"], frozenset(names[i] for i in r["ps"]), r["count"]) for r in found]


def _covering(rows: list[tuple[int, frozenset[str], int]], least: int, part: float = 0.01, explained: float = 0.5) -> list[str]:
    """Entries taken one by one, each for the toxic documents that it explains, less those others that it would.

    An entry explains a document that has much more of it than a clean one. An explained document counts less for what comes after. So entries that only copies
    of one document share, beside their real cause, soon add less than the bound: least documents, or the given part of the toxic ones.
    """
    toxic = [[float(n), ps] for y, ps, n in rows if y == 1]
    clean: Counter = Counter()
    for y, ps, n in rows:
        clean.update({p: n for p in ps} if y == 0 else {})
    bound, out = max(least, part * sum(n for n, _ in toxic)), []
    while True:
        gain: dict[str, float] = {}
        for x, ps in toxic:
            for p in ps:
                gain[p] = gain.get(p, 0.0) + x
        p = max((p for p in gain if not any(p.startswith(q) or q.startswith(p) for q in out)), key=lambda p: (gain[p] - 2 * clean[p], len(p), p), default=None)
        if p is None or gain[p] - 2 * clean[p] < bound:
            return out
        out.append(p)
        for row in toxic:
            if p in row[1]:
                row[0] *= explained


def phrases_around(line: str, a) -> set[str]:
    """Two-word phrases that hold an entry."""
    padded, out = f" {line} ", set()
    for end, (_, n) in a.iter(padded):
        first, last = end - n, padded.find(" ", end)  # around the word that the entry begins
        before, after = padded.rfind(" ", 0, first), padded.find(" ", last + 1)
        if before >= 0:
            out.add(padded[before + 1 : last])
        if after >= 0:
            out.add(padded[first + 1 : after])
    return {p for p in out if " " in p}


def _learned_exceptions(rows: DataFrame, rates: dict[str, float], least: int) -> set[str]:
    """Two-word phrases around entries that several clean documents hold and no toxic one."""

    @F.arrow_udf("array<string>")
    def run(lines: pa.Array) -> pa.Array:
        a = worker_cache(("toxicity-fit", "phrases", tuple(rates)), lambda: matcher(rates, ()))
        return pa.array([sorted(phrases_around(x, a)) if a else [] for x in lines.to_pylist()], pa.list_(pa.string()))

    found = rows.select("y", F.explode(run("line")).alias("p")).groupBy("p").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    return {r["p"] for r in found.where((F.col("n0") >= least) & (F.col("n1") == 0)).collect()}


def _logistic(evidence: np.ndarray, y: np.ndarray, n: np.ndarray, sizes: dict[int, int]) -> tuple[float, float]:
    """Bias and slope by Newton's method with a small ridge, of rows that stand for n each; without rows of both kinds every score is the label's share."""
    if not len(y) or y.min() == y.max():
        p = min(0.98, max(0.02, float((y * n).sum() / n.sum()) if len(y) else 0.0))
        return math.log(p / (1 - p)), 0.0
    x, of = np.stack([np.ones(len(y)), np.log1p(evidence)], 1), {k: n[y == k].sum() for k in (0, 1)}
    # each label weighs as it does among all labelled rows
    c = n * np.where(y == 1, sizes[1] / of[1], sizes[0] / of[0]) * n.sum() / sum(sizes.values())
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (c * (y - p)) - np.array([0, 0.1]) * b
        h = (x * (c * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 0.1])
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def score_udf(model: Lexicon):
    """folded line -> score and hits"""
    key = ("toxicity", hashlib.sha256(repr(model).encode()).hexdigest())

    @F.arrow_udf("score double, n_hits int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        a = worker_cache(key, lambda: matcher(model.rates, model.exceptions))
        for lines in batches:
            x, count = np.zeros(len(lines)), np.zeros(len(lines), np.int32)
            for i, line in enumerate(lines.to_pylist()):
                found = hits_of(line, a) if a and line else None
                if found:
                    x[i], count[i] = evidence(found, line.count(" ") + 1, model.rates), found.total()
            yield pa.StructArray.from_arrays([pa.array(model.score(x)), pa.array(count)], ["score", "n_hits"])

    return run


def toxicity(df: DataFrame, model: Lexicon, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score (0 to 1), n_hits and predicted (1 from 0.5 on) to the columns in keep, or else all.

    Null and empty texts have no hits and get the score of a text without any. Repeated rows give repeated results. The columns that it
    adds replace columns of the same names.
    """
    small_batches(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c not in ("score", "n_hits", "predicted")]
    out = df.select(*keep, score_udf(model)(folded(F.col(text))).alias("_found"))
    return out.select(*keep, "_found.score", "_found.n_hits", (F.col("_found.score") >= 0.5).cast("int").alias("predicted"))


by_value(__name__)
