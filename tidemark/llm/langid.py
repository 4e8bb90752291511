"""Language identification by unigram pieces, summed over all segmentations.

Every language has probabilities of the pieces of one fixed public vocabulary. The probability of a word is the sum, over all
ways to cut it into pieces, of the products of their probabilities; a forward pass gives it. A text's score is the product over
its words. The probabilities are fitted by expectation and maximisation on the words of a bounded sample of labelled rows:
about rows_per_lang documents of each language, taken by a hash of their text. Words are worked out once in
each batch, many at a time, and kept while they last in a bounded store of the Python worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_value, small_batches, worker_cache
from .pieces import DEFAULT_MODEL, NORMAL, SPACE_MARK, USER, read_model

#: A character without a piece counts as one of this probability in every language.
UNKNOWN_P = 1e-7
#: Products over words of so many characters stay above zero; longer words are added up in logarithms.
SHORT = 40
#: Places of long words worked on at once; one that has more is taken alone, whole.
PLACES_AT_ONCE = 200_000
#: Words kept in a Python worker.
KEPT_WORDS = 350_000


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    pieces: tuple[str, ...]
    p: np.ndarray  # pieces x languages; a last row for what has no piece

    def key(self) -> str:
        return hashlib.sha256(self.p.tobytes() + repr((self.langs, self.pieces)).encode()).hexdigest()


def word_line(text: Column) -> Column:
    """The lower-case words of letters and their marks of a text, one space between; none for a text without a letter."""
    line = F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{M}]+", " "), F.lit(" "))
    return F.when(F.rlike(text, F.lit("\\p{L}")), line).otherwise("")


class Lattice:
    """All pieces in all places of a set of words, as arrays: word, begin, end, piece; ordered by end."""

    def __init__(self, words: list[str], arcs: dict[str, int]):
        unknown, get, bits = len(arcs), arcs.get, max(map(len, words), default=0).bit_length() + 1
        packed: list[int] = []  # word, begin and end of each place in one number
        pieces: list[int] = []
        self.n, self.size = len(words), np.array([len(w) + 1 for w in words], np.int64)
        for i, word in enumerate(words):
            marked, size = SPACE_MARK + word, len(word) + 1
            for a in range(size):
                at = (i << bits | a) << bits
                if get(marked[a], -1) < 0:
                    packed.append(at | a + 1)
                    pieces.append(unknown)
                for b in range(a + 1, size + 1):
                    k = get(marked[a:b])
                    if k is None:
                        break
                    if k >= 0:
                        packed.append(at | b)
                        pieces.append(k)
        code, piece, low = np.array(packed, np.int64), np.array(pieces, np.int64), (1 << bits) - 1
        order = np.lexsort((code >> 2 * bits, code & low))
        code, piece = code[order], piece[order]
        self.word, self.begin, self.end = code >> 2 * bits, code >> bits & low, code & low
        self.piece = np.where(piece == unknown, -1, piece)  # the last row of the probabilities
        self.long = bool(len(words)) and int(self.size.max()) > SHORT
        self.steps = np.searchsorted(self.end, np.arange(1, (self.end[-1] if len(self.end) else 0) + 2))

    def ends(self):
        """For each place but the first: its number, the pieces that end there, and where another word's begin among them."""
        for e in range(1, len(self.steps)):
            s = slice(self.steps[e - 1], self.steps[e])
            w = self.word[s]
            yield e, s, w, np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[word, place, language]: the sum over all segmentations up to that place, for short words."""
        alpha = np.zeros((self.n, len(self.steps), p.shape[1]))
        alpha[:, 0] = 1
        for e, s, w, first in self.ends():
            alpha[w[first], e] = np.add.reduceat(alpha[w, self.begin[s]] * p[self.piece[s]], first)
        return alpha

    def log_forward(self, p: np.ndarray, every: bool) -> np.ndarray:
        """The logarithm of that for words of any length: of every place, or else of the last only, holding no more places than a piece is long."""
        logs = np.log(p)
        ring = len(self.steps) if every else int((self.end - self.begin).max()) + 1
        alpha = np.full((self.n, ring, p.shape[1]), -np.inf)
        alpha[:, 0] = 0
        out = np.zeros((self.n, p.shape[1]))
        for e, s, w, first in self.ends():
            x = alpha[w, self.begin[s] % ring] + logs[self.piece[s]]
            most = np.maximum.reduceat(x, first)
            own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w))))
            alpha[w[first], e % ring] = most + np.log(np.add.reduceat(np.exp(x - most[own]), first))
            done = w[first][self.size[w[first]] == e]
            out[done] = alpha[done, e % ring]
        return alpha if every else out

    def log_p(self, p: np.ndarray) -> np.ndarray:
        """The log probability of each word in each language."""
        if self.long:
            return self.log_forward(p, False)
        return np.log(np.maximum(self.forward(p)[np.arange(self.n), self.size], 1e-300))

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected counts of pieces in one language (p has one column), words weighted by their counts."""
        at, q = (np.arange(self.n), self.size), p[self.piece, 0]
        if self.long:
            alpha, logs = self.log_forward(p, True)[:, :, 0], np.log(q)
            beta = np.full_like(alpha, -np.inf)
            beta[at] = 0
            for e in range(len(self.steps) - 1, 0, -1):
                s = slice(self.steps[e - 1], self.steps[e])
                np.logaddexp.at(beta, (self.word[s], self.begin[s]), beta[self.word[s], e] + logs[s])
            share = np.exp(alpha[self.word, self.begin] + logs + beta[self.word, self.end] - alpha[at][self.word])
        else:
            alpha = self.forward(p)[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[at] = 1
            for e in range(len(self.steps) - 1, 0, -1):
                s = slice(self.steps[e - 1], self.steps[e])
                np.add.at(beta, (self.word[s], self.begin[s]), beta[self.word[s], e] * q[s])
            share = alpha[self.word, self.begin] * q * beta[self.word, self.end] / np.maximum(alpha[at], 1e-300)[self.word]
        return np.bincount(self.piece % len(p), share * counts[self.word], minlength=len(p))


def lattices(words: list[str], arcs: dict[str, int], at_once: int = 20_000) -> Iterator[tuple[list[int], Lattice]]:
    """Lattices of words of about the same length, with the words' numbers."""
    short, at_once = [i for i, w in enumerate(words) if len(w) < SHORT], max(1, at_once)
    groups = [short[k : k + at_once] for k in range(0, len(short), at_once)]
    some: list[int] = []
    for i in sorted((i for i, w in enumerate(words) if len(w) >= SHORT), key=lambda i: len(words[i])):
        if some and (len(some) + 1) * len(words[i]) > PLACES_AT_ONCE:
            groups.append(some)
            some = []
        some.append(i)
    for group in [*groups, some] if some else groups:
        yield group, Lattice([words[i] for i in group], arcs)


def vocabulary(path: str) -> tuple[str, ...]:
    with open(path, "rb") as f:
        m = read_model(f.read())
    return tuple(dict.fromkeys(t for t, k in zip(m.texts, m.kinds) if k in (NORMAL, USER)))


def arcs_of(pieces: tuple[str, ...]) -> dict[str, int]:
    """Pieces with their numbers, and starts of pieces that are none themselves with -1."""
    return {p[:i]: -1 for p in pieces for i in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}


def fit(df: DataFrame, model_path: str = DEFAULT_MODEL, rows_per_lang: int = 600, rounds: int = 4, smooth: float = 0.02, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Piece probabilities of each language from the labelled rows of df; null languages and texts are left out.

    Words are counted by Spark. What reaches the driver is bounded by rows_per_lang rows' words for each language.
    """
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    langs = tuple(sorted(sizes))
    pieces = vocabulary(model_path)
    arcs = arcs_of(pieces)
    part = F.lit(0.0)
    for k, n in sizes.items():
        part = F.when(F.col(lang) == k, F.lit(min(1.0, rows_per_lang / n))).otherwise(part)
    taken = known.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < part * 1_000_000)
    words = taken.select(F.col(lang).alias("lang"), F.explode(F.split(word_line(F.col(text)), " ")).alias("word")).where("word <> ''")
    rows = words.groupBy("lang", "word").count().toPandas()
    p = np.full((len(pieces) + 1, len(langs)), 1.0 / len(pieces))
    for j, k in enumerate(langs):
        own = rows[rows.lang == k].sort_values("word")
        counts = own["count"].to_numpy(float)
        parts = [(x, counts[i]) for i, x in lattices(own.word.tolist(), arcs, len(own))]
        column = np.full((len(pieces) + 1, 1), 1.0 / len(pieces))
        column[-1] = UNKNOWN_P
        for _ in range(rounds if len(own) else 0):
            c = sum(x.expected(column, n) for x, n in parts)[:-1] + smooth
            column[:-1, 0] = c / c.sum()
        p[:, j] = column[:, 0]
    p[-1] = UNKNOWN_P
    return LanguageModel(langs, pieces, p)


class Scorer:
    """Log probabilities of words, with a bounded store of those seen."""

    def __init__(self, model: LanguageModel):
        self.model, self.arcs = model, arcs_of(model.pieces)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)))

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.place) + len(words) > KEPT_WORDS:
            self.clear()
        new = [w for w in words if w not in self.place]
        for numbers, lattice in lattices(new, self.arcs):
            n = len(self.place)
            while n + len(numbers) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(numbers)] = lattice.log_p(self.model.p)
            self.place.update(zip((new[i] for i in numbers), range(n, n + len(numbers))))
        return self.table[[self.place[w] for w in words]]

    def texts(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of each line in each language, and how many words it has."""
        split = pc.split_pattern(lines, " ")
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        table = self.words(coded.dictionary.to_pylist())
        out = np.zeros((len(lines), len(self.model.langs)))
        ids = coded.indices.to_numpy()
        full = np.flatnonzero(at[1:] > at[:-1])
        for k in range(0, len(full), 256):
            some = full[k : k + 256]
            a, b = at[some[0]], at[some[-1] + 1]
            out[some] = np.add.reduceat(table[ids[a:b]], at[some] - a)
        return out, at[1:] - at[:-1]


def predict_udf(model: LanguageModel):
    key = ("langid", model.key())

    @F.arrow_udf("lang_pred string, score double, log_p_char double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = worker_cache(key, lambda: Scorer(model))
        for lines in batches:
            logs, _ = scorer.texts(lines)
            empty = pc.equal(lines, "").to_numpy(zero_copy_only=False)
            best = logs.argmax(1)
            odds = np.exp(np.maximum(logs - logs[np.arange(len(best)), best][:, None], -700))
            score = np.where(empty, 0.0, 1.0 / odds.sum(1))
            names = ["und" if e else model.langs[b] for e, b in zip(empty, best)]
            chars = np.maximum(pc.utf8_length(lines).to_numpy(zero_copy_only=False), 1)
            usual = pa.array(logs[np.arange(len(best)), best] / chars, pa.float64(), mask=empty)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), usual], ["lang_pred", "score", "log_p_char"])

    return run


def identify(df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred (a learned language, or und for null texts and those without a letter), score, the posterior with
    equal priors (0 for und), and log_p_char, the log probability in that language for each character of the words (null for und), to the columns in keep, or else all.

    The score tells which of the learned languages fits best, log_p_char how well it fits. Ties go to the language that sorts first. A model
    without languages gives und throughout. Repeated rows give repeated results. Words and texts of any length are taken whole. The columns that it adds replace columns of the same names.
    """
    added = ["lang_pred", "score", "log_p_char"]
    keep = [c for c in (keep or df.columns) if c not in added]
    if not model.langs:
        return df.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("log_p_char"))
    small_batches(df.sparkSession)
    out = df.select(*keep, predict_udf(model)(word_line(F.col(text))).alias("_found"))
    return out.select(*keep, *[f"_found.{c}" for c in added])


def in_language(identified: DataFrame, margin: float = 1.5, spreads: float = 8.0, grain: float = 0.01) -> DataFrame:
    """Rows of identify()'s result whose text fits its language: log_p_char is not further below the median of all rows of that language than the margin
    and so many times the distance from the median to the lower quartile.

    The margin leaves texts with passages in another language, the quartile languages that vary much. Both are taken over all rows, exact at the grain, from counts
    by language and value, so strange texts don't move them while they are less than a quarter of a language's rows; und and nulls don't stay. The result has the
    columns of its input.
    """
    known = identified.where((F.col("lang_pred") != "und") & F.col("log_p_char").isNotNull())
    counts = known.groupBy("lang_pred", F.floor(F.col("log_p_char") / grain).alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("lang_pred").orderBy("bin")  # a few thousand values of a language at most
    shares = counts.select("lang_pred", "bin", (F.sum("n").over(up) / F.sum("n").over(Window.partitionBy("lang_pred"))).alias("share"))
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("bin"))) * grain
    least = shares.groupBy("lang_pred").agg((at(0.5) - F.greatest(spreads * (at(0.5) - at(0.25)), F.lit(margin))).alias("_least"))
    # one row for each learned language
    return known.join(F.broadcast(least), "lang_pred").where(F.col("log_p_char") >= F.col("_least")).select(*identified.columns)


by_value(__name__)
