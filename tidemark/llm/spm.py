"""SentencePiece encoding and decoding as a weighted transducer.

A model is compiled to a normaliser (the model's character map, a space becomes the mark, a mark is put before the text), an acceptor of
pieces with a weight each, and arcs of byte pieces for every character that is no piece of its own. A text is composed with it: the lattice of all pieces in all
places. The encoding is its shortest path in the tropical semiring (weights add along a path, the least path wins; of equal ones that whose last piece begins first). In a
unigram model a weight is the piece's negated log probability, a user's piece weighs what makes it win, and an arc of bytes more than any piece. In a byte-pair model user pieces are cut out first, the longest at each place, and the other pieces are combined with one more acceptor, which
lets b follow a only where merging a and b's characters anew gives just a and b; it leaves exactly one path, the
one that the merges make, whatever the weights.

No piece reaches over two neighbours that stand side by side in no piece at all, so the text is cut there and each different run
of characters is composed once in each batch; runs seen are kept in a bounded store of the Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, small_batches, worker_cache
from .pieces import BYTE, DEFAULT_MODEL, NORMAL, SPACE_MARK, UNKNOWN, USER, Pieces, read_model

#: Runs of characters kept in a Python worker.
KEPT_RUNS = 300_000
#: Pairs of pieces whose fit is kept there.
KEPT_PAIRS = 200_000
# Fixed value: by how much an unknown character weighs more than any piece.
UNKNOWN_PENALTY = 10.0
#: Characters worked on at once; longer texts are taken alone, whole.
CHARS_AT_ONCE = 500_000


class Transducer:
    def __init__(self, model: Pieces):
        self.model = model
        self.ids = {t: i for i, (t, k) in enumerate(zip(model.texts, model.kinds)) if k in (NORMAL, USER)}
        self.cost = [-s for s in model.scores]
        # what the library weighs unknown characters and user pieces with; a piece's bytes are counted
        normal = [s for s, k in zip(model.scores, model.kinds) if k == NORMAL] or [0.0]
        self.unknown_cost = UNKNOWN_PENALTY - min(normal)
        self.users: dict[str, list[str]] = {}
        for i, (t, k) in enumerate(zip(model.texts, model.kinds)):
            if k == USER:
                self.cost[i] = 0.1 - len(t.encode()) * max([0.0, *normal])
                self.users.setdefault(t[0], []).append(t)
        self.users = {c: sorted(ts, key=len, reverse=True) for c, ts in self.users.items()} if model.bpe else {}
        self.arcs = {t[:i]: -1 for t in self.ids for i in range(1, len(t))} | self.ids  # -1: only the start of a piece
        self.byte_ids = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(model.texts, model.kinds)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.fits: dict[tuple[int, int], bool] = {}
        self.made: dict[int, tuple[int, ...]] = {}
        self.rank = [-s if len(t) > 1 else -1.0 for t, s in zip(model.texts, model.scores)]
        # characters of the vocabulary by number, and which two stand side by side in a piece
        chars = sorted({c for t in self.ids for c in t})
        self.number = np.zeros(0x110000, np.int16 if len(chars) < 32_000 else np.int32)
        for i, c in enumerate(chars, 1):
            self.number[ord(c)] = i
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for t in self.ids:
            n = self.number[[ord(c) for c in t]]
            self.joined[n[:-1], n[1:]] = True
        # the normaliser's arcs by their first characters, longest runs first; user pieces stay as they are
        self.rules: dict[str, list[tuple[str, str]]] = {}
        users = [t for t, k in zip(model.texts, model.kinds) if k == USER and model.characters]
        for own in (sorted(users, key=len, reverse=True), sorted(model.characters, key=len, reverse=True)):
            for k in own:
                self.rules.setdefault(k[0], []).append((k, model.characters.get(k, k) if own is not users and k not in users else k))
        self.clear()

    def normalised(self, text: str) -> str:
        """The text as the normaliser's transducer gives it out: at each place the longest run that it knows."""
        rules = self.rules
        if not rules or rules.keys().isdisjoint(text):
            return text
        out, i, n = [], 0, len(text)
        while i < n:
            for k, to in rules.get(text[i], ()):
                if text.startswith(k, i):
                    out.append(to)
                    i += len(k)
                    break
            else:
                out.append(text[i])
                i += 1
        return "".join(out)

    def clear(self) -> None:
        self.runs: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.starts[0] = 0

    def merges(self, text: str, least: int = 1) -> list[int]:
        """The pieces that merged() gives for a text of known characters."""
        return [self.ids[p] for p in self.merged(text, least)]

    def merged(self, text: str, least: int = 1) -> list[str]:
        """What byte-pair merging makes of a text's characters: of all neighbours the best-scored, leftmost first.

        It stops where only so many pieces as least are left.
        """
        parts, score = list(text), self.model.scores
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list[tuple[float, int, str]] = []  # what may be merged: the best-scored first, then the leftmost

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                k = self.ids.get(both := parts[i] + parts[after[i]])
                if k is not None and both not in self.users.get(both[0], ()):
                    heapq.heappush(queue, (-score[k], i, both))

        for i in range(len(parts)):
            offer(i)
        left = len(parts)
        while left > least and queue:
            _, i, both = heapq.heappop(queue)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != both:
                continue  # one of the two has been merged since
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            left -= 1
            offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def halves(self, k: int) -> tuple[int, int]:
        """The two pieces whose merging makes a piece of several characters."""
        out = self.made.get(k)
        if out is None:
            out = self.made[k] = tuple(self.merges(self.model.texts[k], 2)[-2:])
        return out

    def follows(self, a: int, b: int) -> bool:
        """Whether the acceptor of a byte-pair model lets piece b follow piece a: no merge over their border comes first.

        The merges that made a and b are taken back, the latest first; over the border between what is then left, a merge counts that
        is made before the one just taken back.
        """
        out = self.fits.get((a, b))
        if out is not None:
            return out
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        texts, rank = self.model.texts, self.rank
        if SPACE_MARK * 2 in texts[a] + texts[b]:  # runs of spaces have equal scores, so their order is by place
            out = self.merges(texts[a] + texts[b]) == [a, b]
        else:
            left, right, limit = a, b, (float("inf"), 0)
            while out is None:
                over = self.ids.get(texts[left] + texts[right])
                if over is not None and (rank[over], 0) < limit:
                    out = False
                elif rank[left] < 0 and rank[right] < 0:
                    out = True
                elif rank[left] > rank[right]:
                    left, limit = self.halves(left)[1], (rank[left], 0)
                else:  # of equal merges the left one comes first
                    right, limit = self.halves(right)[0], (rank[right], 1)
        self.fits[a, b] = out
        return out

    def shortest(self, run: str) -> list[int]:
        """The shortest path of a run of characters; in a byte-pair model all of them are pieces."""
        n, bpe = len(run), self.model.bpe
        if bpe and len(run) > 1 and run == SPACE_MARK * n:
            return self.merges(run)  # equal scores: which comes first is by place, and no acceptor of pairs tells that
        arcs, cost, fits = self.arcs, self.cost, self.fits
        # of the best path to each place: its last piece (-2: a character as bytes), where that begins, its weight
        last, begin, weight = [-1] * (n + 1), [0] * (n + 1), [0.0] + [float("inf")] * n
        for a in range(n):
            before = last[a]
            if a and before == -1:
                continue
            alone = bpe
            for b in range(a + 1, n + 1):
                k = arcs.get(run[a:b])
                if k is None:
                    break
                if k < 0:
                    continue
                if bpe:
                    # only one path leads to a place, so the first that is found is it
                    if last[b] >= 0:
                        continue
                    fit = not a or fits.get((before, k))
                    if not (self.follows(before, k) if fit is None else fit):
                        continue
                else:
                    alone |= b == a + 1
                    if weight[a] + cost[k] >= weight[b]:
                        continue
                last[b], begin[b], weight[b] = k, a, weight[a] + cost[k]
            if not alone and weight[a] + self.unknown_cost < weight[a + 1]:
                last[a + 1], begin[a + 1], weight[a + 1] = -2, a, weight[a] + self.unknown_cost
        out, e = [], n
        while e:
            out += [last[e]] if last[e] >= 0 else self.bytes_of(run[begin[e] : e])[::-1]
            e = begin[e]
        return out[::-1]

    def bytes_of(self, text: str) -> list[int]:
        """The byte pieces of a text that is no piece; a model without them says unknown."""
        return [self.byte_ids[b] for b in text.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def path(self, run: str) -> list[int]:
        if not self.model.bpe:
            return self.shortest(run)
        if run in self.users.get(run[0], ()):
            return [self.ids[run]]
        if all(c in self.ids for c in run):
            return self.shortest(run)
        # characters that are pieces only together with others: what the merges leave alone goes to bytes
        return [k for p in self.merged(run) for k in ([self.ids[p]] if p in self.ids else self.bytes_of(p))]

    def user_cuts(self, text: str, cut: np.ndarray) -> None:
        """Cuts a text before and behind each user piece, the longest at each place."""
        i, n = 0, len(text)
        while i < n:
            t = next((t for t in self.users.get(text[i], ()) if text.startswith(t, i)), None)
            if t is None:
                i += 1
                continue
            cut[i] = True
            cut[i + 1 : i + len(t)] = False
            i += len(t)
            if i < n:
                cut[i] = True

    def place(self, runs: list[str]) -> np.ndarray:
        """Numbers of the runs in the store, which takes up the new ones."""
        new = [r for r in runs if r not in self.runs]
        if new and len(self.runs) + len(new) > KEPT_RUNS:
            self.clear()
            new = runs
        for r in new:
            if r not in self.runs:
                n, ids = len(self.runs), self.path(r)
                if n + 2 > len(self.starts):
                    self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                a = self.starts[n]
                while a + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                self.flat[a : a + len(ids)] = ids
                self.starts[n + 1] = a + len(ids)
                self.runs[r] = n
        return np.array([self.runs[r] for r in runs], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin and end."""
        mark = SPACE_MARK if self.model.dummy_prefix else ""
        texts = [self.normalised(t) for t in texts]
        if not self.model.extra_spaces:
            texts = [" ".join(filter(None, t.split(" "))) for t in texts]
        texts = [mark + t.replace(" ", SPACE_MARK) if t else "" for t in texts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        number = self.number[code]
        cut = np.ones(len(code), bool)
        cut[1:] = ~self.joined[number[:-1], number[1:]]
        ends = np.cumsum(sizes)
        if self.users and not self.users.keys().isdisjoint(whole):
            for a, b in zip(ends - sizes, ends):
                self.user_cuts(whole[a:b], cut[a:b])
        cut[ends[:-1][ends[:-1] < len(code)]] = True
        at = np.flatnonzero(cut)
        width = np.where(code < 0x80, 1, np.where(code < 0x800, 2, np.where(code < 0x10000, 3, 4)))
        byte_at = np.concatenate(([0], np.cumsum(width)))
        offsets = byte_at[np.append(at, len(code))].astype(np.int32)
        runs = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(whole.encode("utf-8", "surrogatepass"))).dictionary_encode()
        place = self.place(runs.dictionary.to_pylist())[runs.indices.to_numpy()]
        ids = _gather(self.flat, self.starts[place], self.starts[place + 1] - self.starts[place])
        after = np.concatenate(([0], np.cumsum(self.starts[place + 1] - self.starts[place])))
        bounds = after[np.searchsorted(at, np.concatenate(([0], ends)))]
        if not self.byte_ids:  # neighbours that are unknown are one unknown piece
            twice = np.zeros(len(ids) + 1, bool)
            twice[1:-1] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            twice[bounds] = False
            ids, bounds = ids[~twice[:-1]], bounds - np.concatenate(([0], np.cumsum(twice)))[bounds]
        return ids, bounds


class Decoder:
    """The bytes that each id stands for in a decoded text; a small part of what encoding needs."""

    def __init__(self, model: Pieces):
        self.dummy_prefix = model.dummy_prefix
        parts = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(SPACE_MARK, " ").encode() if k in (NORMAL, USER) else b"" for t, k in zip(model.texts, model.kinds)]
        self.flat, self.starts = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the ids between the places in at; ids outside the vocabulary and control pieces stand for nothing."""
        flat, starts = self.flat, self.starts
        ids = np.where((ids >= 0) & (ids < len(starts) - 1), ids, len(starts) - 1).astype(np.int64)
        starts = np.append(starts, starts[-1])
        sizes = starts[ids + 1] - starts[ids]
        data = _gather(flat, starts[ids], sizes).tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))[at]
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            t = data[a:b].decode("utf-8", "replace")
            out.append(t[1:] if self.dummy_prefix and t.startswith(" ") else t)
        return out


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of an array, one after another."""
    total = int(sizes.sum())
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, np.int64)
    return flat[np.arange(total) + np.repeat(starts - first, sizes)]


def load(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _transducer(data: bytes) -> Transducer:
    return worker_cache(("spm", hashlib.sha256(data).hexdigest()), lambda: Transducer(read_model(data)))


def encode_udf(data: bytes):
    """text -> ids; the model is sent along, so executors need no file."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _transducer(data)
        for texts in batches:
            parts, sizes, some, n = [], [], [], 0
            for x in [*texts.fill_null("").to_pylist(), None]:
                if x is not None:
                    some.append(x)
                    n += len(x)
                if some and (x is None or n >= CHARS_AT_ONCE):
                    ids, at = t.encode(some)
                    parts.append(ids)
                    sizes.append(np.diff(at))
                    some, n = [], 0
            at = np.concatenate(([0], np.cumsum(np.concatenate(sizes) if sizes else []))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))

    return run


def decode_udf(data: bytes):
    """ids -> text"""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = worker_cache(("spm-decoder", hashlib.sha256(data).hexdigest()), lambda: Decoder(read_model(data)))
        for ids in batches:
            at = ids.offsets.to_numpy().astype(np.int64)
            flat = ids.values.slice(at[0], at[-1] - at[0]).fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.array(t.decode(flat, at - at[0]), pa.string())

    return run


def encode(df: DataFrame, model_path: str = DEFAULT_MODEL, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ids, the encoding of every whole text, to the columns in keep, or else all.

    Null and empty texts have no ids. Repeated rows give repeated results, an empty table an empty one. Very long texts are encoded whole, one at a time, in time in proportion. Of paths of equal
    weight that counts whose last piece begins first; equal merges go from left to right. A column of the name out is replaced.
    """
    small_batches(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c != out]
    return df.select(*keep, encode_udf(load(model_path))(F.col(text)).alias(out))


def decode(df: DataFrame, model_path: str = DEFAULT_MODEL, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds the text of a list of ids to the columns in keep, or else all; null lists give empty texts.

    The text is that which was encoded, as the model's character map leaves it (which of most models changes nothing or compatibility forms), but that the mark U+2581 in
    it comes back as a space.
    """
    small_batches(df.sparkSession)
    keep = [c for c in (keep or df.columns) if c != out]
    return df.select(*keep, decode_udf(load(model_path))(F.coalesce(F.col(ids), F.array().cast("array<int>"))).alias(out))


by_value(__name__)
