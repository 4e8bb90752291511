"""Reads a SentencePiece model file: pieces with scores and kinds, the model's kind and its normaliser's settings."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .common import by_value

#: Where the public tokenizers are; every operator takes its file's path as a parameter.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
# Kinds of pieces in the file format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


@dataclass(frozen=True)
class Pieces:
    texts: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    dummy_prefix: bool
    extra_spaces: bool  # whether runs of spaces stay
    characters: dict[str, str] = field(default_factory=dict)  # what the normaliser makes of runs of characters, of several that fit the longest


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Field number and value of each entry of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        n = shift = 0
        while True:
            c = b[i]
            i += 1
            n |= (c & 127) << shift
            shift += 7
            if c < 128:
                return n

    while i < len(b):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            n = number()
            yield key >> 3, b[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", b[i : i + n])[0]
            i += n


def read_model(data: bytes) -> Pieces:
    texts, scores, kinds, trainer, norm = [], [], [], {}, {}
    for f, v in _fields(data):
        if f == 1:
            p = dict(_fields(v))
            texts.append(p[1].decode())
            scores.append(p.get(2, 0.0))
            kinds.append(p.get(3, NORMAL))
        elif f == 2:
            trainer = dict(_fields(v))
        elif f == 3:
            norm = dict(_fields(v))
    return Pieces(texts, scores, kinds, trainer.get(3, 1) == 2, bool(norm.get(3, 1)), not norm.get(4, 1), character_map(norm.get(2, b"")))


def character_map(data: bytes) -> dict[str, str]:
    """The entries of a compiled character map: the size of a double-array trie, its units, and the texts that its values point to.

    A unit has in its low bits the byte that leads to it, a flag for a value, and the offset to its children; all of them are followed from the root.
    """
    if not data:
        return {}
    size = int.from_bytes(data[:4], "little")
    units, texts = np.frombuffer(data, "<u4", size // 4, 4).astype(np.int64), data[4 + size :]
    offset = (units >> 10) << ((units & 512) >> 6)
    label, leaf, value = units & 0x800000FF, units >> 8 & 1, units & 0x7FFFFFFF
    out, todo, every = {}, [(int(offset[0]), b"")], np.arange(1, 256)
    while todo:
        base, key = todo.pop()
        at = base ^ every
        at = np.where(at < len(units), at, 0)
        for c in every[label[at] == every].tolist():
            place = base ^ c
            below = place ^ int(offset[place])
            if leaf[place]:
                start = int(value[below])
                out[(key + bytes([c])).decode()] = texts[start : texts.index(0, start)].decode()
            todo.append((below, key + bytes([c])))
    return out


by_value(__name__)
