"""DartMinHash: sketches of weighted sets from darts thrown by hash.

Think of each element as a region: weight from 0 to its weight, rank from 0 on. Darts fall on the whole region as a
Poisson process of density one, the same for every set since their places come from hashes of the element and the cell
they fall in. A set keeps the darts below its weights. Each dart belongs to one of the sketch's coordinates, and a
coordinate holds the set's earliest dart (the least rank). Two sets agree in a coordinate with the probability of their weighted Jaccard similarity.
Only ranks below a bound are looked at, which leaves about k (ln k + 2) darts for a set of any size; where a coordinate stays
empty, the bound is doubled for that set.
"""

from __future__ import annotations

import math

import numpy as np

from .common import by_value

U = np.uint64
#: Odd constants for mixing; fixed values of the splitmix64 generator.
STEP, MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: Chances of at most 0, 1, 2 ... darts in a cell of area one.
CHANCES = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(14)])


def mix(x: np.ndarray) -> np.ndarray:
    x = x + STEP
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers from 0 to below 1."""
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def throw(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, bound: np.ndarray, k: int, sketch: np.ndarray) -> None:
    """Lowers sketch[owner, coordinate] to the earliest darts with rank below the owner's bound."""
    slab, low, high = 0, 0.0, 1.0
    while True:
        own = np.flatnonzero(weight > low)
        if not len(own):
            return
        width = high - low
        cells = np.ceil(bound[owner[own]] * width).astype(np.int64)
        at = np.repeat(own, cells)
        j = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = mix(element[at] ^ mix((j.astype(U) << U(6)) + U(slab)))
        n = np.searchsorted(CHANCES, unit(seed), side="right")
        dart = np.repeat(np.arange(len(at)), n)
        i = np.arange(len(dart)) - np.repeat(np.cumsum(n) - n, n)
        x = mix(seed[dart] + (i.astype(U) + U(1)) * MIX_A)
        place, rank = low + unit(x) * width, (j[dart] + unit(mix(x))) / width
        who = owner[at[dart]]
        below = (place < weight[at[dart]]) & (rank < bound[who])
        x, who, rank = mix(x[below] ^ MIX_B), who[below], rank[below]
        coordinate = ((x >> U(32)) % U(k)).astype(np.int64)
        early = (rank / bound[who] * 2.0**32).astype(U) << U(32) | (x & U(0xFFFFFFFF))
        np.minimum.at(sketch.reshape(-1), who * k + coordinate, early)
        slab, low, high = slab + 1, high, high * 2


def sketches(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, k: int) -> np.ndarray:
    """sets x k dart ids; owner says which set an element (a hash) of positive weight belongs to; sets without elements are all zero."""
    out = np.zeros((sets, k), np.uint32)
    total = np.bincount(owner, weight, sets)
    todo = np.flatnonzero(total > 0)
    bound = k * (math.log(k) + 2) / np.maximum(total, 1e-12)
    while len(todo):
        number = np.full(sets, -1)
        number[todo] = np.arange(len(todo))
        take = number[owner] >= 0
        sketch = np.full((len(todo), k), EMPTY)
        throw(number[owner[take]], element[take], weight[take], bound[todo], k, sketch)
        done = (sketch != EMPTY).all(1)
        out[todo[done]] = (sketch[done] & U(0xFFFFFFFF)).astype(np.uint32)
        todo = todo[~done]
        bound[todo] *= 2
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """Hashes of each band of so many coordinates, as signed longs; the band's number goes in."""
    n, k = sketch.shape
    out = np.zeros((n, k // rows), U)
    for r in range(rows):
        out = mix(out ^ sketch[:, r : k // rows * rows : rows].astype(U) ^ (np.arange(k // rows, dtype=U) << U(33)))
    return out.view(np.int64)


by_value(__name__)
