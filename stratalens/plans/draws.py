"""Random counts of any size, addressed by node: hypergeometric draws, tables with given margins, splits of a tree.

A stream depends on (seed, address) alone, so any task that needs a node's draw makes
the same one. All functions draw for many replicates at once (arrays, first axis: draw).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: NumPy's own hypergeometric generator takes fewer good or bad items than this.
NUMPY_BOUND = 1_000_000_000


def stream(seed: int, *address) -> np.random.Generator:
    digest = hashlib.sha256(":".join(map(str, (seed, *address))).encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "little")))


def _log_factorial_change(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """ln((x + d)! / x!) less d ln(x + 1), with an error far under 1e-9 for counts to 10^15.

    By Stirling's series at y = x + 1: only ln(1 + d / y) and quotients take part, so
    no two large numbers are subtracted. Small arguments go by lgamma itself.
    """
    y = x + 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        u = d / y
        series = lambda t: 1 / (12 * t) - 1 / (360 * t**3)
        large = (y + d - 0.5) * np.log1p(u) - d + series(y + d) - series(y)
    small = np.minimum(y, y + d) < 1000
    if small.any():
        exact = np.array([math.lgamma(a + b) - math.lgamma(a) - b * math.log(a) for a, b in zip(y[small], d[small], strict=True)])
        large[small] = exact
    return large


def log_ratio(k: np.ndarray, m: np.ndarray, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln of the hypergeometric probability of k over that of m (both possible)."""
    d = k - m
    # k!, (good - k)!, (n - k)!, (bad - n + k)! stand below the line; their linear parts cancel near the mode
    rest = _log_factorial_change(m, d) + _log_factorial_change(good - m, -d) + _log_factorial_change(n - m, -d) + _log_factorial_change(bad - n + m, d)
    linear = np.log(good - m + 1.0) - np.log(m + 1.0) + np.log(n - m + 1.0) - np.log(bad - n + m + 1.0)
    return d * linear - rest


def _ratio_of_uniforms(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hypergeometric draws by rejection from a table-mountain hat; good, bad and n as doubles, each draw of positive variance."""
    total = good + bad
    mean = n * (good / total)
    spread = np.sqrt(mean * (bad / total) * ((total - n) / (total - 1)) + 0.5)
    mode = np.floor((n + 1) * ((good + 1) / (total + 2)))
    low, high = np.maximum(0.0, n - bad), np.minimum(n, good)
    # Stadlober's constants of the hat: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    out, left = np.empty(len(good)), np.arange(len(good))
    while len(left):
        u, v = rng.random(len(left)), rng.random(len(left))
        u = np.maximum(u, 1e-300)
        k = np.floor(mean[left] + 0.5 + width[left] * (v - 0.5) / u)
        fits = (k >= low[left]) & (k <= high[left])
        k = np.clip(k, low[left], high[left])
        taken = fits & (2 * np.log(u) <= log_ratio(k, mode[left], good[left], bad[left], n[left]))
        out[left[taken]] = k[taken]
        left = left[~taken]
    return out


def hypergeometric(rng: np.random.Generator, good, bad, n) -> np.ndarray:
    """How many of n items drawn without replacement are good: int64 arrays of any counts to 10^15, elementwise."""
    good, bad, n = (np.asarray(x, np.int64) for x in np.broadcast_arrays(good, bad, n))
    shape = good.shape
    good, bad, n = good.ravel(), bad.ravel(), n.ravel()
    if not len(good) or max(good.max(), bad.max()) < NUMPY_BOUND:
        return rng.hypergeometric(good, bad, n).reshape(shape)
    out = np.where(bad == 0, n, np.where(n == good + bad, good, 0))
    open_ = (good > 0) & (bad > 0) & (n > 0) & (n < good + bad)
    if open_.any():
        g, b, k = (x[open_].astype(np.float64) for x in (good, bad, n))
        out[open_] = _ratio_of_uniforms(rng, g, b, k).astype(np.int64)
    return out.reshape(shape)


def deal(rng: np.random.Generator, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n[draw] items drawn without replacement from counts[draw, kind]: how many of each kind.

    Kinds are halved again and again; each halving is one binary draw.
    """
    draws, kinds = counts.shape
    if kinds == 1:
        return n[:, None].copy()
    half = kinds // 2
    left = counts[:, :half]
    mine = hypergeometric(rng, left.sum(1), counts[:, half:].sum(1), n)
    return np.concatenate([deal(rng, left, mine), deal(rng, counts[:, half:], n - mine)], axis=1)


def tables(rng: np.random.Generator, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Count tables [draw, row, column] as a uniform permutation would fill them, from margins rows[row] and columns[draw, column].

    Rows are halved again and again; the upper half takes a deal of what the columns have.
    """
    draws = len(columns)
    if len(rows) == 1:
        return columns[:, None, :].copy()
    half = len(rows) // 2
    upper = deal(rng, columns, np.full(draws, rows[:half].sum()))
    return np.concatenate([tables(rng, rows[:half], upper), tables(rng, rows[half:], columns - upper)], axis=1)


def walk(seed: int, address: tuple, path: list[tuple[int, int]], leaf: int, counts: np.ndarray) -> np.ndarray:
    """What a permutation deals to one leaf of a binary tree: counts[draw, kind] are the root's labels.

    path holds, from the root down, the units of the left and of the right child of the
    node that the leaf is under; leaf's bits, the highest first, say which child it takes.
    Node i at a level draws from the stream (seed, address, level, i), whoever asks.
    """
    for level, (left, _) in enumerate(path):
        node = leaf >> (len(path) - level)
        upper = deal(stream(seed, *address, level, node), counts, np.full(len(counts), left))
        counts = counts - upper if (leaf >> (len(path) - level - 1)) & 1 else upper
    return counts


def resample(seed: int, address: tuple, path: list[tuple[int, int]], leaf: int, n: int, draws: int) -> np.ndarray:
    """How many of n units drawn with replacement fall to one leaf, by draw: a binomial split at each node of its path."""
    mine = np.full(draws, n, np.int64)
    for level, (left, right) in enumerate(path):
        node = leaf >> (len(path) - level)
        upper = stream(seed, *address, level, node).binomial(mine, left / (left + right)) if left + right else np.zeros_like(mine)
        mine = mine - upper if (leaf >> (len(path) - level - 1)) & 1 else upper
    return mine
