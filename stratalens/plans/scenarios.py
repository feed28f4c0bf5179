"""Synthetic audit samples with a known answer, generated inside tasks.

Every sample's random stream is addressed by (seed, scenario, n, replicate), so it
is the same whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Levels of the construct, spacing of its means, and its pull on the attribute (fixed values).
LEVELS, SPACING, PULL = 5, 0.6, 0.8
#: Component variances of the shape-only mixture, base and step of the confounded attribute's success rate, cuts of the proxy (fixed values).
MIX, CONFOUND, CUTS = (0.25, 1.75), (0.35, 0.30), (0.5, 1.5, 2.5, 3.5)

Sample = tuple[np.ndarray, np.ndarray, np.ndarray]  # s, a, z


def _centre(q):
    return SPACING * (q - (LEVELS - 1) / 2)


def _observed(n: int, rng: np.random.Generator):
    q = rng.integers(0, LEVELS, n)
    a = (rng.random(n) < 1 / (1 + np.exp(-PULL * (q - (LEVELS - 1) / 2)))).astype(np.int64)
    return q, a, rng.standard_normal(n)


def _confounded(n: int, rng: np.random.Generator):
    a = (rng.random(n) < 0.5).astype(np.int64)
    q = rng.binomial(LEVELS - 1, CONFOUND[0] + CONFOUND[1] * a)
    return q, a, rng.standard_normal(n)


def conditional_null(n, rng) -> Sample:
    q, a, e = _observed(n, rng)
    return _centre(q) + e, a, q


def mean_dependence(n, rng, delta: float = 0.30) -> Sample:
    q, a, e = _observed(n, rng)
    return _centre(q) + delta * a + e, a, q


def variance_only(n, rng, sd=(1.0, 1.6)) -> Sample:
    q, a, e = _observed(n, rng)
    return _centre(q) + np.array(sd)[a] * e, a, q


def shape_only(n, rng) -> Sample:
    q, a, e = _observed(n, rng)
    sd = np.sqrt(np.array(MIX))[(rng.random(n) < 0.5).astype(int)]
    return _centre(q) + np.where(a == 1, sd * e, e), a, q


def confounded_observed(n, rng) -> Sample:
    q, a, e = _confounded(n, rng)
    return _centre(q) + e, a, q


def confounded_proxy(n, rng, tau: float = 1.0) -> Sample:
    q, a, e = _confounded(n, rng)
    return _centre(q) + e, a, np.searchsorted(CUTS, q + tau * rng.standard_normal(n), side="right")


@dataclass(frozen=True)
class Scenario:
    name: str
    null: str  # true, false or not guaranteed
    draw: Callable[..., Sample]


SCENARIOS = {
    s.name: s
    for s in (
        Scenario("conditional_null", "true", conditional_null), Scenario("mean_dependence", "false", mean_dependence), Scenario("variance_only", "false", variance_only),
        Scenario("shape_only", "false", shape_only), Scenario("confounded_observed", "true", confounded_observed), Scenario("confounded_proxy", "not guaranteed", confounded_proxy),
    )
}


def scenario(name: str) -> Scenario:
    try:
        return SCENARIOS[name]
    except KeyError:
        raise KeyError(f"no scenario called {name!r}; there are {sorted(SCENARIOS)}") from None
