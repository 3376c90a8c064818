"""Sequential model-based search over a mixed space, by density ratios.

Tried parameter sets are parted by loss into a good share and the rest. For
each parameter both parts give a density, a mixture of normal kernels around
what was tried and one as wide as the range. Candidates are drawn from the good
one, and the one where it stands highest over the other is tried next. The
first trials are drawn evenly, one from each stretch of every range. Trials of
one batch are evaluated side by side; while a batch is being put together, what
is already in it counts as tried without success.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Share of trials that count as good, candidates drawn for each proposal, share of trials that are spread evenly at first, and how many of a trial's kernels fit into a range.
GOOD_SHARE, CANDIDATES, FIRST, NARROW = 0.15, 64, 1 / 3, 6


@dataclass(frozen=True)
class Whole:
    """Whole numbers from ``low`` to ``high`` in steps."""

    low: int
    high: int
    step: int = 1

    def inner(self) -> tuple[float, float]:
        return self.low - self.step / 2, self.high + self.step / 2

    def forth(self, value: int) -> float:
        return float(value)

    def back(self, x: float) -> int:
        return int(min(self.high, max(self.low, self.low + self.step * math.floor((x - self.low) / self.step + 0.5))))


@dataclass(frozen=True)
class Real:
    """Numbers from ``low`` to ``high``, evenly spread or evenly in their logarithms."""

    low: float
    high: float
    log: bool = False

    def inner(self) -> tuple[float, float]:
        return self.forth(self.low), self.forth(self.high)

    def forth(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    def back(self, x: float) -> float:
        return float(min(self.high, max(self.low, math.exp(x) if self.log else x)))


Space = dict[str, Whole | Real]
Params = dict[str, float | int]


def spread(space: Space, n: int, r: np.random.Generator) -> list[Params]:
    """``n`` sets in which every parameter has one value from each n-th of its range."""
    columns = {}
    for name, kind in space.items():
        low, high = kind.inner()
        columns[name] = [kind.back(low + (high - low) * x) for x in (r.permutation(n) + r.random(n)) / n]
    return [{name: columns[name][k] for name in space} for k in range(n)]


def _kernels(kind: Whole | Real, values: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths: each value's width is the wider gap to its neighbours, within bounds, and one kernel is as wide as the range."""
    low, high = kind.inner()
    at = np.sort(np.array([kind.forth(v) for v in values], float))
    around = np.concatenate([[low], at, [high]])
    widths = np.maximum(around[1:-1] - around[:-2], around[2:] - around[1:-1])
    widths = np.clip(widths, (high - low) / min(100.0, max(NARROW, 1.0 + 4 * len(at))), (high - low) / NARROW)
    return np.append(at, (low + high) / 2), np.append(widths, high - low)


def _log_density(x: np.ndarray, centres: np.ndarray, widths: np.ndarray) -> np.ndarray:
    z = (x[:, None] - centres) / widths
    return np.log(np.exp(-z * z / 2) @ (1 / widths) / len(centres) + 1e-300)


def propose(space: Space, tried: list[tuple[Params, float]], r: np.random.Generator) -> Params:
    """The parameter set to try next."""
    order = sorted(range(len(tried)), key=lambda k: tried[k][1])
    good = set(order[: max(1, math.ceil(GOOD_SHARE * len(tried)))])
    drawn, ratio = {}, np.zeros(CANDIDATES)
    for name, kind in space.items():
        low, high = kind.inner()
        parts = [[p[name] for k, (p, _) in enumerate(tried) if (k in good) == side] for side in (True, False)]
        likely, other = (_kernels(kind, values) for values in parts)
        pick = r.integers(0, len(likely[0]), CANDIDATES)
        x = np.clip(likely[0][pick] + likely[1][pick] * r.standard_normal(CANDIDATES), low, high)
        drawn[name] = [kind.back(v) for v in x]
        x = np.array([kind.forth(v) for v in drawn[name]])
        ratio += _log_density(x, *likely) - _log_density(x, *other)
    best = int(ratio.argmax())
    return {name: values[best] for name, values in drawn.items()}


def search(space: Space, evaluate: Callable[[list[Params]], list[float]], trials: int, seed: int = 42, at_once: int = 3) -> list[tuple[Params, float]]:
    """Every trial with its loss, in order: the first third spread over the space, then batches of ``at_once`` proposed from what was tried."""
    r = np.random.default_rng(seed)
    first = spread(space, max(1, math.ceil(FIRST * trials)), r)
    tried = list(zip(first, evaluate(first), strict=True))
    while len(tried) < trials:
        worst, batch = max(loss for _, loss in tried), []
        for _ in range(min(at_once, trials - len(tried))):
            batch.append(propose(space, tried + [(p, worst) for p in batch], r))
        tried += zip(batch, evaluate(batch), strict=True)
    return tried
