"""Extrapolation of iterates: regularised combinations of past steps, quasi-Newton directions, momentum.

Iterates are keyed rows with a slot; inner products are Spark aggregates, the systems of a few slots are solved on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(i, j, g): inner products of slots i <= j. ``rows``: slot, keys, value."""
    a, b = rows.select(F.col("slot").alias("i"), *keys, F.col(value).alias("a")), rows.select(F.col("slot").alias("j"), *keys, F.col(value).alias("b"))
    return a.join(b, list(keys)).where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))


def regular_weights(g: np.ndarray, newest: int, lam: float) -> np.ndarray:
    """Weights c that sum to 1 and minimise c'Gc + lam * |c - newest slot|^2 for G scaled to norm 1."""
    m = len(g)
    scale = np.linalg.norm(g, 2)
    k = np.zeros((m + 1, m + 1))
    k[:m, :m] = 2 * (g / scale if scale > 0 else g) + 2 * lam * np.eye(m)
    k[m, :m] = k[:m, m] = 1
    right = np.zeros(m + 1)
    right[newest], right[m] = 2 * lam, 1
    return np.linalg.solve(k, right)[:m]


def extrapolated(moves: Sequence[DataFrame], keys: Sequence[str], size: int, lam: float = 0.1) -> DataFrame:
    """(keys, s): results g of a fixed-point map combined by ``regular_weights`` of their steps f. ``moves``: (keys, g, f), oldest first.

    Vectors are arrays of ``size`` in keyed rows; Spark sums their products, the driver has one number for each two moves.
    """
    both = moves[0].select(*keys, F.col("g").alias("g0"), F.col("f").alias("f0"))
    for k, m in enumerate(moves[1:], 1):
        both = both.join(m.select(*keys, F.col("g").alias(f"g{k}"), F.col("f").alias(f"f{k}")), list(keys))
    n = len(moves)
    products = [F.sum(F.expr(f"aggregate(zip_with(f{i}, f{j}, (a, b) -> a * b), 0D, (t, z) -> t + z)")) for i in range(n) for j in range(n)]
    c = regular_weights(np.array([x or 0.0 for x in both.agg(*products).first()]).reshape(n, n), n - 1, lam)
    return both.select(*keys, F.array(*(F.expr(" + ".join(f"{w!r}D * g{k}[{i}]" for k, w in enumerate(c.tolist()))) for i in range(size))).alias("s"))


class Extrapolation:
    """Ring of the last m results G and steps F of a fixed-point map; ``push`` gives G c - h F c."""

    def __init__(self, memory: int = 6, lam: float = 0.1, h: float = -1.0):
        self.m, self.lam, self.h, self.count = memory, lam, h, 0
        self.g: list[np.ndarray] = []
        self.f: list[np.ndarray] = []

    def push(self, result: np.ndarray, step: np.ndarray) -> np.ndarray:
        slot = self.count % self.m
        self.count += 1
        for ring, v in ((self.g, result), (self.f, step)):
            if slot < len(ring):
                ring[slot] = v
            else:
                ring.append(v)
        f = np.stack(self.f)
        c = regular_weights(f @ f.T, slot, self.lam)
        return c @ np.stack(self.g) - self.h * (c @ f)


def lbfgs_direction(gradient: np.ndarray, steps: Sequence[np.ndarray], changes: Sequence[np.ndarray]) -> np.ndarray:
    """Two-loop quasi-Newton direction -H g from past steps and gradient changes, oldest first; pairs without curvature are left out."""
    pairs = [(s, y, 1 / float(s @ y)) for s, y in zip(steps, changes, strict=True) if s @ y > 1e-12]
    q, alphas = gradient.copy(), []
    for s, y, rho in reversed(pairs):
        alphas.append(rho * float(s @ q))
        q = q - alphas[-1] * y
    if pairs:
        s, y, _ = pairs[-1]
        q = q * float(s @ y) / float(y @ y)
    for (s, y, rho), a in zip(pairs, reversed(alphas), strict=True):
        q = q + (a - rho * float(y @ q)) * s
    return -q


def momentum(step: np.ndarray, last: np.ndarray, iteration: int) -> np.ndarray:
    """Step plus (it - 1) / (it + 2) of the last direction; none before the second iteration."""
    return step + max(0.0, (iteration - 1) / (iteration + 2)) * last


def line_search(start: np.ndarray, toward: np.ndarray, cost, last: float, places: Sequence[float] = (0.0, 0.5, 1.0)) -> tuple[np.ndarray, float]:
    """First point start + (1 - t)(toward - start) that costs no more than ``last``, t through ``places``; else the last point tried."""
    point, now = start, last
    for t in places:
        point = start + (1 - t) * (toward - start)
        now = cost(point)
        if now <= last:
            break
    return point, now
