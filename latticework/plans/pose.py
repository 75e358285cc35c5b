"""Pose uncertainty: fits of one camera's pose to noisy views of known points, against the precision at the true pose."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from latticework.functions.kernels import residuals
from latticework.session import ship

# Three points, focal length, distance, views in degrees, pixel noise.
POINTS = np.array([[-10.0, -10, 0], [10, -10, 0], [-10, 10, 0]])
FOCAL, DISTANCE, VIEWS, NOISE = 600.0, 100.0, (-40, -20, 0, 20, 40), 0.5


def camera(angle: float) -> np.ndarray:
    """A camera turned about the vertical axis by ``angle`` degrees that looks at the points from DISTANCE."""
    return np.array([0, np.radians(angle), 0, 0, 0, -DISTANCE, FOCAL, 0, 0], float)


def precision(cam: np.ndarray, points: np.ndarray = POINTS) -> np.ndarray:
    """J'J of the six pose parameters."""
    _, jc, _ = residuals(np.repeat(cam[None], len(points), 0), points, np.zeros((len(points), 2)), True)
    j = jc[:, :, :6].reshape(-1, 6)
    return j.T @ j


def fit_pose(cam: np.ndarray, points: np.ndarray, xy: np.ndarray, steps: int = 40, damping: float = 1e-3) -> tuple[np.ndarray, float]:
    """Damped least squares for the pose alone; damping halves on success and grows fourfold on rejection."""
    cam = cam.copy()
    at = lambda c: residuals(np.repeat(c[None], len(points), 0), points, xy)
    cost = float((at(cam) ** 2).sum())
    for _ in range(steps):
        r, jc, _ = residuals(np.repeat(cam[None], len(points), 0), points, xy, True)
        j = jc[:, :, :6].reshape(-1, 6)
        h = j.T @ j
        new = cam.copy()
        new[:6] -= np.linalg.solve(h + damping * np.diag(np.diag(h)) + 1e-12 * np.eye(6), j.T @ r.ravel())
        now = float((at(new) ** 2).sum())
        if np.isfinite(now) and now <= cost:
            cam, cost, damping = new, now, damping / 2
        else:
            damping *= 4
    return cam, cost


def monte_carlo(spark: SparkSession, trials: int = 40, seed: int = 42) -> DataFrame:
    """(view, trial, w0..w2, t0..t2, cost): a fit for each noisy trial of each view, seeded by view and trial."""
    ship(spark)

    def go(key, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        for view, trial in zip(block.view.tolist(), block.trial.tolist()):
            true = camera(VIEWS[view])
            rng = np.random.default_rng([seed, view, trial])
            xy = residuals(np.repeat(true[None], len(POINTS), 0), POINTS, np.zeros((len(POINTS), 2))) + rng.normal(0, NOISE, (len(POINTS), 2))
            cam, cost = fit_pose(true, POINTS, xy)
            out.append((view, trial, *cam[:6].tolist(), cost))
        return pd.DataFrame(out, columns=["view", "trial", "w0", "w1", "w2", "t0", "t1", "t2", "cost"])

    rows = spark.range(len(VIEWS) * trials).selectExpr(f"cast(id div {trials} as int) as view", f"cast(id % {trials} as int) as trial")
    return rows.groupBy("view", "trial").applyInPandas(go, "view int, trial int, w0 double, w1 double, w2 double, t0 double, t1 double, t2 double, cost double")
