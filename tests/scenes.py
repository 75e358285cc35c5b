"""Seeded synthetic problems: cameras on an arc looking at a cloud of points."""

import numpy as np

from latticework.functions.kernels import residuals


def scene(cameras=4, points=20, seen=4, noise=0.0, seed=0, far=0):
    rng = np.random.default_rng(seed)
    pt = rng.normal(0, 1, (points, 3))
    cam = np.zeros((cameras, 9))
    cam[:, :3] = rng.normal(0, 0.1, (cameras, 3))
    cam[:, 3:5] = rng.normal(0, 0.3, (cameras, 2))
    cam[:, 5], cam[:, 6], cam[:, 7] = -8, 500, 1e-3
    ci = np.concatenate([rng.choice(cameras, seen, replace=False) for _ in range(points)])
    pi = np.repeat(np.arange(points), seen)
    xy = residuals(cam[ci], pt[pi], np.zeros((len(ci), 2))) + rng.normal(0, noise, (len(ci), 2)) if noise else residuals(cam[ci], pt[pi], np.zeros((len(ci), 2)))
    return cam, pt, ci, pi, xy


def shaken(cam, pt, seed=1, size=0.02):
    rng = np.random.default_rng(seed)
    c = cam.copy()
    c[:, :6] += rng.normal(0, size, (len(cam), 6))
    return c, pt + rng.normal(0, size, pt.shape)


def tables(spark, cam, pt, ci, pi, xy):
    obs = spark.createDataFrame([(int(a), int(b), float(x), float(y)) for a, b, (x, y) in zip(ci, pi, xy)], "cam_id long, pt_id long, x double, y double")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(cam)], "cam_id long, p array<double>")
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(pt)], "pt_id long, q array<double>")
    return obs, c, p
