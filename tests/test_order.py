"""Sweeps over coloured parts and the quasi-Newton fit, against plain loops."""

import numpy as np
import pytest

from latticework.functions.kernels import residuals
from latticework.plans import alternation, bundle, quasi
from latticework.plans.acceleration import lbfgs_direction
from tests.scenes import scene, shaken, tables


def chain(noise=0.3):
    """Three parts of two cameras; landmarks are seen by cameras next to each other, so that the outer parts share none."""
    cam, pt, _, _, _ = scene(6, 50, 2, 0, 7)
    rng = np.random.default_rng(3)
    low = np.arange(50) % 4
    ci, pi = np.concatenate([low, low + 1, low + 2]), np.tile(np.arange(50), 3)
    xy = residuals(cam[ci], pt[pi], np.zeros((len(ci), 2))) + rng.normal(0, noise, (len(ci), 2))
    return *shaken(cam, pt), ci, pi, xy, np.arange(6) // 2, (low + 1) // 2


def owners(spark, cam_part, pt_part):
    return tuple(spark.createDataFrame([(i, int(p)) for i, p in enumerate(v) if p >= 0], f"{k} long, part int") for k, v in (("cam_id", cam_part), ("pt_id", pt_part)))


def plain_step(cam, pt, ci, pi, xy, free_c, free_l, damping):
    """A damped step of the free parameters by the whole dense system."""
    r, jc, jl = residuals(cam[ci], pt[pi], xy, True)
    j = np.zeros((len(ci), 2, cam.size + pt.size))
    for n in range(len(ci)):
        j[n, :, 9 * ci[n] : 9 * ci[n] + 9] = jc[n] * free_c[ci[n]]
        j[n, :, cam.size + 3 * pi[n] : cam.size + 3 * pi[n] + 3] = jl[n] * free_l[pi[n]]
    j = j.reshape(-1, j.shape[2])
    h = j.T @ j
    h += damping * np.diag(np.diag(h))
    size = np.sqrt(np.where(np.diag(h) > 0, np.diag(h), 1))
    step = -np.linalg.lstsq(h / size[:, None] / size, j.T @ r.ravel() / size, rcond=1e-13)[0] / size
    return step[: cam.size].reshape(cam.shape), step[cam.size :].reshape(pt.shape)


def plain_sweeps(cam, pt, ci, pi, xy, cam_part, pt_part, order, sweeps, places=(1.0, 0.5, 0.25, 0.0625, 0.0)):
    """Part after part in ``order`` (lists of parts of one damping), each with its own and its borrowed residuals."""
    cost = lambda c, p, at: float(np.square(residuals(c[ci[at]], p[pi[at]], xy[at])).sum())
    every, damping = np.arange(len(ci)), [1e-3] * len(order)
    costs = [cost(cam, pt, every)]
    for _ in range(sweeps):
        for k, colour in enumerate(order):
            taken = []
            for part in colour:
                at = every[(cam_part[ci] == part) | (pt_part[pi] == part)]
                dc, dl = plain_step(cam, pt, ci[at], pi[at], xy[at], cam_part == part, pt_part == part, damping[k])
                found = [cost(cam + a * dc, pt + a * dl, at) for a in places]
                share = places[int(np.argmin(found))]
                cam, pt = cam + share * dc, pt + share * dl
                taken.append(share)
            damping[k] *= 0.5 if min(taken) == 1 else 2 if min(taken) < 0.5 else 1
        costs.append(cost(cam, pt, every))
    return cam, pt, costs


def test_sets_keep_own_and_borrowed_apart(spark):
    obs = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 0.0, 0.0), (9, 9, 0.0, 0.0), (0, 1, 0.0, 0.0)], "cam_id long, pt_id long, x double, y double")
    cams, pts = owners(spark, [0, 1], [0, 1, -1])
    got = sorted((r.cam_id, r.pt_id, r.part, r.fc, r.fl) for r in alternation.residual_sets(obs, cams, pts).collect())
    between = [(0, 1, 0, True, False), (0, 1, 1, False, True)]  # camera of part 0, landmark of part 1; seen twice
    assert got == sorted([(0, 0, 0, True, True), *between, *between, (1, 1, 1, True, True), (1, 2, 1, True, False)])
    assert [tuple(r) for r in alternation.part_conflicts(obs, cams, pts).collect()] == [(0, 1, 2)]


def test_colours_are_those_of_one_part_after_another(spark):
    rng = np.random.default_rng(1)
    edges = {(int(a), int(b)) for a, b in np.sort(rng.integers(0, 30, (60, 2))) if a < b}
    parts = spark.range(32).selectExpr("id as part")
    found = {r.part: r.colour for r in alternation.part_colours(spark.createDataFrame(sorted(edges), "a long, b long"), parts).collect()}
    order = [r.part for r in parts.selectExpr("part", "xxhash64(part) as h").orderBy("h", "part").collect()]
    want = {}
    for p in order:
        near = {want.get(b if a == p else a) for a, b in edges if p in (a, b)}
        want[p] = next(c for c in range(33) if c not in near)
    assert found == want
    assert alternation.part_colours(spark.createDataFrame([], "a long, b long"), parts.limit(0)).count() == 0


def test_sweeps_are_those_of_a_plain_loop(spark):
    cam, pt, ci, pi, xy, cam_part, pt_part = chain()
    obs, c, p = tables(spark, cam, pt, ci, pi, xy)
    cams, pts = owners(spark, cam_part, pt_part)
    colours = {r.part: r.colour for r in alternation.part_colours(alternation.part_conflicts(obs, cams, pts), cams.select("part").distinct()).collect()}
    assert colours[0] == colours[2] != colours[1]
    order = [[k for k, v in colours.items() if v == colour] for colour in sorted(set(colours.values()))]
    _, _, want = plain_sweeps(cam, pt, ci, pi, xy, cam_part, pt_part, order, 2)
    fit = alternation.ordered_palm(obs, c, p, cams, pts, sweeps=2, its=8, eps=1e-4, push=False, groups=2)
    assert fit.costs == pytest.approx(want, rel=1e-3)
    assert fit.costs[0] > fit.costs[1] > fit.costs[2]
    assert bundle.cost(obs, fit.cam, fit.pt).first().cost == pytest.approx(fit.costs[-1], rel=1e-9)


def test_only_owned_parameters_move_and_the_push_never_raises(spark):
    """Camera 5 and every seventh landmark have no owner and stay; momentum comes in at the second sweep."""
    cam, pt, ci, pi, xy, cam_part, pt_part = chain()
    cam_part = np.where(np.arange(6) == 5, -1, cam_part)
    pt_part = np.where(np.arange(50) % 7 == 0, -1, pt_part)
    obs, c, p = tables(spark, cam, pt, ci, pi, xy)
    fit = alternation.ordered_palm(obs, c, p, *owners(spark, cam_part, pt_part), sweeps=2, its=2, groups=2)
    assert all(b <= a * (1 + 1e-12) for a, b in zip(fit.costs, fit.costs[1:]))
    assert bundle.cost(obs, fit.cam, fit.pt).first().cost == pytest.approx(fit.costs[-1], rel=1e-9)
    new_c, new_p = {r.cam_id: r.p for r in fit.cam.collect()}, {r.pt_id: r.q for r in fit.pt.collect()}
    assert len(new_c) == 6 and len(new_p) == 50
    assert [i for i in range(6) if new_c[i] == cam[i].tolist()] == [5]
    assert [i for i in range(50) if new_p[i] == pt[i].tolist()] == list(range(0, 50, 7))


def test_shares_are_each_parts_own(spark):
    rows = spark.createDataFrame(
        [(part, 0.0, 0.0, [0.0] * 5 + [-1.0, 1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0] * 9, [d, 0.0, 0.0]) for part, d in ((0, -1.0), (1, -2.0), (2, 1.0), (3, float("nan")))],
        "part long, x double, y double, p array<double>, q array<double>, dp array<double>, dq array<double>")
    got = {r.part: (r.share, r.before, r.after) for r in alternation.shares_of_parts(rows, (1.0, 0.5)).collect()}
    assert got == {0: (1.0, 1.0, 0.0), 1: (0.5, 1.0, 0.0), 2: (0.0, 1.0, 1.0), 3: (0.0, 1.0, 1.0)}


def test_directions_of_slots_are_the_dense_ones(spark):
    rng = np.random.default_rng(2)
    m, lengths = 3, [9, 3, 3, 9, 3]
    dense = rng.normal(0, 1, (2 * m + 1, sum(lengths)))
    dense[m:-1] = dense[:m] * rng.uniform(0.5, 2, dense.shape[1]) + 0.1 * dense[m:-1]
    dense[m] = -dense[0]  # without curvature
    slots, cuts = [*(f"s{k}" for k in range(m)), *(f"y{k}" for k in range(m)), "g"], np.cumsum(lengths)[:-1]
    pieces = [np.split(v, cuts) for v in dense]
    rows = spark.createDataFrame([(k, *(v[k].tolist() for v in pieces)) for k in range(len(lengths))], "id long, " + ", ".join(f"{c} array<double>" for c in slots)).repartition(3)
    g = quasi.slot_gram(rows, slots)
    assert g == pytest.approx(dense @ dense.T)
    found = rows.selectExpr("id", f"{quasi.combined(slots, quasi.direction_weights(g))} as z").orderBy("id").collect()
    assert np.concatenate([r.z for r in found]) == pytest.approx(lbfgs_direction(dense[-1], dense[:m], dense[m:-1]))
    assert quasi.slot_gram(rows.limit(0), ["g"]).tolist() == [[0.0]]


def test_quasi_newton_fit_is_that_of_a_plain_loop(spark):
    cam, pt, ci, pi, xy = scene(3, 20, 3, 0.3, 5)
    cam, pt = shaken(cam, pt)
    places = (2.0, 1.0, 0.5, 0.25, 0.0625, 1 / 64, 1 / 1024)

    def at(v):
        r, jc, jl = residuals(v[:27].reshape(3, 9)[ci], v[27:].reshape(-1, 3)[pi], xy, True)
        g, h = np.zeros((2, len(v)))
        for n in range(len(ci)):
            for j, a in ((jc[n], slice(9 * ci[n], 9 * ci[n] + 9)), (jl[n], slice(27 + 3 * pi[n], 30 + 3 * pi[n]))):
                g[a] += j.T @ r[n]
                h[a] += (j * j).sum(0)
        return float((r * r).sum()), g, h

    v = np.concatenate([cam.ravel(), pt.ravel()])
    now, g, h = at(v)
    d, want, s, y = 1 / np.sqrt(h), [now], [], []
    for _ in range(7):
        z = lbfgs_direction(d * g, s, y)
        share = min(places, key=lambda a: at(v + a * d * z)[0])
        v, old = v + share * d * z, g
        now, g, _ = at(v)
        s, y, want = [*s, share * z][-3:], [*y, d * (g - old)][-3:], [*want, now]
    obs, c, p = tables(spark, cam, pt, ci, pi, xy)
    fit = quasi.lbfgs_fit(obs, c.union(spark.createDataFrame([(77, [1.0] * 9)], c.schema)), p, steps=7, memory=3)
    assert fit.costs == pytest.approx(want, rel=1e-6)
    assert all(b < a for a, b in zip(fit.costs, fit.costs[1:]))
    assert bundle.cost(obs, fit.cam, fit.pt).first().cost == pytest.approx(fit.costs[-1], rel=1e-9)
    assert fit.cam.where("cam_id = 77").first().p == [1.0] * 9
