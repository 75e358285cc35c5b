import numpy as np
import pytest

from latticework.functions import kernels as k
from latticework.plans import acceleration as acc
from tests.scenes import scene, shaken


@pytest.mark.parametrize("zero", [False, True])
def test_derivatives_match_differences(zero):
    cam, pt, ci, pi, xy = scene(seed=3)
    if zero:
        cam[:, :3] = 0
    r, jc, jl = k.residuals(cam[ci], pt[pi], xy, True)
    h = 1e-6
    for block, at, n in ((jc, 0, 9), (jl, 1, 3)):
        for j in range(n):
            a, b = [cam[ci].copy(), pt[pi].copy()], [cam[ci].copy(), pt[pi].copy()]
            a[at][:, j] += h
            b[at][:, j] -= h
            diff = (k.residuals(*a, xy) - k.residuals(*b, xy)) / (2 * h)
            assert np.allclose(block[:, :, j], diff, rtol=2e-5, atol=2e-3)


def test_schur_equals_full_system_and_solvers_agree():
    cam, pt, ci, pi, xy = scene(4, 30, 4, 0.5)
    r, jc, jl = k.residuals(cam[ci], pt[pi], xy, True)
    n = k.Normal.of(r, jc, jl, ci, pi, 4, 30)
    u, v = n.u + 0.5 * n.u * np.eye(9) + 1e-3 * np.eye(9), n.v + 0.5 * n.v * np.eye(3)
    ui, vi = k.block_inverse(u), k.block_inverse(v)
    b = -(n.bp - n.w_times(np.einsum("pij,pj->pi", vi, n.bl)))
    full = np.zeros((36 + 90, 36 + 90))
    for i in range(4):
        full[9 * i : 9 * i + 9, 9 * i : 9 * i + 9] = u[i]
    for i in range(30):
        full[36 + 3 * i : 39 + 3 * i, 36 + 3 * i : 39 + 3 * i] = v[i]
    for c, p, a, l in zip(ci, pi, jc, jl):
        w = a.T @ l
        full[9 * c : 9 * c + 9, 36 + 3 * p : 39 + 3 * p] += w
        full[36 + 3 * p : 39 + 3 * p, 9 * c : 9 * c + 9] += w.T
    want = np.linalg.solve(full, -np.concatenate([n.bp.ravel(), n.bl.ravel()]))[:36].reshape(4, 9)
    scale = np.abs(want).max()
    assert np.allclose(k.solve_direct(n, ui, vi, u, b), want, atol=1e-6 * scale)
    for name, f in k.SOLVERS.items():
        x = f(n, ui, vi, u, b, 5000, 1e-12)
        gap = n.schur(vi, u) @ (x - want).ravel()
        assert np.linalg.norm(gap) < 1e-3 * np.linalg.norm(b), name


def test_fit_recovers_exact_scene():
    cam, pt, ci, pi, xy = scene()
    c, p = shaken(cam, pt)
    job = k.Local(ci, pi, xy, c, p)
    before = job.cost(c, p)[0]
    after, _ = job.fit(40)
    assert after < 1e-6 * before


def test_frozen_parameters_stay():
    cam, pt, ci, pi, xy = scene()
    c, p = shaken(cam, pt)
    job = k.Local(ci, pi, xy, c.copy(), p.copy(), np.array([1.0, 0, 0, 0]), (np.arange(20) < 5).astype(float))
    job.fit(5)
    assert np.allclose(job.cam[1:], c[1:]) and np.allclose(job.pt[5:], p[5:]) and not np.allclose(job.cam[0], c[0])


def test_block_functions():
    m = np.stack([np.diag([4.0, 1, 0]), np.diag([3.0, 2, 1])])
    assert np.allclose(k.block_inverse(m)[0], np.diag([0.25, 1, 0]))
    assert np.allclose(k.block_largest(m)[:, 0, 0], [4, 3])
    assert np.allclose(k.block_where_needed(m)[:, 0, 0], [4, 1])
    assert np.allclose(np.linalg.eigvalsh(k.block_clamped(m, 0.1))[0], [0.4, 1, 4])
    low, high = k.block_range(m)
    assert low.tolist() == [0, 1] and high.tolist() == [4, 3]


def test_extrapolation_weights_and_directions():
    rng = np.random.default_rng(0)
    f = rng.normal(size=(4, 30))
    c = acc.regular_weights(f @ f.T, 3, 0.1)
    assert abs(c.sum() - 1) < 1e-12
    a = np.diag(np.arange(1.0, 6))
    x, fix = np.ones(5), lambda x: x - 0.1 * (a @ x)
    plain, fast, ring = x.copy(), x.copy(), acc.Extrapolation(5, 1e-8, 0.0)
    for _ in range(15):
        plain = fix(plain)
        new = fix(fast)
        fast = ring.push(new, new - fast)
    assert np.linalg.norm(fast) < np.linalg.norm(plain)
    xs = [rng.normal(size=5) for _ in range(6)]
    d = acc.lbfgs_direction(a @ x, xs, [a @ s for s in xs])
    assert d @ (a @ x) < 0
    assert np.allclose(acc.momentum(x, x, 1), x) and np.allclose(acc.momentum(x, x, 4), 1.5 * x)


def test_scaling_and_selection():
    cam, pt, ci, pi, xy = scene(seed=3)
    scale = np.array([1, 1, 1, 20, 20, 80, 3000, 10, 20.0])
    r, jc, _ = k.scaled_residuals(cam[ci] / scale, pt[pi], xy, scale, True)
    r0, jc0, _ = k.residuals(cam[ci], pt[pi], xy, True)
    assert np.allclose(r, r0) and np.allclose(jc, jc0 * scale)
    assert k.column_scale(jc0, ci, 4).shape == (4, 9)
    m = k.replace_blocks(np.ones((2, 3, 3)), np.array([True, False]))
    assert m[0].max() == 1e-15 and m[1].min() == 1


def test_line_search_stops_at_first_gain():
    f = lambda x: float((x**2).sum())
    x, now = acc.line_search(np.ones(2), -np.ones(2) * 3, f, 2.0)
    assert np.allclose(x, -1) and now == 2.0
