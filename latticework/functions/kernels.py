"""NumPy kernels on stacked blocks: residuals with derivatives, block algebra, solvers of the reduced camera system."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(v), 3, 3))
    out[:, 0, 1], out[:, 0, 2], out[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    return out - out.transpose(0, 2, 1)


def rotations(w: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors; I + [w] where w is 0."""
    th = np.linalg.norm(w, axis=1)
    safe = np.where(th > 0, th, 1.0)
    k = skew(w / safe[:, None])
    full = np.eye(3) + np.sin(th)[:, None, None] * k + (1 - np.cos(th))[:, None, None] * (k @ k)
    return np.where((th > 0)[:, None, None], full, np.eye(3) + skew(w))


def residuals(cam: np.ndarray, pt: np.ndarray, xy: np.ndarray, derivatives: bool = False):
    """r (n, 2) of observations with their gathered parameters, and the derivatives jc (n, 2, 9), jl (n, 2, 3)."""
    w, f, k1, k2 = cam[:, :3], cam[:, 6], cam[:, 7], cam[:, 8]
    rot = rotations(w)
    turned = np.einsum("nij,nj->ni", rot, pt)
    q = turned + cam[:, 3:6]
    p = -q[:, :2] / q[:, 2:]
    n = (p * p).sum(1)
    d = 1 + n * (k1 + k2 * n)
    r = (f * d)[:, None] * p - xy
    if not derivatives:
        return r
    plane = np.zeros((len(q), 2, 3))
    plane[:, 0, 0] = plane[:, 1, 1] = -1 / q[:, 2]
    plane[:, :, 2] = q[:, :2] / (q[:, 2] ** 2)[:, None]
    a = f[:, None, None] * ((d[:, None, None] * np.eye(2) + 2 * (k1 + 2 * k2 * n)[:, None, None] * p[:, :, None] * p[:, None, :]) @ plane)
    th2 = (w * w).sum(1)
    safe = np.where(th2 > 0, th2, 1.0)[:, None, None]
    inner = (w[:, :, None] * w[:, None, :] + (rot.transpose(0, 2, 1) - np.eye(3)) @ skew(w)) / safe
    by_w = np.where((th2 > 0)[:, None, None], -rot @ skew(pt) @ inner, -skew(pt))
    jc = np.concatenate([a @ by_w, a, (d[:, None] * p)[:, :, None], (f * n)[:, None, None] * p[:, :, None], (f * n * n)[:, None, None] * p[:, :, None]], 2)
    return r, jc, a @ rot


def turns(w: np.ndarray) -> np.ndarray:
    """For rotation vectors the matrices by which derivatives by a small turn become those by the vector."""
    th2 = (w * w).sum(1)[:, None, None]
    inner = (w[:, :, None] * w[:, None, :] + (rotations(w).transpose(0, 2, 1) - np.eye(3)) @ skew(w)) / np.where(th2 > 0, th2, 1.0)
    return np.where(th2 > 0, inner, np.eye(3))


def camera_table(cam: np.ndarray) -> np.ndarray:
    """A row of 15 for each camera, for ``seen_from``: its rotation matrix and what else it has."""
    return np.concatenate([rotations(cam[:, :3]).reshape(-1, 9), cam[:, 3:]], 1)


def seen_from(table: np.ndarray, ci: np.ndarray, pt: np.ndarray, derivatives: bool = False):
    """``residuals`` without places, of points (3, n) seen from rows of a ``camera_table``: r (2, n), jc (2, 9, n) and jl (2, 3, n).

    Derivatives by the rotation are by a small turn; times ``turns`` of the camera they are those of ``residuals``.
    """
    c = np.ascontiguousarray(table.take(ci, 0).T)
    x, y, z = (c[3 * k] * pt[0] + c[3 * k + 1] * pt[1] + c[3 * k + 2] * pt[2] + c[9 + k] for k in range(3))
    f, k1, k2 = c[12], c[13], c[14]
    s = -1 / z
    p = np.stack([x * s, y * s])
    n = p[0] * p[0] + p[1] * p[1]
    d = 1 + n * (k1 + k2 * n)
    r = f * d * p
    if not derivatives:
        return r
    m, s = 2 * (k1 + 2 * k2 * n) * p, f * s
    jc, jl = np.empty((2, 9, len(ci))), np.empty((2, 3, len(ci)))
    for k in range(2):
        by = [m[k] * p[0], m[k] * p[1]]
        by[k] = by[k] + d
        jc[k, 3], jc[k, 4], jc[k, 5] = s * by[0], s * by[1], s * (by[0] * p[0] + by[1] * p[1])
        for i in range(3):
            jl[k, i] = jc[k, 3] * c[i] + jc[k, 4] * c[3 + i] + jc[k, 5] * c[6 + i]
        for i in range(3):
            jc[k, i] = jl[k, (i + 2) % 3] * pt[(i + 1) % 3] - jl[k, (i + 1) % 3] * pt[(i + 2) % 3]
        jc[k, 6], jc[k, 7] = d * p[k], f * n * p[k]
        jc[k, 8] = jc[k, 7] * n
    return r, jc, jl


def scaled_residuals(cam: np.ndarray, pt: np.ndarray, xy: np.ndarray, scale: np.ndarray, derivatives: bool = False):
    """``residuals`` of stored parameters that stand for cam * scale; derivatives are by the stored ones."""
    out = residuals(cam * scale, pt, xy, derivatives)
    return (out[0], out[1] * scale[..., None, :], out[2]) if derivatives else out


def column_scale(jc: np.ndarray, ci: np.ndarray, cameras: int, factor: float = 1e-4) -> np.ndarray:
    """A scale for each camera parameter: ``factor`` times the absolute column sums of its block / 1000, pose terms at 0.4 of it."""
    u = np.zeros((cameras, 9, 9))
    np.add.at(u, ci, jc.transpose(0, 2, 1) @ jc)
    s = factor * np.abs(u / 1000).sum(1)
    s[:, :5] *= 0.4
    return s


def replace_blocks(m: np.ndarray, chosen: np.ndarray, value: float = 1e-15) -> np.ndarray:
    """Blocks with all entries of the chosen ones set to ``value``."""
    return np.where(chosen[:, None, None], value, m)


def block_inverse(m: np.ndarray) -> np.ndarray:
    """Pseudo-inverses of symmetric blocks."""
    return np.linalg.pinv(m, hermitian=True) if len(m) else m


def block_largest(m: np.ndarray) -> np.ndarray:
    """Each block's largest eigenvalue times the identity."""
    return np.linalg.eigvalsh(m)[:, -1:, None] * np.eye(m.shape[-1])


def block_where_needed(m: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """The largest eigenvalue where the smallest is below ``least`` of it, else the smallest, times the identity."""
    e = np.linalg.eigvalsh(m)
    return np.where(e[:, 0] < least * e[:, -1], e[:, -1], e[:, 0])[:, None, None] * np.eye(m.shape[-1])


def block_clamped(m: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Blocks with eigenvalues raised to ``least`` of their largest."""
    e, v = np.linalg.eigh(m)
    e = np.maximum(e, least * e[:, -1:])
    return (v * e[:, None, :]) @ v.transpose(0, 2, 1)


def block_range(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.linalg.eigvalsh(m)
    return e[:, 0], e[:, -1]


@dataclass
class Normal:
    """Normal equations of observations with local camera and landmark numbers: blocks u (C, 9, 9), v (P, 3, 3), and b."""

    ci: np.ndarray
    pi: np.ndarray
    jc: np.ndarray
    jl: np.ndarray
    u: np.ndarray
    v: np.ndarray
    bp: np.ndarray
    bl: np.ndarray

    @classmethod
    def of(cls, r: np.ndarray, jc: np.ndarray, jl: np.ndarray, ci: np.ndarray, pi: np.ndarray, cameras: int, points: int) -> Normal:
        u, v, bp, bl = np.zeros((cameras, 9, 9)), np.zeros((points, 3, 3)), np.zeros((cameras, 9)), np.zeros((points, 3))
        np.add.at(u, ci, jc.transpose(0, 2, 1) @ jc)
        np.add.at(v, pi, jl.transpose(0, 2, 1) @ jl)
        np.add.at(bp, ci, np.einsum("nki,nk->ni", jc, r))
        np.add.at(bl, pi, np.einsum("nki,nk->ni", jl, r))
        return cls(ci, pi, jc, jl, u, v, bp, bl)

    def w_times(self, x: np.ndarray) -> np.ndarray:
        """W x for landmark vectors x."""
        out = np.zeros_like(self.bp)
        np.add.at(out, self.ci, np.einsum("nki,nk->ni", self.jc, np.einsum("nki,ni->nk", self.jl, x[self.pi])))
        return out

    def wt_times(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(self.bl)
        np.add.at(out, self.pi, np.einsum("nki,nk->ni", self.jl, np.einsum("nki,ni->nk", self.jc, x[self.ci])))
        return out

    def schur(self, vi: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The dense reduced system U - W V^-1 W', for few cameras."""
        c, p = len(self.bp), len(self.bl)
        w = np.zeros((c, 9, p, 3))
        np.add.at(w, (self.ci, slice(None), self.pi), self.jc.transpose(0, 2, 1) @ self.jl)
        s = -np.einsum("aipk,pkl,bjpl->aibj", w, vi, w, optimize=True)
        s[np.arange(c), :, np.arange(c)] += u
        return s.reshape(9 * c, 9 * c)


def solve_direct(n: Normal, ui: np.ndarray, vi: np.ndarray, u: np.ndarray, b: np.ndarray, its: int = 0, eps: float = 0) -> np.ndarray:
    return np.linalg.lstsq(n.schur(vi, u), b.ravel(), rcond=None)[0].reshape(b.shape)


def _apply(n: Normal, ui: np.ndarray, vi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """U^-1 W V^-1 W' x."""
    return np.einsum("cij,cj->ci", ui, n.w_times(np.einsum("pij,pj->pi", vi, n.wt_times(x))))


def solve_power(n: Normal, ui, vi, u, b, its: int = 200, eps: float = 1e-6) -> np.ndarray:
    """Neumann series of the reduced system."""
    x = step = np.einsum("cij,cj->ci", ui, b)
    for i in range(its):
        step = _apply(n, ui, vi, step)
        x = x + step
        if (i + 1) * np.linalg.norm(step) < eps * np.linalg.norm(x):
            break
    return x


def solve_nesterov(n: Normal, ui, vi, u, b, its: int = 400, eps: float = 1e-8) -> np.ndarray:
    """Accelerated fixed-point steps on x = U^-1 (b + W V^-1 W' x)."""
    base = np.einsum("cij,cj->ci", ui, b)
    x, y, lam = base, base, (1 + 5**0.5) / 2
    for i in range(its):
        new = y + (base + _apply(n, ui, vi, y) - y)
        after = (1 + (1 + 4 * lam * lam) ** 0.5) / 2
        if ((new - x) * (y - new)).sum() > 0:
            after, lam = 1.0, 1.0
        y = new + (lam - 1) / after * (new - x)
        done = (i + 1) * np.linalg.norm(new - x) < eps * np.linalg.norm(new)
        x, lam = new, after
        if done:
            break
    return x


def solve_polak(n: Normal, ui, vi, u, b, its: int = 400, eps: float = 1e-8, rate: float = 0.9, momentum: float = 0.6) -> np.ndarray:
    """Heavy ball on the preconditioned system."""
    base = np.einsum("cij,cj->ci", ui, b)
    x = last = base
    for i in range(its):
        new = x + rate * (base + _apply(n, ui, vi, x) - x) + momentum * (x - last)
        done = (i + 1) * np.linalg.norm(new - x) < eps * np.linalg.norm(new)
        x, last = new, x
        if done:
            break
    return x


def solve_damped_power(n: Normal, ui, vi, u, b, its: int = 400, eps: float = 1e-8, rate: float = 1.2) -> np.ndarray:
    """Richardson steps with over-relaxation, held below divergence."""
    base = np.einsum("cij,cj->ci", ui, b)
    x, size = base, np.inf
    for i in range(its):
        step = rate * (base + _apply(n, ui, vi, x) - x)
        now = np.linalg.norm(step)
        rate = rate if now <= size else max(1.0, rate * 0.9)
        x, size = x + step, now
        if (i + 1) * now < eps * np.linalg.norm(x):
            break
    return x


def solve_gradient(n: Normal, ui, vi, u, b, its: int = 2000, eps: float = 1e-9) -> np.ndarray:
    """Steepest descent on the symmetric system with exact step lengths, preconditioned by U^-1."""
    x = np.einsum("cij,cj->ci", ui, b)
    for i in range(its):
        r = b - (np.einsum("cij,cj->ci", u, x) - n.w_times(np.einsum("pij,pj->pi", vi, n.wt_times(x))))
        z = np.einsum("cij,cj->ci", ui, r)
        az = np.einsum("cij,cj->ci", u, z) - n.w_times(np.einsum("pij,pj->pi", vi, n.wt_times(z)))
        bend = (z * az).sum()
        if bend <= 0:
            break
        step = (r * z).sum() / bend * z
        x = x + step
        if np.linalg.norm(step) < eps * np.linalg.norm(x):
            break
    return x


def solve_bicgstab(n: Normal, ui, vi, u, b, its: int = 50, eps: float = 1e-6) -> np.ndarray:
    """Stabilised bi-conjugate gradients on (I - U^-1 W V^-1 W') x = U^-1 b."""
    a = lambda x: x - _apply(n, ui, vi, x)
    base = np.einsum("cij,cj->ci", ui, b)
    x = base.copy()
    r = base - a(x)
    shadow, rho, alpha, omega = r.copy(), 1.0, 1.0, 1.0
    v = p = np.zeros_like(b)
    for _ in range(its):
        if np.linalg.norm(r) <= eps * np.linalg.norm(base):
            break
        new = float((shadow * r).sum())
        if new == 0 or omega == 0:
            break
        p = r + new / rho * alpha / omega * (p - omega * v)
        rho, v = new, a(p)
        alpha = rho / float((shadow * v).sum())
        s = r - alpha * v
        t = a(s)
        tt = float((t * t).sum())
        omega = float((t * s).sum()) / tt if tt else 0.0
        x, r = x + alpha * p + omega * s, s - omega * t
    return x


SOLVERS = {
    "direct": solve_direct, "power": solve_power, "nesterov": solve_nesterov, "polak": solve_polak,
    "damped_power": solve_damped_power, "gradient": solve_gradient, "bicgstab": solve_bicgstab,
}


#: Entries of the coupling blocks up to which the reduced system is formed.
FORMED = 10_000_000


@dataclass
class Local:
    """A local problem: observations by local numbers, parameters, which of them are free, and pulls towards targets.

    pull_c (C, 9, 9) and pull_l (P, 3, 3) add 0.5-free penalties (x - target)' R (x - target).
    """

    ci: np.ndarray
    pi: np.ndarray
    xy: np.ndarray
    cam: np.ndarray
    pt: np.ndarray
    free_c: np.ndarray | None = None
    free_l: np.ndarray | None = None
    pull_c: np.ndarray | None = None
    to_c: np.ndarray | None = None
    pull_l: np.ndarray | None = None
    to_l: np.ndarray | None = None

    def cost(self, cam: np.ndarray, pt: np.ndarray) -> tuple[float, float]:
        """Squared residuals, and the same with the pulls."""
        r = residuals(cam[self.ci], pt[self.pi], self.xy)
        plain = full = float((r * r).sum())
        for x, to, m in ((cam, self.to_c, self.pull_c), (pt, self.to_l, self.pull_l)):
            if m is not None:
                full += float(np.einsum("ni,nij,nj->", x - to, m, x - to))
        return plain, full

    def fit(self, steps: int, damping: float = 1e-3, solver: str | None = None, spread: float = 1e-9) -> tuple[float, float]:
        """Levenberg-Marquardt steps in place; gives the cost and the damping. Damping doubles on every rejection.

        Without a solver's name small reduced systems are formed and solved, larger ones iterated on without forming them.
        """
        solver = solver or ("direct" if 27 * len(self.cam) * len(self.pt) <= FORMED else "bicgstab")
        plain, full = self.cost(self.cam, self.pt)
        for _ in range(steps):
            r, jc, jl = residuals(self.cam[self.ci], self.pt[self.pi], self.xy, True)
            if self.free_c is not None:
                jc = jc * self.free_c[self.ci][:, None, None]
            if self.free_l is not None:
                jl = jl * self.free_l[self.pi][:, None, None]
            n = Normal.of(r, jc, jl, self.ci, self.pi, len(self.cam), len(self.pt))
            u, v, bp, bl = n.u.copy(), n.v.copy(), n.bp, n.bl
            if self.pull_c is not None:
                u, bp = u + self.pull_c, bp + np.einsum("cij,cj->ci", self.pull_c, self.cam - self.to_c)
            if self.pull_l is not None:
                v, bl = v + self.pull_l, bl + np.einsum("cij,cj->ci", self.pull_l, self.pt - self.to_l)
            dc, dl = (damping * m * np.eye(m.shape[-1]) + spread * block_largest(m) for m in (u, v))
            u, v = u + dc, v + dl
            ui, vi = block_inverse(u), block_inverse(v)
            step_c = SOLVERS[solver](n, ui, vi, u, -(bp - n.w_times(np.einsum("pij,pj->pi", vi, bl))))
            step_l = -np.einsum("pij,pj->pi", vi, bl + n.wt_times(step_c))
            new_plain, new_full = self.cost(self.cam + step_c, self.pt + step_l)
            if np.isfinite(new_full) and new_full <= full:
                model = r + np.einsum("nki,ni->nk", jc, step_c[self.ci]) + np.einsum("nki,ni->nk", jl, step_l[self.pi])
                ratio = (plain - new_plain) / max(plain - float((model * model).sum()), 1e-300)
                self.cam, self.pt = self.cam + step_c, self.pt + step_l
                damping = damping / 2 if ratio > 0.8 else damping * 2 if ratio < 0.25 else damping
                small = full - new_full <= 1e-12 * full
                plain, full = new_plain, new_full
                if small:
                    break
            else:
                damping *= 2
        return plain, damping
