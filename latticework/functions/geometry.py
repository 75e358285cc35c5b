"""Camera geometry as SQL expressions of double columns: rotation, projection, residuals, quaternions.

Every function takes the names (or expressions) of its inputs and returns expressions, for ``F.expr`` or ``selectExpr``,
so Catalyst sees plain arithmetic and keeps it in generated code.
"""

from __future__ import annotations

CAMERA = ("w0", "w1", "w2", "t0", "t1", "t2", "f", "k1", "k2")
POINT = ("x0", "x1", "x2")


def cross(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"({a[(i + 1) % 3]} * {b[(i + 2) % 3]} - {a[(i + 2) % 3]} * {b[(i + 1) % 3]})" for i in range(3))


def dot(a: tuple[str, ...], b: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def rotate(w: tuple[str, ...] = CAMERA[:3], x: tuple[str, ...] = POINT) -> tuple[str, ...]:
    """Rodrigues rotation of x by the rotation vector w; x + w cross x where w is 0."""
    th2 = dot(w, w)
    th = f"sqrt({th2})"
    unit = tuple(f"({c} / nullif({th}, 0))" for c in w)
    turned, along = cross(unit, x), dot(unit, x)
    small = cross(w, x)
    return tuple(
        f"(case when {th2} = 0 then {x[i]} + {small[i]} else {x[i]} * cos({th}) + {turned[i]} * sin({th}) + {unit[i]} * {along} * (1 - cos({th})) end)"
        for i in range(3)
    )


def placed(camera: tuple[str, ...] = CAMERA, x: tuple[str, ...] = POINT) -> tuple[str, ...]:
    """The point in the camera's frame."""
    return tuple(f"({r} + {t})" for r, t in zip(rotate(camera[:3], x), camera[3:6], strict=True))


def image(q: tuple[str, ...]) -> tuple[str, str]:
    """Normalised image place of a point in the camera's frame; the camera looks along -z."""
    return f"(-{q[0]} / {q[2]})", f"(-{q[1]} / {q[2]})"


def distort(p: tuple[str, ...], camera: tuple[str, ...] = CAMERA) -> tuple[str, str]:
    """Pixels of a normalised place: focal length and two radial terms."""
    n = dot(p, p)
    scale = f"{camera[6]} * (1 + {n} * ({camera[7]} + {camera[8]} * {n}))"
    return f"({scale} * {p[0]})", f"({scale} * {p[1]})"


def quaternion(m: tuple[str, ...]) -> tuple[str, ...]:
    """Unit quaternion (w, x, y, z) of a row-major rotation matrix: by the trace if positive, else by the largest diagonal entry."""
    trace = f"({m[0]} + {m[4]} + {m[8]})"
    half = f"sqrt(greatest(1 + {trace}, 0))"

    def by(i: int) -> tuple[str, ...]:
        j, k = (i + 1) % 3, (i + 2) % 3
        s = f"sqrt(greatest(1 + {m[4 * i]} - {m[4 * j]} - {m[4 * k]}, 0))"
        out = [""] * 4
        out[0] = f"(({m[3 * k + j]} - {m[3 * j + k]}) / (2 * nullif({s}, 0)))"
        out[1 + i] = f"({s} / 2)"
        for other in (j, k):
            out[1 + other] = f"(({m[3 * other + i]} + {m[3 * i + other]}) / (2 * nullif({s}, 0)))"
        return tuple(out)

    first = (f"({half} / 2)", *(f"(({m[a]} - {m[b]}) / (2 * nullif({half}, 0)))" for a, b in ((7, 5), (2, 6), (3, 1))))
    large = [by(i) for i in range(3)]
    return tuple(
        f"(case when {trace} > 0 then {first[c]} when {m[0]} >= {m[4]} and {m[0]} >= {m[8]} then {large[0][c]} when {m[4]} >= {m[8]} then {large[1][c]} else {large[2][c]} end)"
        for c in range(4)
    )


def angle_axis(q: tuple[str, ...]) -> tuple[str, ...]:
    """Rotation vector of a unit quaternion, along the shorter arc."""
    s2 = dot(q[1:], q[1:])
    s = f"sqrt({s2})"
    twice = f"(2 * case when {q[0]} < 0 then atan2(-{s}, -{q[0]}) else atan2({s}, {q[0]}) end)"
    return tuple(f"({c} * case when {s2} = 0 then 2 else {twice} / nullif({s}, 0) end)" for c in q[1:])


def matrix(w: tuple[str, ...] = CAMERA[:3]) -> tuple[str, ...]:
    """Row-major rotation matrix of a rotation vector; its columns are the turned unit vectors."""
    columns = [rotate(w, tuple("1e0" if i == j else "0e0" for j in range(3))) for i in range(3)]
    return tuple(columns[c][r] for r in range(3) for c in range(3))


def normalize(x: tuple[str, ...] = POINT) -> tuple[str, ...]:
    return tuple(f"({c} / sqrt({dot(x, x)} + 1e-10))" for c in x)


def equirectangular(x: tuple[str, ...] = POINT, width: int = 5760) -> tuple[str, str]:
    """Panorama place of a direction, from the panorama's middle: half a turn less the longitude, and the latitude, in widths of a full turn."""
    n = normalize(x)
    turn = f"(atan2({n[0]}, {n[2]}) / (2 * pi()))"
    lat = f"atan2(-{n[1]}, sqrt({n[0]} * {n[0]} + {n[2]} * {n[2]}))"
    return f"((case when {turn} < 0 then -0.5 - {turn} else 0.5 - {turn} end) * {width})", f"({lat} / (-2 * pi()) * {width})"


def centre(camera: tuple[str, ...] = CAMERA) -> tuple[str, ...]:
    """Camera centre -R(-w) t."""
    back = rotate(tuple(f"(-{c})" for c in camera[:3]), camera[3:6])
    return tuple(f"(-{c})" for c in back)


def derivative_stages(camera: tuple[str, ...] = CAMERA, x: tuple[str, ...] = POINT) -> list[dict[str, str]]:
    """Columns, stage by stage, that lead from a point in the camera's frame (q0..q2) and its image place (p0, p1) to the residuals' derivatives.

    The last stages name them jx_0..jx_8, jy_0..jy_8 (by CAMERA) and lx_0..lx_2, ly_0..ly_2 (by POINT). With A the derivatives by
    the camera's frame, R the rotation and [x] the cross product's matrix, those by the rotation vector are
    -A R [x] (w w' + (R' - I) [w]) / w'w, and -A [x] where w is 0.
    """
    w, f, k1, k2 = camera[:3], camera[6], camera[7], camera[8]
    m = [f"m{i}" for i in range(9)]
    first = dict(zip(m, matrix(w), strict=True)) | {"n": dot(("p0", "p1"), ("p0", "p1")), "th2": dot(w, w)}
    second = {"d": f"1 + n * ({k1} + {k2} * n)", "slope": f"2 * ({k1} + 2 * {k2} * n)"}
    plane = {f"s{r}{c}": f"{f} * ({'d + ' if r == c else ''}slope * p{r} * p{c})" for r in range(2) for c in range(2)}
    frame = {f"a{r}{c}": f"-s{r}{c} / q2" for r in range(2) for c in range(2)} | {f"a{r}2": f"(s{r}0 * q0 + s{r}1 * q1) / (q2 * q2)" for r in range(2)}

    def crossed(v: tuple[str, ...]) -> list[list[str]]:
        return [["0", f"(-{v[2]})", v[1]], [v[2], "0", f"(-{v[0]})"], [f"(-{v[1]})", v[0], "0"]]

    def times(a: list[list[str]], b: list[list[str]]) -> list[list[str]]:
        return [["(" + (" + ".join(f"{r[k]} * {b[k][j]}" for k in range(3) if "0" not in (r[k], b[k][j])) or "0") + ")" for j in range(3)] for r in a]

    turn = [[m[3 * i + j] for j in range(3)] for i in range(3)]
    less = [[f"({m[3 * j + i]} - 1)" if i == j else m[3 * j + i] for j in range(3)] for i in range(3)]
    half = {f"e{i}{j}": e for i, row in enumerate(times(turn, crossed(x))) for j, e in enumerate(row)}
    inner = {f"i{i}{j}": f"({w[i]} * {w[j]} + {e}) / nullif(th2, 0)" for i, row in enumerate(times(less, crossed(w))) for j, e in enumerate(row)}
    by_w = {f"b{i}{j}": f"case when th2 = 0 then -({crossed(x)[i][j]}) else -(e{i}0 * i0{j} + e{i}1 * i1{j} + e{i}2 * i2{j}) end" for i in range(3) for j in range(3)}
    out: dict[str, str] = {}
    for r, a in enumerate("xy"):
        out |= {f"j{a}_{j}": f"a{r}0 * b0{j} + a{r}1 * b1{j} + a{r}2 * b2{j}" for j in range(3)} | {f"j{a}_{3 + j}": f"a{r}{j}" for j in range(3)}
        out |= {f"j{a}_6": f"d * p{r}", f"j{a}_7": f"{f} * n * p{r}", f"j{a}_8": f"{f} * n * n * p{r}"}
        out |= {f"l{a}_{j}": f"a{r}0 * {m[j]} + a{r}1 * {m[3 + j]} + a{r}2 * {m[6 + j]}" for j in range(3)}
    return [first, second, plane, frame | half | inner, by_w, out]
