"""Fits of all parts at once: one reduced system of keyed rows holds every part, and its blocks do not couple them.

Cameras and landmarks have ids that only one part moves, so products, costs and shares of all parts come from the same
passes and no large part is held in one task. Only a few numbers of each part reach the driver. Where all parts are small, a
task fits each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.kernels import Local, block_largest, residuals
from latticework.operators.relational import bounded
from latticework.plans import lands
from latticework.plans.reduced import MOST_SENT, Reduced, Sums, chunked, derived, lists, matrix
from latticework.session import dropped, kept, ship


#: Observations of the largest part up to which every part is fitted in a task.
IN_TASK = 250_000


def dealt(rows: DataFrame) -> tuple[DataFrame, bool, bool]:
    """``rows`` written by landmark (``lands``), or where that does not serve as observations; whether landmarks have chunks; whether all parts are small."""
    groups = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = kept(lands.lined(rows, groups))
    most = at.groupBy("part").agg(F.sum(F.size("cams")).alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= IN_TASK:
        return lands.opened(at).withColumn("chunk", F.lit(0)), False, True
    if lands.whole(at) and at.select(F.explode("cams")).distinct().count() <= lands.MOST_SENT:
        return at, False, False
    rows, split = chunked(lands.opened(at))
    return kept(rows.repartition(groups, "pt_id", *(["chunk"] if split else []))), split, False


def placed(rows: DataFrame, cam: DataFrame, pt: DataFrame) -> DataFrame:
    """``rows`` with p and q. With fc and fl a frozen camera or landmark has the parameters still, which do not move."""
    out = rows.join(pt.drop("part"), "pt_id").join(bounded(cam.drop("part"), MOST_SENT), "cam_id")
    if "fc" not in rows.columns:
        return out
    return out.withColumns({"p": F.expr("if(fc, p, still_p)"), "q": F.expr("if(fl, q, still_q)")}).drop("still_p", "still_q")


def part_costs(rows: DataFrame) -> DataFrame:
    """(part, before, after): squared residuals at p, q and at p + dp, q + dq."""
    ship(rows.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, out = Sums(), lambda ids, c: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(c)], ["part", "c"])
        for b in batches:
            if len(b):
                p, q, dp, dq = matrix(b["p"], 9), matrix(b["q"], 3), matrix(b["dp"], 9), matrix(b["dq"], 3)
                xy = np.stack([b["x"].to_numpy(), b["y"].to_numpy()], 1)
                yield from (out(*x) for x in sums.add(b["part"].to_numpy(), np.stack([np.square(residuals(*at, xy)).sum(1) for at in ((p, q), (p + dp, q + dq))], 1)))
        yield from (out(*x) for x in sums.rest())

    found = rows.select(F.col("part").cast("long"), "x", "y", "p", "q", "dp", "dq").mapInArrow(go, "part long, c array<double>")
    return found.groupBy("part").agg(F.sum(F.col("c")[0]).alias("before"), F.sum(F.col("c")[1]).alias("after"))


def curvature(rows: DataFrame, key: str) -> DataFrame:
    """(key, r): each camera's or landmark's block of J'J, with a thousandth of its largest eigenvalue on the diagonal. ``rows``: x, y, p, q and ids."""
    ship(rows.sparkSession)
    size = 9 if key == "cam_id" else 3

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, out = Sums(), lambda ids, m: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(m)], [key, "m"])
        for b in batches:
            if len(b):
                j = derived(b)[1 if size == 9 else 2]
                yield from (out(*x) for x in sums.add(b[key].to_numpy(), np.einsum("nki,nkj->nij", j, j).reshape(len(j), -1)))
        yield from (out(*x) for x in sums.rest())

    def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                m = matrix(b["m"], size, size)
                yield pa.RecordBatch.from_arrays([b[key], lists(m + 1e-3 * block_largest(m) + 1e-12 * np.eye(size))], [key, "r"])

    found = rows.select("cam_id", "pt_id", "x", "y", "p", "q").mapInArrow(go, f"{key} long, m array<double>")
    found = found.groupBy(key).agg(F.array(*(F.sum(F.col("m")[k]) for k in range(size * size))).alias("m"))
    return found.mapInArrow(raised, f"{key} long, r array<double>")


def curved(rows: DataFrame, cam: DataFrame, pt: DataFrame, key: str) -> DataFrame:
    """``curvature`` of ``rows`` from ``dealt``."""
    if "cams" in rows.columns:
        return lands.curvature(lands.with_points(rows, pt.select("pt_id", "q")), cam, key)
    return curvature(placed(rows, cam, pt), key)


def _pulled(m: str, d: str, n: int) -> list[str]:
    """SQL for the entries of a matrix of n * n times the array ``d``."""
    return [f"aggregate(zip_with(slice({m}, {n * i + 1}, {n}), {d}, (a, b) -> a * b), 0D, (t, z) -> t + z)" for i in range(n)]


def _in_tasks(rows: DataFrame, cam: DataFrame, pt: DataFrame, steps: int, damping: dict[int, float], pull: DataFrame | None, by: str):
    """``fit_parts`` of small parts, each in a task."""
    spark = rows.sparkSession
    ship(spark)

    def fit(part: int, block: pd.DataFrame, pulls: pd.DataFrame | None) -> pd.DataFrame:
        cams, fc, ci = np.unique(block.cam_id.to_numpy(), return_index=True, return_inverse=True)
        pts, fp, pi = np.unique(block.pt_id.to_numpy(), return_index=True, return_inverse=True)
        free = [block[c].to_numpy()[at].astype(float) if c in block else np.ones(len(at)) for c, at in (("fc", fc), ("fl", fp))]
        job = Local(ci, pi, block[["x", "y"]].to_numpy(), np.stack(block.p.to_numpy()[fc]), np.stack(block.q.to_numpy()[fp]), *free)
        if pulls is not None and len(pulls):
            ids, now = (cams, job.cam) if by == "cam_id" else (pts, job.pt)
            at, n = np.searchsorted(ids, pulls[by].to_numpy()), now.shape[1]
            r, to = np.zeros((len(ids), n, n)), now.copy()
            r[at], to[at] = np.stack(pulls.r).reshape(-1, n, n), np.stack(pulls.s)
            if by == "cam_id":
                job.pull_c, job.to_c = r, to
            else:
                job.pull_l, job.to_l = r, to
        before = job.cost(job.cam, job.pt)[0]
        after, last = job.fit(steps, damping.get(part, 1e-3))
        out = [("cam_id", int(i), x.tolist()) for i, x, f in zip(cams, job.cam, free[0], strict=True) if f] + [("pt_id", int(i), x.tolist()) for i, x, f in zip(pts, job.pt, free[1], strict=True) if f]
        return pd.DataFrame([*out, ("part", part, [before, after, last])], columns=["kind", "id", "x"])

    state, schema = placed(rows, cam, pt).groupBy("part"), "kind string, id long, x array<double>"
    if pull is None:
        new = kept(state.applyInPandas(lambda key, block: fit(int(key[0]), block, None), schema))
    else:
        pulls = pull.join((cam if by == "cam_id" else pt).select(by, "part"), by)
        new = kept(state.cogroup(pulls.groupBy("part")).applyInPandas(lambda key, block, pulls: fit(int(key[0]), block, pulls), schema))
    found = {r.id: r.x for r in new.where("kind = 'part'").select("id", "x").collect()}  # a row for each part
    cam, pt = (kept(t.join(new.where(F.col("kind") == key).select(F.col("id").alias(key), F.col("x").alias("new")), key, "left").withColumn(v, F.coalesce("new", v)).drop("new")) for t, key, v in ((cam, "cam_id", "p"), (pt, "pt_id", "q")))
    return cam, pt, {k: (x[0], x[1]) for k, x in found.items()}, {k: x[2] for k, x in found.items()}


def _by_landmark(rows: DataFrame, cam: DataFrame, pt: DataFrame, steps: int, damping: dict[int, float], pull: DataFrame | None, by: str, its: int, eps: float):
    """``fit_parts`` over rows of landmarks, which carry their own parameters and pulls; and these rows after the steps."""
    spark = rows.sparkSession
    costs, (n, x) = {}, (9, "p") if by == "cam_id" else (3, "q")
    damping = damping or {r.part: 1e-3 for r in rows.select("part").distinct().collect()}  # a row for each part
    points = pt.select("pt_id", "q", *([F.col("still_q").alias("still")] if "still_q" in pt.columns else []))
    if pull is not None and by == "pt_id":
        points = points.join(pull.select("pt_id", F.concat("r", "s").alias("pull")), "pt_id", "left").withColumn("pull", F.coalesce("pull", F.expr("array_repeat(0D, 12)")))
    at, first = kept(lands.with_points(rows, points)), cam
    part_of = kept(cam.select("cam_id", F.col("part").cast("long").alias("part")))
    for _ in range(steps):
        of_part = F.broadcast(spark.createDataFrame(list(damping.items()), "part long, l double"))  # a row for each part
        terms = part_of.join(of_part, "part").select("cam_id", "l")
        if pull is not None and by == "cam_id":
            off = cam.select("cam_id", "p").join(pull, "cam_id").withColumn("d", F.expr("zip_with(p, s, (a, b) -> a - b)"))
            off = off.select("cam_id", F.expr(f"concat(r, array({', '.join(_pulled('r', 'd', n))}))").alias("pull"))
            terms = terms.join(off, "cam_id", "left").withColumn("pull", F.coalesce("pull", F.expr("array_repeat(0D, 90)")))
        system = lands.Lined.at(at, cam, damping, True, terms)
        step = system.solve(its, eps)
        along, model = system.along(step, (1.0,)), system.slope_and_bend(step, part_of)
        found = {k: [*map(float, v[:4]), -float(v[4] + v[5] + sum(model.get(k, (0.0,))))] for k, v in along.items()}
        if pull is not None and by == "cam_id":
            off = cam.select("cam_id", "p").join(pull, "cam_id").join(part_of, "cam_id").join(step, "cam_id").selectExpr(
                "part", "r", "zip_with(p, s, (a, b) -> a - b) as d", "zip_with(zip_with(p, x, (a, b) -> a + b), s, (a, b) -> a - b) as e")
            whole = lambda d: " + ".join(f"{m} * {d}[{i}]" for i, m in enumerate(_pulled("r", d, n)))
            for r in off.groupBy("part").agg(F.expr(f"sum({whole('d')})").alias("d"), F.expr(f"sum({whole('e')})").alias("e")).collect():  # a row for each part
                found[r.part][2] += r.d
                found[r.part][3] += r.e
        taken = _taken(found, damping, costs)
        if taken:
            old, was = at, cam
            at = kept(system.moved(step, dict.fromkeys(taken, 1.0)))
            going = part_of.where(F.col("part").isin(taken)).select("cam_id").join(step, "cam_id")
            cam = kept(cam.join(going, "cam_id", "left").withColumn("p", F.expr("if(x is null, p, zip_with(p, x, (a, b) -> a + b))")).drop("x"))
            dropped(old, *([was] if was is not first else []))
        dropped(step)
        system.released()
        if all(found[p][2] - found[p][3] <= 1e-12 * found[p][2] for p in taken) and len(taken) == len(found):
            break
    pt = kept(pt.join(at.where("fl").select("pt_id", F.col("q").alias("new")), "pt_id", "left").withColumn("q", F.coalesce("new", "q")).drop("new"))
    dropped(part_of)
    return cam, pt, costs, damping, at


def _taken(found: dict[int, list[float]], damping: dict[int, float], costs: dict[int, tuple[float, float]]) -> list[int]:
    """Parts that take their step. ``found``: squared residuals before and after, the same with pulls, and the model's decrease. Dampings and costs are set."""
    taken = []
    for part, (plain, new_plain, full, new_full, model) in found.items():
        first = costs.get(part, (plain, plain))[0]
        if np.isfinite(new_full) and new_full <= full:
            ratio = (full - new_full) / max(model, 1e-300)
            damping[part] = damping[part] / 2 if ratio > 0.8 else damping[part] * 2 if ratio < 0.25 else damping[part]
            taken.append(part)
            costs[part] = first, new_plain
        else:
            damping[part] *= 2
            costs[part] = first, plain
    return taken


def fit_parts_curved(rows: DataFrame, split: bool, small: bool, cam: DataFrame, pt: DataFrame, steps: int, damping: dict[int, float] | None, pull: DataFrame | None, by: str):
    """``fit_parts``, and ``curved`` at where it ends, by ``by``."""
    if "cams" not in rows.columns:
        *out, last = fit_parts(rows, split, small, cam, pt, steps, damping, pull, by)
        return *out, last, kept(curved(rows, *out[:2], by))
    *out, at = _by_landmark(rows, cam, pt, steps, dict(damping or {}), pull, by, 50, 1e-3)
    r = kept(lands.curvature(at, out[0], by))
    dropped(at)
    return *out, r


def fit_parts(
    rows: DataFrame, split: bool, small: bool, cam: DataFrame, pt: DataFrame, steps: int, damping: dict[int, float] | None = None, pull: DataFrame | None = None, by: str = "pt_id",
    its: int = 50, eps: float = 1e-3,
) -> tuple[DataFrame, DataFrame, dict[int, tuple[float, float]], dict[int, float]]:
    """Levenberg-Marquardt steps of every part on its own. Returns cameras, landmarks, each part's squared residuals first and last, and its damping.

    ``rows``, ``split`` and ``small`` from ``dealt``: part, cam_id, pt_id, chunk, x, y, and fc, fl if some are frozen. ``cam``: cam_id, part,
    p, ``pt``: pt_id, part, q, each id of one part, with still_p and still_q if some are frozen. ``pull`` (``by``, r, s) adds
    (x - s)' r (x - s). A part takes its step if its cost with the pulls does not rise; its damping halves or doubles with the ratio
    of real to modelled decrease and doubles on rejection. The reduced system is solved to ``eps`` of the first residual of all parts together.
    """
    if small:
        return _in_tasks(rows, cam, pt, steps, damping or {}, pull, by)
    if "cams" in rows.columns:
        *out, at = _by_landmark(rows, cam, pt, steps, dict(damping or {}), pull, by, its, eps)
        dropped(at)
        return tuple(out)
    spark = rows.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    damping, costs = dict(damping or {}), {}
    n, x = (9, "p") if by == "cam_id" else (3, "q")
    for _ in range(steps):
        joined = placed(rows, cam, pt)
        if not damping:
            damping = {r.part: 1e-3 for r in rows.select(F.col("part").cast("long").alias("part")).distinct().collect()}  # a row for each part
        of_part = F.broadcast(spark.createDataFrame(list(damping.items()), "part long, l double"))  # a row for each part
        terms = {}
        for key, table, v in (("cam_id", cam, "p"), ("pt_id", pt, "q")):
            terms[key] = table.select(key, F.col("part").cast("long").alias("part"), v).join(of_part, "part")
            if pull is None or key != by:
                terms[key] = terms[key].select(key, "l", F.lit(None).cast("array<double>").alias("pull"))
            else:
                off = terms[key].join(pull, key, "left").withColumn("d", F.expr(f"zip_with({x}, s, (a, b) -> a - b)"))
                terms[key] = off.select(key, "l", F.expr(f"if(r is null, null, concat(r, array({', '.join(_pulled('r', 'd', n))})))").alias("pull"))
        system = Reduced.of(joined, split, 0.0, True, groups, kept(terms["cam_id"]), kept(terms["pt_id"]))
        cams, land = system.moves(system.solve(its, eps))
        moved = joined.join(bounded(cams.select("cam_id", "dp"), MOST_SENT), "cam_id").join(land.select("pt_id", "dq"), "pt_id")
        if "fc" in rows.columns:
            moved = moved.withColumns({"dp": F.expr("if(fc, dp, array_repeat(0D, 9))"), "dq": F.expr("if(fl, dq, array_repeat(0D, 3))")})
        found = {r.part: [r.before, r.after, r.before, r.after, 0.0] for r in part_costs(moved).collect()}  # a row for each part
        own = lambda key, table, step: step.join(table.select(key, F.col("part").cast("long").alias("part")), key)
        gains = own("cam_id", cam, cams).select("part", "a", "b").unionByName(own("pt_id", pt, land).select("part", "a", "b"))
        for r in gains.groupBy("part").agg(F.sum(F.col("a") + F.col("b")).alias("g")).collect():  # a row for each part
            found[r.part][4] = -r.g
        if pull is not None:
            step = cams.select("cam_id", F.col("dp").alias("step")) if by == "cam_id" else land.select("pt_id", F.col("dq").alias("step"))
            off = own(by, (cam if by == "cam_id" else pt), step).join((cam if by == "cam_id" else pt).select(by, x), by).join(pull, by)
            off = off.selectExpr("part", "r", f"zip_with({x}, s, (a, b) -> a - b) as d", f"zip_with(zip_with({x}, step, (a, b) -> a + b), s, (a, b) -> a - b) as e")
            whole = lambda d: " + ".join(f"{m} * {d}[{i}]" for i, m in enumerate(_pulled("r", d, n)))
            for r in off.groupBy("part").agg(F.expr(f"sum({whole('d')})").alias("d"), F.expr(f"sum({whole('e')})").alias("e")).collect():  # a row for each part
                found[r.part][2] += r.d
                found[r.part][3] += r.e
        taken = _taken(found, damping, costs)
        if taken:
            going = F.broadcast(spark.createDataFrame([(p, True) for p in taken], "go long, going boolean"))  # a row for each part
            cam, pt = (
                kept(table.join(step, key, "left").join(going, F.col("part") == F.col("go"), "left").withColumn(v, F.expr(f"if(going and {d} is not null, zip_with({v}, {d}, (a, b) -> a + b), {v})")).drop(d, "go", "going"))
                for table, step, key, v, d in ((cam, cams.select("cam_id", "dp"), "cam_id", "p", "dp"), (pt, land.select("pt_id", "dq"), "pt_id", "q", "dq")))
        system.released()
        if all(found[p][2] - found[p][3] <= 1e-12 * found[p][2] for p in taken) and len(taken) == len(found):
            break
    return cam, pt, costs, damping
