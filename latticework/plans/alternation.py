"""Alternation over parts in order: parts that share no observation move together, the others after them.

A part moves its own cameras and landmarks and keeps what it borrows frozen. Parts are colours of their conflict graph, a
sweep goes through the colours, and one reduced system holds all parts of a colour: its blocks do not couple parts, so it
solves each of them as if it were alone, and no part is held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.kernels import residuals
from latticework.operators.relational import bounded
from latticework.plans import lands
from latticework.plans.bundle import Fit, cost
from latticework.plans.reduced import MOST_SENT, Reduced, chunked, costs_along, lists, matrix, summed
from latticework.session import dropped, kept, ship


def residual_sets(obs: DataFrame, cam_owner: DataFrame, pt_owner: DataFrame) -> DataFrame:
    """``obs`` with part, fc and fl: the residuals that a part has by its own cameras (fc), and those that it borrows for its landmarks.

    Owners: (cam_id, part) and (pt_id, part), each id once. Of a part's own residuals only landmarks that it owns move (fl); of the borrowed ones the camera
    is frozen. An observation between two parts is thus in both sets, between a part and no part in one, else in none.
    """
    placed = obs.join(cam_owner.select("cam_id", F.col("part").alias("pc")), "cam_id", "left").join(pt_owner.select("pt_id", F.col("part").alias("pl")), "pt_id", "left")
    sets = placed.withColumn("part", F.explode(F.array_distinct(F.array("pc", "pl")))).where("part is not null")
    return sets.select(*obs.columns, "part", F.expr("part <=> pc").alias("fc"), F.expr("part <=> pl").alias("fl"))


def part_conflicts(obs: DataFrame, cam_owner: DataFrame, pt_owner: DataFrame) -> DataFrame:
    """(a, b, n): parts a < b and the observations between a camera of one and a landmark of the other."""
    placed = obs.join(cam_owner.select("cam_id", F.col("part").alias("pc")), "cam_id").join(pt_owner.select("pt_id", F.col("part").alias("pl")), "pt_id")
    return placed.where("pc <> pl").groupBy(F.least("pc", "pl").alias("a"), F.greatest("pc", "pl").alias("b")).agg(F.count("*").alias("n"))


def part_colours(conflicts: DataFrame, parts: DataFrame) -> DataFrame:
    """(part, colour): no two parts in conflict have one colour. ``conflicts``: (a, b), ``parts``: (part).

    In each round every part that comes first among its uncoloured neighbours, in the order of a hash, takes the least
    colour that no neighbour has. That is what one part after another would take in that order, so colours do not depend
    on how rows are dealt, and they are at most one more than a part has neighbours.
    """
    both = kept(conflicts.select("a", "b").unionByName(conflicts.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = kept(parts.select("part", F.struct(F.xxhash64("part").alias("h"), F.col("part").alias("id")).alias("rank"), F.lit(None).cast("int").alias("colour")).distinct())
    while not state.where("colour is null").isEmpty():
        near = both.join(state.select(F.col("part").alias("b"), F.col("rank").alias("near"), F.col("colour").alias("taken")), "b")
        seen = near.groupBy(F.col("a").alias("part")).agg(F.min(F.when(F.col("taken").isNull(), F.col("near"))).alias("first"), F.collect_set("taken").alias("taken"))
        free = F.expr("case when taken is null then 0 else array_min(array_except(sequence(0, size(taken)), taken)) end")
        turn = F.col("colour").isNull() & (F.col("first").isNull() | (F.col("rank") < F.col("first")))
        state = kept(state.join(seen, "part", "left").select("part", "rank", F.when(turn, free).otherwise(F.col("colour")).alias("colour")))
    return state.select("part", "colour")


def shares_of_parts(rows: DataFrame, places: tuple[float, ...]) -> DataFrame:
    """(part, share, before, after): the cheapest share of a step for each part, 0 if none pays, with the costs of its residuals.

    ``rows``: part, x, y, p, q, dp, dq. One pass: tasks add up all places for each part of a batch before the shuffle.
    """
    ship(rows.sparkSession)
    places = (0.0, *places)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                p, q, dp, dq = matrix(b["p"], 9), matrix(b["q"], 3), matrix(b["dp"], 9), matrix(b["dq"], 3)
                xy = np.stack([b["x"].to_numpy(), b["y"].to_numpy()], 1)
                found, sums = summed(b["part"].to_numpy(), np.stack([np.square(residuals(p + a * dp, q + a * dq, xy) if a else residuals(p, q, xy)).sum(1) for a in places], 1))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), lists(sums)], ["part", "c"])

    costs = rows.select(F.col("part").cast("long"), "x", "y", "p", "q", "dp", "dq").mapInArrow(go, "part long, c array<double>")
    costs = costs.groupBy("part").agg(F.array(*(F.sum(F.col("c")[k]) for k in range(len(places)))).alias("c"))
    at = f"array({', '.join(f'{a!r}D' for a in places)})"
    return costs.selectExpr("part", f"element_at({at}, cast(array_position(c, array_min(c)) as int)) as share", "c[0] as before", "array_min(c) as after")


def _moved(now: DataFrame, key: str, x: str, step: DataFrame, share: str) -> DataFrame:
    """``now`` (key, x) moved by a share of ``step`` (key, d, and what ``share`` names); rows without a step stay."""
    return now.join(step, key, "left").select(key, F.expr(f"case when d is null then {x} else zip_with({x}, d, (a, b) -> a + {share} * b) end").alias(x))


def _by_landmark(
    at: DataFrame, every: DataFrame, cam: DataFrame, pt: DataFrame, cam_owner: DataFrame, parts: dict[int, DataFrame], sweeps: int, its: int, eps: float, damping: float, push: bool, places: tuple[float, ...],
) -> Fit:
    """``ordered_palm`` where cameras go to every task and every landmark of a part has one row: steps are passes over these rows.

    ``at``: rows of the parts' landmarks and ``every``: of all, without parameters, ``parts``: (part) of each colour.
    """
    still = lambda x: f"transform({x}, a -> 0D) as d{x}"
    here = lambda: lands.costs(every, cam.selectExpr("cam_id", "p", still("p")), pt.selectExpr("pt_id", "q", still("q")), (0.0,))[0]
    dampings, costs, delta = dict.fromkeys(parts, damping), [here()], None
    for sweep in range(1, sweeps + 1):
        old_cam, old_pt = cam, pt
        for k, own in parts.items():
            rows = kept(lands.with_points(at.join(F.broadcast(own), "part"), pt.selectExpr("pt_id", "q", "q as still")))  # own: a row for each part
            system = lands.Lined.at(rows, cam.selectExpr("cam_id", "p", "p as still_p"), dampings[k])
            step = system.solve(its, eps)
            shares = {p: (0.0, *places)[int(np.argmin(np.where(np.isfinite(c), c, np.inf)[: len(places) + 1]))] for p, c in system.along(step, places).items()}
            moved = system.moved(step, shares).where("fl").select("pt_id", F.col("q").alias("new"))
            was = [t for t in (cam, pt) if t is not old_cam and t is not old_pt]
            pt = kept(pt.join(moved, "pt_id", "left").select("pt_id", F.coalesce("new", "q").alias("q")))
            going = cam.sparkSession.createDataFrame([(p, float(a)) for p, a in shares.items() if a > 0], "part long, share double")  # a row for each part
            going = step.withColumnRenamed("x", "d").join(cam_owner, "cam_id").join(F.broadcast(going), "part").select("cam_id", "d", "share")
            cam = kept(_moved(cam, "cam_id", "p", going, "share"))
            dropped(rows, step, *was)
            system.released()
            least = min(shares.values(), default=1.0)
            dampings[k] *= 0.5 if least == 1 else 2 if least < 0.5 else 1
        ahead = (sweep - 1) / (sweep + 2)
        if push and delta is not None:
            dc, dl = delta
            tries = (ahead, ahead * 2 / 3, ahead / 3, 0.0)
            found = lands.costs(every, cam.join(dc.withColumnRenamed("d", "dp"), "cam_id"), pt.join(dl.withColumnRenamed("d", "dq"), "pt_id"), tries)
            share = next(a for a, c in zip(tries, found, strict=True) if c <= found[-1])
            costs.append(min(found[tries.index(share)], found[-1]))
            if share:
                was = cam, pt
                cam, pt = kept(_moved(cam, "cam_id", "p", dc, f"{share!r}D")), kept(_moved(pt, "pt_id", "q", dl, f"{share!r}D"))
                dropped(*was)
        else:
            costs.append(here())
        if push:
            minus, old = "zip_with({0}, o, (a, b) -> a - b) as d", delta or ()
            delta = tuple(kept(a.join(b.withColumnRenamed(x, "o"), key).selectExpr(key, minus.format(x))) for a, b, key, x in ((cam, old_cam, "cam_id", "p"), (pt, old_pt, "pt_id", "q")))
            dropped(*old)
        dropped(*(t for t in (old_cam, old_pt) if t is not cam and t is not pt))
    return Fit(cam, pt, costs)


def ordered_palm(
    obs: DataFrame, cam: DataFrame, pt: DataFrame, cam_owner: DataFrame, pt_owner: DataFrame, sweeps: int = 5, its: int = 10, eps: float = 1e-2,
    damping: float = 1e-3, push: bool = True, places: tuple[float, ...] = (1.0, 0.5, 0.25, 0.0625), groups: int | None = None,
) -> Fit:
    """Proximal alternation in sweeps over the colours of the parts; the cost falls or stays at every colour.

    A colour's parts take one damped step each, from where the colours before have left the rest, and each goes the share
    of it that is cheapest for its own residuals. Damping halves for a colour whose parts all go the whole step and
    doubles if one goes less than half. With a ``push`` a sweep is followed by momentum, (sweep - 1) / (sweep + 2) of what
    the last sweep moved, of which the largest of three shares that does not raise the cost is taken, from one pass.
    Cameras and landmarks without an owner stay as they are. Costs are those after each sweep, the start first.
    """
    cam, pt = kept(cam), kept(pt)
    obs = kept(obs.join(cam.select("cam_id"), "cam_id", "left_semi"))
    cam_owner, pt_owner = kept(cam_owner.select("cam_id", F.col("part").cast("long"))), kept(pt_owner.select("pt_id", F.col("part").cast("long")))
    groups = groups or int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = residual_sets(obs, cam_owner, pt_owner)
    colour = kept(part_colours(part_conflicts(obs, cam_owner, pt_owner), sets.select("part").distinct()))
    colours = [r.colour for r in colour.select("colour").distinct().orderBy("colour").collect()]
    at = kept(lands.lined(sets.select("part", "cam_id", "pt_id", "x", "y", "fc", "fl"), groups))
    every = kept(lands.lined(obs.select("cam_id", "pt_id", "x", "y"), groups))  # also those of no part
    if cam.count() <= lands.MOST_SENT and lands.whole(every):
        parts = {k: colour.where(F.col("colour") == k).select("part") for k in colours}
        return _by_landmark(at, every, cam, pt, cam_owner, parts, sweeps, its, eps, damping, push, places)
    dropped(at, every)
    rows, split = chunked(kept(sets.join(bounded(colour, MOST_SENT), "part")))
    rows = kept(rows.repartition(groups, "pt_id", *(["chunk"] if split else [])).sortWithinPartitions("colour"))
    dampings, costs, delta = dict.fromkeys(colours, damping), [cost(obs, cam, pt).first().cost], None
    for sweep in range(1, sweeps + 1):
        old_cam, old_pt = cam, pt
        for k in colours:
            joined = rows.where(F.col("colour") == k).join(pt, "pt_id").join(bounded(cam, MOST_SENT), "cam_id")
            system = Reduced.of(joined, split, dampings[k], True, groups)
            dp, dq, _, _ = system.steps(system.solve(its, eps))
            shares = kept(shares_of_parts(joined.join(bounded(dp, MOST_SENT), "cam_id").join(dq, "pt_id"), places))
            going = bounded(shares.where("share > 0").select("part", "share"), MOST_SENT)
            cam = kept(_moved(cam, "cam_id", "p", dp.withColumnRenamed("dp", "d").join(cam_owner, "cam_id").join(going, "part").select("cam_id", "d", "share"), "share"))
            pt = kept(_moved(pt, "pt_id", "q", dq.withColumnRenamed("dq", "d").join(pt_owner, "pt_id").join(going, "part").select("pt_id", "d", "share"), "share"))
            system.released()
            least = shares.agg(F.min("share")).first()[0]
            dampings[k] *= 0.5 if least == 1 else 2 if least < 0.5 else 1
        ahead = (sweep - 1) / (sweep + 2)
        if push and delta is not None:
            dc, dl = delta
            tried = obs.join(bounded(cam, MOST_SENT), "cam_id").join(pt, "pt_id").join(bounded(dc.withColumnRenamed("d", "dp"), MOST_SENT), "cam_id").join(dl.withColumnRenamed("d", "dq"), "pt_id")
            tries = (ahead, ahead * 2 / 3, ahead / 3, 0.0)
            found = costs_along(tried, tries)
            share = next(a for a, c in zip(tries, found, strict=True) if c <= found[-1])
            costs.append(min(found[tries.index(share)], found[-1]))
            if share:
                cam, pt = kept(_moved(cam, "cam_id", "p", dc, f"{share!r}D")), kept(_moved(pt, "pt_id", "q", dl, f"{share!r}D"))
        else:
            costs.append(cost(obs, cam, pt).first().cost)
        if push:
            minus = "zip_with({0}, o, (a, b) -> a - b) as d"
            delta = tuple(kept(a.join(b.withColumnRenamed(x, "o"), key).selectExpr(key, minus.format(x))) for a, b, key, x in ((cam, old_cam, "cam_id", "p"), (pt, old_pt, "pt_id", "q")))
    return Fit(cam, pt, costs)
