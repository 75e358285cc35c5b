"""Mixing overlapping sources to target weights by min-cost flow and seeded selection."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.llm.shared import WORD, written
from latticework.plans.partition import roots
from latticework.session import ship

#: No document is taken more often.
REPEATS = 3
#: Rows of a plan up to which it is broadcast; a longer one is joined by pattern and salt.
MOST_SENT = 20_000
#: Leading hex digits of the seeded key that salt that join.
SALT_DIGITS = 2
#: Hex digits of the seeded key that make a bucket; only one bucket of a pattern is ever sorted.
BUCKET_DIGITS = 3


def code_points(source: str | None) -> tuple[bool, str]:
    """Sort key: by code point, null last."""
    return source is None, source or ""


def targets(sizes: dict[str | None, int], weights: Sequence[int] = (1, 2, 3), repeats: int = REPEATS) -> dict[str | None, float]:
    """Words wanted from each source: shares of the total by weight, at most ``repeats`` times the source's size.

    Sources by code point (null last) weigh ``weights``, repeating. What a source cannot give is shared again by weight.
    """
    order = sorted(sizes, key=code_points)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, free, out = sum(sizes.values()), list(order), {}
    while True:
        total = sum(weight[s] for s in free)
        over = [s for s in free if repeats * sizes[s] * total < rest * weight[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in free}
        for s in over:
            out[s] = float(repeats * sizes[s])
            rest -= repeats * sizes[s]
            free.remove(s)


def route(patterns: dict[tuple, int], quota: dict[str | None, int], repeats: int = REPEATS) -> dict[tuple, dict[str | None, int]]:
    """Min-cost flow of words from membership patterns to source quotas.

    A pattern gives its size once at no cost, then again at cost 1, 2, ...: repetition costs are convex, so
    fresh words go first. It may serve any source of which its documents are members. Successive shortest
    paths; each augmentation fills an arc, so there are at most about arcs^2 steps. Returns words by pattern and source.
    """
    heads: list[int] = []
    caps: list[int] = []
    costs: list[int] = []
    out: list[list[int]] = [[], []]

    def node() -> int:
        out.append([])
        return len(out) - 1

    def arc(a: int, b: int, cap: int, cost: int) -> int:
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            out[u].append(len(heads))
            heads.append(v)
            caps.append(c)
            costs.append(w)
        return len(heads) - 2

    sink_of = {}
    for s in sorted(quota, key=code_points):
        sink_of[s] = node()
        arc(sink_of[s], 1, quota[s], 0)
    served: dict[tuple, dict[str | None, int]] = {}
    for p in sorted(patterns, key=lambda p: [code_points(s) for s in p]):
        n = node()
        for again in range(repeats):
            arc(0, n, patterns[p], again)
        served[p] = {s: arc(n, sink_of[s], repeats * patterns[p], 0) for s in p if s in sink_of}
    while True:
        far: dict[int, tuple[int, int]] = {0: (0, -1)}
        queue, waiting = [0], {0}
        while queue:
            u = queue.pop(0)
            waiting.discard(u)
            for e in out[u]:
                d = far[u][0] + costs[e]
                if caps[e] and (heads[e] not in far or d < far[heads[e]][0]):
                    far[heads[e]] = (d, e)
                    if heads[e] not in waiting:
                        waiting.add(heads[e])
                        queue.append(heads[e])
        if 1 not in far:
            return {p: {s: caps[e + 1] for s, e in arcs.items()} for p, arcs in served.items()}
        path, v = [], 1
        while v:
            path.append(far[v][1])
            v = heads[far[v][1] ^ 1]
        step = min(caps[e] for e in path)
        for e in path:
            caps[e] -= step
            caps[e ^ 1] += step


def goals(patterns: DataFrame, weights: Sequence[int] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """(pattern, at, source_size, target) of each source, its name as a pattern of one: ``targets`` over a table of any length.

    ``patterns``: (pattern, n). Sources are ranked by one range sort. Full sources are those below the level of water, which rises
    from round to round as what they cannot take is shared again; a round is one aggregate.
    """
    one = patterns.select(F.explode("pattern").alias("source"), "n").groupBy("source").agg(F.sum("n").alias("n"))
    order = written(one.orderBy(F.asc_nulls_last("source")).withColumn("id", F.monotonically_increasing_id()), "mixing-sources")
    piece = F.shiftright("id", 33)
    starts = order.groupBy(piece.alias("piece")).agg(F.count("*").alias("n"))  # a row for each task
    before = F.coalesce(F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(starts.select("piece", before.alias("before")))
    at = F.col("before") + F.col("id") - F.shiftleft("piece", 33)
    weight = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int")).cast("long")
    rows = written(order.withColumn("piece", piece).join(starts, "piece").select("source", "n", at.alias("at"), weight.alias("weight")), "mixing-weights")
    size, all_weight = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, free, known = size, all_weight, 0
    wide = lambda c: F.lit(c).cast("decimal(19,0)")
    while True:
        full = (F.col("n") * repeats).cast("decimal(18,0)") * wide(free) < F.col("weight").cast("decimal(18,0)") * wide(rest)
        found, taken, held = rows.where(full).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if found == known:
            break
        rest, free, known = size - repeats * taken, all_weight - held, found
    share = (F.lit(rest) * F.col("weight")).cast("double") / float(max(1, free))
    return rows.select(F.array("source").alias("pattern"), "at", F.col("n").alias("source_size"), F.when(full, (F.col("n") * repeats).cast("double")).otherwise(share).alias("target"))


def flows(patterns: DataFrame, goal: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(pattern, flow): words wanted of each pattern.

    Where no pattern of several sources meets a source, its own pattern gives its quota. Sources that such patterns link form
    components, and each is a flow problem of its own (``route``), solved in a task; its memory is that of its patterns.
    """
    quota = goal.select("pattern", "at", F.col("target").cast("long").alias("quota"))
    several = patterns.where(F.size("pattern") > 1)
    if several.isEmpty():
        return quota.select("pattern", F.col("quota").alias("flow"))
    ship(patterns.sparkSession)
    members = several.select(F.col("pattern").alias("whole"), F.explode("pattern").alias("source")).select("whole", F.array("source").alias("pattern"))
    ids = written(members.join(quota, "pattern").select("whole", "at"), "mixing-members")
    first = ids.groupBy("whole").agg(F.min("at").alias("src"))
    linked = roots(ids.join(first, "whole").select("src", F.col("at").alias("dst"))).select(F.col("id").alias("at"), "root")
    wanted = quota.join(linked, "at")
    own = patterns.where(F.size("pattern") == 1).join(wanted.select("pattern", "root"), "pattern")
    many = patterns.join(first.withColumnRenamed("whole", "pattern"), "pattern").join(linked.withColumnRenamed("at", "src"), "src")
    rows = own.select("root", "pattern", "n", F.lit(False).alias("goal")).union(many.select("root", "pattern", "n", F.lit(False))).union(wanted.select("root", "pattern", "quota", F.lit(True)))

    def solve(block: pd.DataFrame) -> pd.DataFrame:
        sizes, wanted = ({tuple(p): int(n) for p, n in zip(b.pattern, b.n, strict=True)} for b in (block[~block.goal], block[block.goal]))
        found = route(sizes, {p[0]: n for p, n in wanted.items()}, repeats)
        return pd.DataFrame({"pattern": [list(p) for p in found], "flow": [sum(to.values()) for to in found.values()]})

    routed = rows.groupBy("root").applyInPandas(solve, "pattern array<string>, flow long")
    return quota.join(linked, "at", "left_anti").select("pattern", F.col("quota").alias("flow")).union(routed)


def mixed(docs: DataFrame, members, weights: Sequence[int] = (1, 2, 3), seed: int = 17, keep: Sequence[str] = ()) -> DataFrame:
    """How often each document is taken so that every source comes near its target.

    ``docs`` needs doc_id and text; ``members`` is a column of array<string>, the sources a document belongs to
    (null is a source; repeated names count once; a null or empty array belongs to none and is never taken).
    Returns doc_id, the columns ``keep``, pattern, size (words, null text: 0), times, taken (times * size).

    Sizes are summed by pattern, targets found by ``goals`` and routed by ``flows``, all as tables. A pattern's flow is so many
    whole passes over it and a rest; the rest takes documents in the order of md5(seed|doc_id) (ties: doc_id, size) as long as a
    document's middle lies within it, so a pattern misses its flow by half a document at most. The order decides only through
    a histogram of key prefixes and one sorted bucket of each pattern, never a whole source in one task.
    Reruns agree. Empty tables give empty results.
    """
    return _taken(docs, members, weights, seed, keep).select("doc_id", *keep, "pattern", "size", "times", "taken")


def _taken(docs: DataFrame, members, weights: Sequence[int], seed: int, keep: Sequence[str]) -> DataFrame:
    """``mixed`` with goal_size and goal, a source's own size and target, for documents of one source."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pattern = F.array_sort(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    sized = docs.select(
        "doc_id", *keep, pattern.alias("pattern"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )
    sized = written(sized.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)), "mixing-sized")
    buckets = written(sized.groupBy("pattern", "bucket").agg(F.sum("size").alias("n")), "mixing-buckets")
    patterns = written(buckets.groupBy("pattern").agg(F.sum("n").alias("n")), "mixing-patterns")
    goal = written(goals(patterns, weights), "mixing-goals")
    flow, n = F.coalesce("flow", F.lit(0)), F.greatest("n", F.lit(1))
    plan = patterns.join(flows(patterns, goal), "pattern", "left").select("pattern", F.expr("coalesce(flow, 0) div greatest(n, 1)").alias("passes"), (flow % n).alias("rest"))
    plan = written(plan, "mixing-plan")
    sent = plan.count() <= MOST_SENT
    by_key = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** BUCKET_DIGITS rows
    cut = buckets.join(F.broadcast(plan) if sent else plan, "pattern").withColumn("before", F.coalesce(F.sum("n").over(by_key), F.lit(0)))
    inner = F.expr("before < rest and rest < before + n")
    cut = cut.groupBy("pattern").agg(
        F.max(F.when(inner, F.col("bucket"))).alias("cut"), F.max(F.when(inner, F.col("before"))).alias("before"), F.max(F.when(F.expr("before + n <= rest"), F.col("bucket"))).alias("whole"))
    own = goal.select("pattern", F.col("source_size").alias("goal_size"), F.col("target").alias("goal"))
    plan = written(plan.join(cut, "pattern", "left").join(own, "pattern", "left"), "mixing-cuts")
    if sent:
        rows = sized.join(F.broadcast(plan), "pattern")
    else:
        salt = [f"{i:0{SALT_DIGITS}x}" for i in range(16**SALT_DIGITS)]
        rows = sized.withColumn("salt", F.substring("key", 1, SALT_DIGITS)).join(plan.withColumn("salt", F.explode(F.array(*map(F.lit, salt)))), ["pattern", "salt"]).drop("salt")
    inside = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    within = Window.partitionBy("pattern").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sorted_ = rows.where(inside).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    sorted_ = sorted_.withColumn("once", (2 * F.col("at") + F.col("size") <= 2 * F.col("rest")).cast("long")).drop("at")
    others = rows.where(~inside).withColumn("once", F.coalesce(F.col("bucket") <= F.col("whole"), F.lit(False)).cast("long"))
    both = others.unionByName(sorted_).withColumn("times", F.when(F.size("pattern") > 0, F.col("passes") + F.col("once")).otherwise(0).cast("long"))
    return both.withColumn("taken", F.col("times") * F.col("size"))


def mix_by_source(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """``mixed`` where each document belongs to its own source; with its source's size and target.

    Returns doc_id, source, size, source_size, target, times, taken, one row per input row.
    """
    own = _taken(docs, F.array(F.col("source").cast("string")), weights, seed, ["source"])
    return own.select("doc_id", "source", "size", F.col("goal_size").alias("source_size"), F.col("goal").alias("target"), "times", "taken")
