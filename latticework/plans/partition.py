"""Roots of a graph, and the sequential forms of partitioning: greedy agglomeration, completion in order, single moves.

The sequential forms take plain dictionaries and serve small graphs and as a measure for the forms over tables
(``merging``, ``operators.graph``), which the queries run.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators.graph import BALANCE, BALANCE_SCALE, VOLUME
from latticework.session import kept


def roots(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that edges (src, dst) lead to, for every id on an edge between two.

    Labels spread to neighbours and jump to their label's label until none changes; each round is checkpointed.
    """
    e = edges.select("src", "dst").where("src <> dst")
    e = kept(e.union(e.select("dst", "src")).distinct())
    label = kept(e.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("root")))
    while True:
        near = e.join(label.select(F.col("id").alias("dst"), "root"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("near"))
        new = label.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = label.select(F.col("id").alias("root"), F.col("root").alias("next"))
        new = kept(new.join(jump, "root", "left").select("id", F.least("root", F.coalesce("next", "root")).alias("root"), "old"))
        changed = new.where("root <> old").limit(1).count()
        label = new.select("id", "root")
        if not changed:
            return label


def merge_gain(w: float, wi: float, wj: float, si: int, sj: int, vi: int, vj: int, cameras: int, landmarks: int, target: float) -> float:
    a = si / (si + sj)
    balance = BALANCE_SCALE * ((si + sj) / cameras) * a * (1 - a)
    volume = target / landmarks * math.log(max(1e-6, (vi + vj) / (vi * vj)))
    return w / min(wi, wj) + BALANCE * balance + VOLUME * volume


def random_merges(edges: list[tuple[int, int, int]], seen: dict[int, np.ndarray], parts: int, merges: int, seed: int, cut: set[tuple[int, int]] = frozenset()) -> dict[int, int]:
    """Camera -> smallest camera of its group, after up to ``merges`` merges along seeded edges, edges in ``cut`` first.

    Groups stay within half a part's size and volume. It ends when no edge is left to try.
    """
    rng = np.random.default_rng(seed)
    order = [edges[i] for i in rng.permutation(len(edges))]
    order.sort(key=lambda e: (min(e[:2]), max(e[:2])) not in cut)
    size_limit = max(1, len(seen) // parts)
    volume_limit = len(np.unique(np.concatenate(list(seen.values())))) / parts if seen else 0
    parent, marks, size = {c: c for c in seen}, {c: set(v.tolist()) for c, v in seen.items()}, dict.fromkeys(seen, 1)

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    done = 0
    for a, b, _ in order:
        if done >= merges:
            break
        a, b = sorted((root(a), root(b)))
        if a == b or size[a] + size[b] > size_limit or len(marks[a] | marks[b]) > volume_limit:
            continue
        parent[b] = a
        marks[a] |= marks[b]
        size[a] += size[b]
        done += 1
    return {c: root(c) for c in seen}


def grow_parts(seen: dict[int, np.ndarray], parts: int) -> dict[int, int]:
    """Camera -> part: seeds with least overlap, then the smallest part takes the camera it overlaps best.

    Merit of a camera for a part: shared landmarks over one plus those shared with all parts. Ids decide ties.
    """
    marks = {c: set(v.tolist()) for c, v in seen.items()}
    seeds = [max(sorted(marks), key=lambda c: len(marks[c]))] if marks else []
    while len(seeds) < min(parts, len(marks)):
        covered = set().union(*(marks[c] for c in seeds))
        seeds.append(min((c for c in sorted(marks) if c not in seeds), key=lambda c: (len(marks[c] & covered), -len(marks[c]))))
    part = {c: p for p, c in enumerate(seeds)}
    held = [set(marks[c]) for c in seeds]
    while len(part) < len(marks):
        p = min(range(len(held)), key=lambda i: (len(held[i]), i))
        total = lambda c: sum(len(marks[c] & h) for h in held)
        best = max((c for c in sorted(marks) if c not in part), key=lambda c: len(marks[c] & held[p]) / (1 + total(c)))
        part[best] = p
        held[p] |= marks[best]
    return part


def agglomerate(
    edges: list[tuple[int, int, int]], seen: dict[int, np.ndarray], parts: int, most_volume: float = 4.0, merges: int = 0, seed: int = 0, cut: set[tuple[int, int]] = frozenset()
) -> dict[int, int]:
    """Cameras merged greedily to ``parts`` parts: camera id -> part.

    edges: (src, dst, shared landmarks). seen: each camera's sorted landmarks. A merge takes the pair of best gain
    whose joint size and landmark union stay within limits; ties go to the smaller ids. It ends at ``parts`` parts or
    when no pair is left within the limits, so there may be more. Parts are numbered by their smallest camera.
    ``merges`` random merges (``random_merges``) may come first.
    """
    if merges:
        group = random_merges(edges, seen, parts, merges, seed, cut)
        joint: dict[tuple[int, int], int] = defaultdict(int)
        for a, b, w in edges:
            if group[a] != group[b]:
                joint[min(group[a], group[b]), max(group[a], group[b])] = max(w, joint[min(group[a], group[b]), max(group[a], group[b])])
        whole = {r: np.unique(np.concatenate([seen[c] for c in seen if group[c] == r])) for r in set(group.values())}
        found = agglomerate([(a, b, w) for (a, b), w in sorted(joint.items())], whole, parts, most_volume)
        return {c: found[group[c]] for c in seen}
    cameras, landmarks = len(seen), len(np.unique(np.concatenate(list(seen.values())))) if seen else 0
    size_limit, volume_limit = max(1, 2 * cameras // parts), min(most_volume, parts) * landmarks / parts
    target = 1.5 * landmarks / parts
    marks = {c: set(v.tolist()) for c, v in seen.items()}
    size, weight, alive = dict.fromkeys(seen, 1), defaultdict(float), set(seen)
    near: dict[int, dict[int, float]] = {c: {} for c in seen}
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
        weight[a] += w
        weight[b] += w
    barred: set[tuple[int, int]] = set()
    member = {c: [c] for c in seen}

    def best(i: int) -> tuple[float, int] | None:
        top = None
        for j, w in near[i].items():
            if size[i] + size[j] > size_limit or (min(i, j), max(i, j)) in barred:
                continue
            g = merge_gain(w, max(weight[i], 1e-9), max(weight[j], 1e-9), size[i], size[j], len(marks[i]), len(marks[j]), cameras, max(1, landmarks), target)
            if top is None or g > top[0] or g == top[0] and j < top[1]:
                top = (g, j)
        return top

    heap: list[tuple[float, int, int]] = []

    def push(i: int) -> None:
        if top := best(i):
            heapq.heappush(heap, (-top[0], i, top[1]))

    for c in sorted(seen):
        push(c)
    while len(alive) > parts and heap:
        g, i, j = heapq.heappop(heap)
        if i not in alive:
            continue
        now = best(i)
        if now is None or (-now[0], now[1]) != (g, j):
            if now is not None:
                heapq.heappush(heap, (-now[0], i, now[1]))
            continue
        union = marks[i] | marks[j]
        if len(union) > volume_limit:
            barred.add((min(i, j), max(i, j)))
            push(i)
            continue
        a, b = min(i, j), max(i, j)
        weight[a] += weight[b] - (len(union) - len(marks[a]))
        weight[a] = max(weight[a], 1e-9)
        marks[a], size[a] = union, size[a] + size[b]
        member[a] += member.pop(b)
        alive.discard(b)
        for k, w in near.pop(b).items():
            near[k].pop(b, None)
            if k != a:
                near[a][k] = near[k][a] = max(near[a].get(k, 0.0), w)
                if (min(b, k), max(b, k)) in barred:
                    barred.add((min(a, k), max(a, k)))
        near[a].pop(b, None)
        push(a)  # its neighbours' entries are weighed anew when they come up
    order = sorted(alive, key=lambda c: min(member[c]))
    return {c: p for p, root in enumerate(order) for c in member[root]}


def complete_in_order(counts: dict[int, dict[int, int]], loads: dict[int, int]) -> dict[int, int]:
    """Landmark -> part, the sequential form: in ascending id to the part that misses fewest observations, ties by load.

    counts: observations of each landmark by part. What a part must borrow adds to its load.
    """
    load, out = dict(loads), {}
    for lm in sorted(counts):
        here, total = counts[lm], sum(counts[lm].values())
        part = min(here, key=lambda p: (total - here[p], load[p], p))
        out[lm] = part
        load[part] += total - here[part]
    return out


def move_gain(before: int, after: int, most: int, temperature: float) -> float:
    if min(before, after) > most or (before == 0 and after <= 0):
        return 0.0
    return math.exp(-after / most * temperature) - math.exp(-before / most * temperature)


def recluster(
    counts: dict[int, dict[int, int]], owner: dict[int, int], most: int = 5, temperature: float = 5.0, rounds: int = 31, step: int = 5, limit: int = 20
) -> dict[int, int]:
    """Moves single landmarks between parts so that cameras with few landmarks leave a part: landmark -> part.

    counts: each landmark's cameras and how often they see it. A landmark of a weak camera, one with at most ``most``
    observations in a part and others elsewhere, moves to the part of best total gain over its cameras, if that is
    positive; ids decide ties. It ends when weak cameras are left but no move is, or after ``rounds`` passes. Once no
    weak camera is left, ``most`` grows by ``step`` up to ``limit``, also at the start.
    """
    owner = dict(owner)
    here: dict[tuple[int, int], int] = defaultdict(int)
    by_camera: dict[int, set[int]] = defaultdict(set)
    for lm, cams in counts.items():
        for c, n in cams.items():
            here[owner[lm], c] += n
            by_camera[c].add(lm)
    parts = sorted(set(owner.values()))
    total = {c: sum(counts[lm][c] for lm in lms) for c, lms in by_camera.items()}
    weak = lambda: sorted((p, c) for (p, c), n in here.items() if 0 < n <= most and n < total[c])
    for _ in range(rounds):
        while not (found := weak()) and most < limit:
            most = min(most + step, limit)
        moved = 0
        for p, c in found:
            for lm in sorted(x for x in by_camera[c] if owner[x] == p):
                top, to = 1e-12, p
                for q in parts:
                    if q == p:
                        continue
                    g = sum(
                        move_gain(here[p, k], here[p, k] - n, most, temperature) + move_gain(here[q, k], here[q, k] + n, most, temperature)
                        for k, n in counts[lm].items()
                    )
                    if g > top:
                        top, to = g, q
                if to != p:
                    for k, n in counts[lm].items():
                        here[p, k] -= n
                        here[to, k] += n
                    owner[lm] = to
                    moved += 1
        if not moved:
            break
    return owner
