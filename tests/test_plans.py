import os

import numpy as np
import pytest

from latticework.functions.kernels import Local
from latticework.operators import graph, relational
from latticework.plans import bundle, catalogue, merging, numeric, partition
from tests.scenes import scene, shaken, tables


@pytest.fixture(scope="module")
def problem(spark):
    cam, pt, ci, pi, xy = scene(6, 60, 4, 0.3, 5)
    c, p = shaken(cam, pt)
    job = Local(ci, pi, xy, c.copy(), p.copy())
    best, _ = job.fit(60)
    return tables(spark, c, p, ci, pi, xy), best, job.cost(c, p)[0]


def test_cost_matches_dense(spark, problem):
    (obs, cam, pt), _, before = problem
    assert bundle.cost(obs, cam, pt).first().cost == pytest.approx(before, rel=1e-9)


def test_lm_fit_reaches_dense_cost(spark, problem):
    (obs, cam, pt), best, before = problem
    fit = bundle.lm_fit(obs, cam, pt, 3, groups=3, its=10)
    assert fit.costs[0] == pytest.approx(before, rel=1e-9)
    assert all(b <= a * (1 + 1e-12) for a, b in zip(fit.costs, fit.costs[1:]))
    assert fit.costs[-1] < best * 1.05


def test_badly_scaled_cameras_need_the_scale(spark):
    """Where derivatives differ by 1e11, a plain inverse takes the smallest for nothing and leaves that parameter as it is."""
    from latticework.plans import reduced

    cam, pt, ci, pi, xy = scene(3, 40, 3, 0.2, 5)
    cam[:, 6] *= 1e9
    obs, c, p = tables(spark, cam, pt, ci, pi, xy * 1e9)
    rows, split = reduced.chunked(obs)
    for scaled in (True, False):
        system = reduced.Reduced.of(rows.join(c, "cam_id").join(p, "pt_id"), split, 0.1, scaled)
        for r in system.cams.collect():
            focal = (np.reshape(r.m, (9, 9)) @ np.reshape(r.u, (9, 9)))[6, 6]
            assert focal > 0.5 if scaled else abs(focal) < 1e-3
        system.released()


@pytest.mark.parametrize("by", ["cam_id", "pt_id"])
def test_consensus_lowers_cost(spark, problem, by):
    (obs, cam, pt), best, before = problem
    ids = obs.select(by).distinct()
    fit = bundle.drs_fit(obs, cam, pt, relational.range_parts(ids, by, 2), by, rounds=6)
    assert fit.costs[-1] < 0.2 * before


@pytest.mark.parametrize("memory", [0, 3])
def test_consensus_comes_near_the_whole_fit(spark, problem, memory):
    (obs, cam, pt), best, before = problem
    fit = bundle.drs_fit(obs, cam, pt, relational.range_parts(obs.select("cam_id"), "cam_id", 2), "cam_id", rounds=5, memory=memory)
    assert fit.costs[-1] < 1.05 * best and all(b <= a for a, b in zip(fit.costs, fit.costs[1:]))
    assert bundle.cost(obs, fit.cam, fit.pt).first().cost == pytest.approx(fit.costs[-1], rel=1e-9)


@pytest.mark.parametrize(("chunk", "sent", "scaled"), [(10_000, 100_000, True), (2, 0, False)])
def test_products_and_steps_match_the_dense_system(spark, monkeypatch, chunk, sent, scaled):
    """Landmarks in chunks, cameras too many to send, with and without a scale: the same as the matrix."""
    from latticework.functions import kernels as k
    from latticework.plans import reduced

    monkeypatch.setattr(reduced, "CHUNK", chunk)
    monkeypatch.setattr(reduced, "MOST_SENT", sent)
    cam, pt, ci, pi, xy = scene(3, 40, 3, 0.5)
    ci, pi, xy = np.append(ci, ci[0]), np.append(pi, pi[0]), np.concatenate([xy, xy[:1] + 1])  # a pair that is seen twice
    obs, c, p = tables(spark, cam, pt, ci, pi, xy)
    rows, split = reduced.chunked(obs)
    assert split == (chunk == 2)
    system = reduced.Reduced.of(rows.join(c, "cam_id").join(p, "pt_id"), split, 0.1, scaled)
    r, jc, jl = k.residuals(cam[ci], pt[pi], xy, True)
    n = k.Normal.of(r, jc, jl, ci, pi, 3, 40)
    u, v = n.u + 0.1 * n.u * np.eye(9), n.v + 0.1 * n.v * np.eye(3) + 1e-9 * k.block_largest(n.v)
    vi = k.block_inverse(v)
    dense = n.schur(vi, u)
    x = np.random.default_rng(0).normal(size=(3, 9))
    got = {r.cam_id: np.array(r.q) for r in system.product(spark.createDataFrame([(i, x[i].tolist()) for i in range(3)], "cam_id long, x array<double>")).collect()}
    want = (dense @ x.ravel()).reshape(3, 9)
    assert np.allclose(np.stack([got[i] for i in range(3)]), want, rtol=1e-7, atol=1e-9 * np.abs(want).max())
    if not scaled:
        return
    dp, dq, slope, bend = system.steps(system.solve(40, 1e-9))
    step = np.linalg.solve(dense, -(n.bp - n.w_times(np.einsum("pij,pj->pi", vi, n.bl))).ravel()).reshape(3, 9)
    found = {r.cam_id: r.dp for r in dp.collect()}
    assert np.allclose([found[i] for i in range(3)], step, rtol=1e-4, atol=1e-6 * np.abs(step).max())
    back = -np.einsum("pij,pj->pi", vi, n.bl + n.wt_times(step))
    land = {r.pt_id: r.dq for r in dq.collect()}
    assert np.allclose([land[i] for i in range(40)], back, rtol=1e-4, atol=1e-6)
    model = r + np.einsum("nki,ni->nk", jc, step[ci]) + np.einsum("nki,ni->nk", jl, back[pi])
    assert system.cost + slope + bend == pytest.approx((model * model).sum(), rel=1e-5)
    moved = rows.join(c, "cam_id").join(p, "pt_id").join(dp, "cam_id").join(dq, "pt_id")
    at = reduced.costs_along(moved, (0.0, 0.5, 1.0))
    for a, cost in zip((0.0, 0.5, 1.0), at):
        assert cost == pytest.approx(np.square(k.residuals(cam[ci] + a * step[ci], pt[pi] + a * back[pi], xy)).sum(), rel=1e-5)
    system.released()


def test_extrapolation_of_rows(spark):
    rng = np.random.default_rng(5)
    from latticework.plans import acceleration as acc

    g, f = rng.normal(size=(3, 6, 2)), rng.normal(size=(3, 6, 2))
    moves = [spark.createDataFrame([(i, g[k, i].tolist(), f[k, i].tolist()) for i in range(6)], "id long, g array<double>, f array<double>") for k in range(3)]
    got = {r.id: r.s for r in acc.extrapolated(moves, ["id"], 2).collect()}
    flat = f.reshape(3, -1)
    want = np.einsum("k,kij->ij", acc.regular_weights(flat @ flat.T, 2, 0.1), g)
    assert np.allclose([got[i] for i in range(6)], want)


def test_alternation_never_rises(spark, problem):
    (obs, cam, pt), best, before = problem
    placed = obs.join(relational.range_parts(obs.select("cam_id"), "cam_id", 2), "cam_id")
    owner = graph.complete_landmarks(placed).select("pt_id", "part")
    fit = bundle.palm_fit(obs, cam, pt, placed.select("cam_id", "part").distinct(), owner, rounds=4)
    assert all(b <= a for a, b in zip(fit.costs, fit.costs[1:])) and fit.costs[-1] < 0.5 * before


def test_partitioner_cuts_at_the_bridge():
    seen = {c: np.arange(100) + (100 if c >= 4 else 0) for c in range(8)}
    seen = {c: np.sort(np.random.default_rng(c).choice(v, 60, replace=False)) for c, v in seen.items()}
    for c in (0, 4):
        seen[c] = np.union1d(seen[c], [200, 201, 202, 203, 204])
    edges = [(a, b, len(np.intersect1d(seen[a], seen[b]))) for a in range(8) for b in range(a + 1, 8)]
    found = partition.agglomerate([e for e in edges if e[2]], seen, 2)
    assert [found[c] for c in range(8)] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert found == partition.agglomerate([e for e in edges if e[2]], seen, 2)


def test_growth_and_random_merges_cover_all():
    seen = {c: np.arange(30) + 25 * c for c in range(12)}
    edges = [(c, c + 1, 5) for c in range(11)]
    for found in (partition.grow_parts(seen, 3), partition.agglomerate(edges, seen, 3, merges=3, seed=1)):
        assert set(found) == set(seen) and 3 <= len(set(found.values())) <= 4
    assert partition.agglomerate(edges, seen, 3, merges=3, seed=1) == partition.agglomerate(edges, seen, 3, merges=3, seed=1)
    first = partition.random_merges(edges, seen, 3, 1, 0, {(4, 5)})
    assert first[5] == 4


def test_completion_and_moves():
    counts = {0: {0: 2}, 1: {0: 1, 1: 3}, 2: {0: 2, 1: 2}}
    assert partition.complete_in_order(counts, {0: 5, 1: 5}) == {0: 0, 1: 1, 2: 0}
    by_camera = {0: {7: 1, 8: 1}, 1: {7: 1}, 2: {7: 1}, 3: {8: 1}}
    owner = {0: 1, 1: 0, 2: 0, 3: 1}
    moved = partition.recluster(by_camera, owner, most=2)
    assert set(moved) == set(owner)


def test_moves_grow_the_limit():
    counts = {lm: {0: 1} for lm in range(38)} | {100 + lm: {1: 1} for lm in range(40)}
    owner = {lm: int(lm >= 8) for lm in range(38)} | {100 + lm: lm % 2 for lm in range(40)}  # camera 0: 8 and 30, camera 1: 20 and 20
    moved = partition.recluster(counts, owner)
    assert {moved[lm] for lm in range(38)} == {1}
    assert len({moved[100 + lm] for lm in range(40)}) == 1
    assert partition.recluster({0: {0: 3}, 1: {1: 9}}, {0: 0, 1: 1}) == {0: 0, 1: 1}  # all in one part: not weak


def test_moves_go_on_until_none_is_left():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        counts = {lm: {int(c): 1 for c in rng.choice(30, 3, replace=False)} for lm in range(150)}
        owner = {lm: int(rng.integers(0, 5)) for lm in counts}
        moved = partition.recluster(counts, owner, limit=5)
        assert moved == partition.recluster(counts, moved, limit=5)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_registered_moves_relieve_cameras(spark, sf):
    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    placed = catalogue.observed_parts(spark, d)
    owner = graph.complete_landmarks(placed).select("pt_id", "part")
    moved = numeric.recluster(spark, d)
    weak = lambda o: placed.drop("part").join(o, "pt_id").groupBy("part", "cam_id").count().where("count <= 100").count()
    assert moved.count() == owner.count() and moved.join(owner.withColumnRenamed("part", "old"), "pt_id").where("part <> old").count() > 0
    assert weak(moved) <= weak(owner) > 0
    sizes = [r["count"] for r in moved.groupBy("part").count().collect()]
    assert len(sizes) == 4 and min(sizes) >= owner.count() // 40  # no part is emptied


def test_roots_and_empty(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5)], "src long, dst long")
    assert sorted(map(tuple, partition.roots(e).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
    assert partition.roots(e.limit(0)).count() == 0


def test_roots_of_all_orders(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.integers(1, 900)), float(rng.integers(800, 4000)) + 0.75) for k in range(1, 1200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, a, b in rows:
        if a != int(b):
            low, high = sorted((find(a), find(int(b))))
            parent[high] = low
    got = dict(map(tuple, catalogue.connected_roots(spark, str(tmp_path)).collect()))
    assert got == {x: find(x) for x in parent} and len(got) > 1000 and max(got) > 500


def test_coverage_raises(spark):
    placed = spark.createDataFrame([(1, 0)], "pt_id long, part int")
    ids = spark.createDataFrame([(1,), (2,)], "pt_id long")
    with pytest.raises(ValueError):
        graph.check_coverage(placed, ids, "pt_id")


def test_duplicate_pairs_all_move(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0)], "cam_id long, pt_id long, part int")
    moves = spark.createDataFrame([(1, 1, 3)], "cam_id long, pt_id long, part int")
    assert sorted(r.part for r in relational.update_parts(rows, moves).collect()) == [0, 3, 3]


def test_scatter_overwrites_with_nulls_too(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "k long, o string, v int")
    new = spark.createDataFrame([(2, None), (4, 1), (None, 8)], "k long, v int")
    assert sorted(map(tuple, relational.scatter(old, new, "k", ["v"]).collect()), key=str) == [(1, "a", 5), (2, "b", None), (None, "c", 7)]


def test_dense_numbers_of_far_ids_and_within_parts(spark, monkeypatch):
    ids = [-(2**63), -5, 0, 1, 2, 2**62, 2**63 - 1]
    got = relational.dense_index(spark.createDataFrame([(i,) for i in [*ids, 0, None]], "a long"), "a", "n").collect()
    assert sorted((r.n, r.a) for r in got) == list(enumerate(ids))
    monkeypatch.setattr(relational, "RUN", 7)
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)), int(rng.integers(0, 60)) ** 3) for _ in range(200)]
    got = relational.local_reindex(spark.createDataFrame([*rows, (1, None), (None, 8)], "p int, a long"), "p", "a", "n").collect()
    want = {(p, a): n for q in range(3) for n, (p, a) in enumerate(sorted({r for r in rows if r[0] == q}))}
    assert {(r.p, r.a): r.n for r in got} == want and len(got) == len(want)


def blocks_with_bridge():
    seen = {c: np.arange(100) + (100 if c >= 4 else 0) for c in range(8)}
    seen = {c: np.sort(np.random.default_rng(c).choice(v, 60, replace=False)) for c, v in seen.items()}
    for c in (0, 4):
        seen[c] = np.union1d(seen[c], [200, 201, 202, 203, 204])
    return seen


def test_rounds_of_merges_cut_at_the_bridge(spark):
    seen = blocks_with_bridge()
    pairs = spark.createDataFrame([(c + 10, int(p)) for c, v in seen.items() for p in v] + [(10, 0), (10, int(seen[0][0])), (None, 3)], "cam_id long, pt_id long")
    got = {r.cam_id: r.part for r in merging.merged_cameras(pairs, 2).collect()}
    assert [got[c + 10] for c in range(8)] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert merging.merged_cameras(pairs.limit(0), 2).count() == 0


def test_rounds_merge_many_pairs_of_a_dense_graph(spark):
    """All cameras see most landmarks and one sees all, which all others find best: rounds still merge several pairs, the first few while slack grows."""
    rng = np.random.default_rng(4)
    rows = [(c, p) for c in range(32) for p in range(80) if c == 0 or rng.random() < 0.6]
    pairs = spark.createDataFrame(rows, "cam_id long, pt_id long")
    got = {r.cam_id: r.part for r in merging.merged_cameras(pairs, 4, rounds=4).collect()}
    assert set(got) == set(range(32)) and 4 <= len(set(got.values())) <= 20
    assert max(list(got.values()).count(k) for k in set(got.values())) <= 2 * 32 // 4


def test_merges_keep_within_limits(spark):
    """A chain of cameras: sizes and unions stay within the limits, all cameras have a part, cameras without edges too."""
    rows = [(c, p) for c in range(7) for p in range(25 * c, 25 * c + 30)] + [(50, 9999)]
    got = {r.cam_id: r.part for r in merging.merged_cameras(spark.createDataFrame(rows, "cam_id long, pt_id long"), 3, 1.2).collect()}
    assert set(got) == {*range(7), 50} and len(set(got.values())) >= 3
    landmarks = len({p for _, p in rows})
    for part in set(got.values()):
        mine = [c for c in got if got[c] == part]
        assert len(mine) <= 2 * 8 // 3 and len({p for c, p in rows if got[c] == part}) <= 1.2 * landmarks / 3


def test_moves_gain_and_empty_no_part(spark):
    rng = np.random.default_rng(3)
    counts = {(int(p), int(c)): int(rng.integers(1, 3)) for p in range(60) for c in rng.choice(12, 3, replace=False)}
    owner = {p: int(rng.integers(0, 3)) for p in range(60)}
    frames = spark.createDataFrame([(p, c, n) for (p, c), n in counts.items()], "pt_id long, cam_id long, n long"), spark.createDataFrame(sorted(owner.items()), "pt_id long, part int")
    most = 6

    def cells(where):
        out = {}
        for (p, c), n in counts.items():
            out[where[p], c] = out.get((where[p], c), 0) + n
        return out

    before, gained = owner, 0.0
    for rounds in (1, 2):
        found, gains = merging.relieved(*frames, most=most, rounds=rounds, limit=most)
        after = {r.pt_id: r.part for r in found.collect()}
        assert set(after) == set(owner) and all(x > 0 for x in gains)
        assert min(list(after.values()).count(k) for k in range(3)) >= min(2, *(list(owner.values()).count(k) for k in range(3)))
        if rounds == 1:
            a, b = cells(before), cells(after)
            real = sum(partition.move_gain(a.get(k, 0), b.get(k, 0), most, 5.0) for k in {*a, *b})
            assert real >= sum(gains) - 1e-9 and after != before
        assert sum(gains) >= gained
        gained = sum(gains)


def test_pairs_of_a_hot_landmark_spread(spark, monkeypatch):
    """One landmark seen by very many cameras: the same pairs, made under many keys."""
    monkeypatch.setattr(graph, "BLOCK", 50)
    seen = {1: range(400), 2: range(390, 410), 3: (5, 7), 4: (9,)}
    edges = graph.covisible(spark.createDataFrame([(c, p) for p, cs in seen.items() for c in cs], "cam_id long, pt_id long"))
    want = {}
    for cs in seen.values():
        for x in cs:
            for y in cs:
                if x < y:
                    want[x, y] = want.get((x, y), 0) + 1
    assert {(r.src, r.dst): r.w for r in edges.collect()} == want
    assert edges.count() == len(want)


def test_places_within_parts(spark):
    rng = np.random.default_rng(2)
    rows = [(None if k % 50 == 0 else int(k % 3 == 0), int(rng.integers(0, 40)), int(rng.integers(0, 9))) for k in range(900)]
    frame = spark.createDataFrame(rows, "part int, a long, b long").repartition(5)
    got = {}
    for r in relational.places_within(frame, "part", ["a", "b"], "place").collect():
        got.setdefault(r.part, []).append((r.place, r.a, r.b))
    for part, found in got.items():
        mine = sorted((a, b) for p, a, b in rows if p == part)
        assert [(a, b) for _, a, b in sorted(found)] == mine and sorted(x for x, *_ in found) == list(range(1, len(mine) + 1))
    assert len(got) == 3 and relational.places_within(frame.limit(0), "part", ["a"], "place").count() == 0


def test_sums_of_keys_pass_on_what_is_held(spark, monkeypatch):
    """Few keys held at once: sums over batches and tasks are those of the whole."""
    from latticework.functions import kernels as k

    monkeypatch.setattr(catalogue, "HELD", 6)
    cam, pt, ci, pi, xy = scene(5, 40, 3, 0.5)
    obs, c, p = tables(spark, cam, pt, ci, pi, xy)
    rows = obs.join(c, "cam_id").join(p, "pt_id").repartition(3)
    _, _, jl = k.residuals(cam[ci], pt[pi], xy, True)
    want = np.zeros((40, 9))
    np.add.at(want, pi, np.einsum("nka,nkb->nab", jl, jl).reshape(-1, 9))
    sums = catalogue._key_sums(rows, "pt_id", lambda r, jc, jl: np.einsum("nka,nkb->nab", jl, jl).reshape(-1, 9))
    got = {}
    for r in sums.collect():
        got[r.pt_id] = got.get(r.pt_id, 0) + np.array(r.m)
    assert sorted(got) == list(range(40)) and np.allclose(np.stack([got[i] for i in range(40)]), want, rtol=1e-9)


@pytest.mark.parametrize("pulled", [False, True])
def test_parts_fit_together_as_each_in_a_task(spark, monkeypatch, pulled):
    """One step of two parts that no task holds whole: costs and parameters of the fits in tasks, with pulls and with frozen cameras."""
    from latticework.plans import together

    cam, pt, ci, pi, xy = scene(6, 20, 6, 0.5)
    obs, c, p = tables(spark, *shaken(cam, pt, size=0.01), ci, pi, xy)
    rows = obs.selectExpr("cast(cam_id div 3 as long) as part", "cam_id", "100 * (cam_id div 3) + pt_id as pt_id", "x", "y")
    c, p = c.selectExpr("cam_id", "cast(cam_id div 3 as long) as part", "p", "p as still_p"), rows.selectExpr("pt_id as id", "part").distinct().selectExpr("id", "part", "id % 100 as pt_id").join(p, "pt_id").selectExpr("id as pt_id", "part", "q", "q as still_q")
    pull = p.selectExpr("pt_id", "array(1e3, 0, 0, 0, 1e3, 0, 0, 0, 1e3) as r", "transform(q, x -> x + 1e-2) as s") if pulled else None
    if not pulled:
        rows = rows.selectExpr("*", "cam_id % 3 > 0 as fc", "true as fl")
    else:
        c, p = c.drop("still_p"), p.drop("still_q")
    found = []
    for most in (0, 1000):
        monkeypatch.setattr(together, "IN_TASK", most)
        held, *how = together.dealt(rows)
        assert how[1] == (most > 0)
        a, b, costs, damping = together.fit_parts(held, *how, c, p, 1, None, pull, eps=1e-8)
        found.append((costs, np.array([r.p for r in a.orderBy("cam_id").collect()]), np.array([r.q for r in b.orderBy("pt_id").collect()])))
    (one, a, b), (two, x, y) = found
    print(one, two, np.abs(b - y).max())
    assert {k: v[0] for k, v in one.items()} == pytest.approx({k: v[0] for k, v in two.items()}, rel=1e-9)
    assert all(abs(v[1] - two[k][1]) < 1e-3 * v[0] and v[1] < v[0] for k, v in one.items())
    assert not pulled or np.abs(b - y).max() < 1e-3


def test_weights_without_edges_and_counts_in_more_tasks(spark, monkeypatch):
    """Weights from landmarks alone are those of the edges; edges are counted in more tasks where more cameras meet."""
    rng = np.random.default_rng(3)
    pairs = spark.createDataFrame([*{(int(c), int(q)) for c, q in zip(rng.integers(0, 12, 150), rng.integers(0, 30, 150), strict=True)}, (99, 77)], "cam_id long, pt_id long")
    few = graph.covisible(pairs)
    want = {tuple(r) for r in few.collect()}
    assert {tuple(r) for r in graph.pair_weights(pairs).collect()} == {tuple(r) for r in graph.vertex_weights(few).collect()}
    monkeypatch.setattr(graph, "MEETINGS", 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = graph.covisible(pairs)
        assert many.rdd.getNumPartitions() > 20 and {tuple(r) for r in many.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_observations_are_dealt_to_more_tasks_where_there_are_more(spark, sf, monkeypatch):
    """Pairs are joined in tasks of a bounded number of observations, and what depends on ids alone is worked out once for each pair."""
    monkeypatch.setattr(catalogue, "DEALT", 100)
    assert catalogue.tasks(spark, sf) > 50
    pairs = catalogue.gathered_pairs(spark, sf)
    assert pairs.count() == pairs.select("cam_id", "pt_id").distinct().count() and pairs.agg({"seen": "sum"}).first()[0] == catalogue.gathered(spark, sf).count()


def test_solvers_over_blocks_leave_what_they_leave_in_one_task(spark):
    """No part is held in a task: landmarks are, in blocks, and all solvers come from the directions of one run of products."""
    from latticework.functions import kernels as k
    from latticework.plans import inner

    cam, pt, ci, pi, xy = scene(6, 60, 4, 0.3, 5)
    cam, pt = shaken(cam, pt)
    obs, c, p = tables(spark, cam, pt, ci, pi, xy)
    parts = spark.createDataFrame([(i, i // 3) for i in range(6)], "cam_id long, part int")
    rows = obs.join(parts, "cam_id").join(c, "cam_id").join(p, "pt_id").repartition(3, "pt_id")
    names = [n for n in k.SOLVERS if n != "direct"]
    assert inner.blocks(rows).count() == len({(a // 3, b) for a, b in zip(ci, pi)})
    got = {(r.part, r.solver): r.gap for r in inner.gaps(rows, parts, names).collect()}
    assert len(got) == 2 * len(names)
    for part in (0, 1):
        at = ci // 3 == part
        lc, lp = (np.unique(x[at], return_inverse=True)[1] for x in (ci, pi))
        r, jc, jl = k.residuals(cam[ci[at]], pt[pi[at]], xy[at], True)
        n = k.Normal.of(r, jc, jl, lc, lp, lc.max() + 1, lp.max() + 1)
        u, v = n.u + 0.5 * n.u * np.eye(9) + 1e-3 * np.eye(9), n.v + 0.5 * n.v * np.eye(3) + 1e-3 * np.eye(3)
        ui, vi = k.block_inverse(u), k.block_inverse(v)
        b = -(n.bp - n.w_times(np.einsum("pij,pj->pi", vi, n.bl)))
        for name in names:
            x = k.SOLVERS[name](n, ui, vi, u, b)
            gap = np.linalg.norm(np.einsum("cij,cj->ci", u, x) - n.w_times(np.einsum("pij,pj->pi", vi, n.wt_times(x))) - b) / np.linalg.norm(b)
            assert got[part, name] == pytest.approx(gap, rel=0.3, abs=1e-10), name


def test_sums_are_dealt_by_their_key_in_tasks_of_bounded_size(spark, monkeypatch):
    """Tasks grow in number with the lines, joins do not undo that, and a camera's sums come from few tasks however many there are."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(catalogue, "DEALT", 200)
    n = catalogue.tasks(spark, sf)
    assert n > 20 and catalogue.gathered(spark, sf).rdd.getNumPartitions() == n
    counted = []
    real = catalogue._key_sums
    monkeypatch.setattr(catalogue, "_key_sums", lambda *a: counted.append(real(*a)) or counted[-1])
    for run in (catalogue.block_gram, catalogue.block_gradient, catalogue.landmark_gram, numeric.block_eigen):
        run(spark, sf)
        rows = counted[-1]
        assert rows.count() <= catalogue.SHARES * rows.select(rows.columns[0]).distinct().count()


@pytest.mark.parametrize("sent", [True, False])
def test_marks_are_counted_and_renamed_where_they_are(spark, sent):
    """A landmark's parts in one row: landmarks shared by the parts of a pair, and parts after merges."""
    rng = np.random.default_rng(4)
    seen = {p: sorted({int(x) for x in rng.integers(0, 9, rng.integers(1, 9))}) for p in range(40)}
    marks = spark.createDataFrame(list(seen.items()), "pt_id long, roots array<long>")
    ends = spark.createDataFrame([(0, 0), (0, 5), (2, 2), (2, 7), (3, 3), (3, 100)], "pair long, root long")
    want = {a: sum(a in v and b in v for v in seen.values()) for a, b in ((0, 5), (2, 7))}
    assert {r.src: r.shared for r in merging.shared_landmarks(marks, ends, sent).collect()} == {k: n for k, n in want.items() if n}
    goes = spark.createDataFrame([(5, 0), (7, 2)], "root long, to long")
    got = {r.pt_id: sorted(r.roots) for r in merging.relabelled(marks, goes, sent).collect()}
    assert got == {p: sorted({{5: 0, 7: 2}.get(x, x) for x in v}) for p, v in seen.items()}
