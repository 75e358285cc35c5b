import bz2

import numpy as np

from latticework.plans import pose
from latticework.sources import bal
from tests.scenes import scene


def test_round_trip_and_far_points(spark, tmp_path):
    cam, pt, ci, pi, xy = scene(3, 12, 3)
    pt[4] *= 5000
    lines = [f"3 12 {len(ci)}", *(f"{a} {b} {x:.17g} {y:.17g}" for a, b, (x, y) in zip(ci, pi, xy)), *(f"{v:.17g}" for v in cam.ravel()), *(f"{v:.17g}" for v in pt.ravel())]
    path = str(tmp_path / "scene.txt.bz2")
    with bz2.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")
    whole = bal.read(spark, path, None)
    assert [tuple(r.p) for r in whole.cam.orderBy("cam_id").collect()] == [tuple(v) for v in cam]
    near = bal.read(spark, path)
    assert near.pt.count() == 11 and near.obs.count() == len(ci) - 3
    assert sorted(r.pt_id for r in near.pt.collect()) == list(range(11))
    out = str(tmp_path / "out")
    bal.write(near, out)
    back = bal.read(spark, out)
    key = lambda r: tuple(map(str, r))
    for name in ("obs", "cam", "pt"):
        a, b = (getattr(x, name).drop("res_id").collect() for x in (back, near))
        assert sorted(a, key=key) == sorted(b, key=key)
    bal.save(near, str(tmp_path / "saved"))
    assert bal.load(spark, str(tmp_path / "saved")).obs.count() == near.obs.count()
    placed = near.obs.selectExpr("*", "cast(cam_id % 2 as int) as part")
    bal.save_parts(placed, str(tmp_path / "parts"))
    again = bal.load_parts(spark, str(tmp_path / "parts")).select(*placed.columns)
    assert again.exceptAll(placed).count() == 0 and again.count() == placed.count()
    cam.tofile(tmp_path / "cam.bin")
    assert np.allclose([r.p for r in bal.from_dump(spark, str(tmp_path / "cam.bin"), 9, "cam_id", "p").orderBy("cam_id").collect()], cam)


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    want = [f"line {k} " + "x" * (k * 37 % 91) for k in range(900)]
    for i, (a, b) in enumerate(((0, 50), (50, 52), (52, 900))):
        (tmp_path / "t" / f"part-{i:05d}").write_text("".join(f"{x}\n" for x in want[a:b]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = bal.numbered_lines(spark, str(tmp_path / "t"))
        assert lines.rdd.getNumPartitions() > 1
        got = {r["at"]: r["line"] for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(want))


def test_pose_spread_matches_precision(spark):
    rows = pose.monte_carlo(spark, trials=60).where("view = 3").toPandas()
    got = np.cov(rows[["w0", "w1", "w2"]].to_numpy().T)
    want = pose.NOISE**2 * np.linalg.inv(pose.precision(pose.camera(pose.VIEWS[3])))[:3, :3]
    assert np.all(np.abs(np.log(np.diag(got) / np.diag(want))) < np.log(2.5))
