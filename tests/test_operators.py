"""Hand-computed rows, edge rows, and the machines in batch and on a stream against plain loops."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import scalar as S
from gridloom.operators import fusion, grids, joins, losses, mesh, rows, series, visibility, voxel
from gridloom.sources import store
from gridloom.streaming import machines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_angles_wrap(spark):
    assert one(spark, S.angle_difference(F.lit(179.0), F.lit(-179.0))) == 2.0
    assert one(spark, S.angle_difference(F.lit(0.0), F.lit(180.0))) == 180.0


def test_direction_limits(spark):
    assert one(spark, S.direction(F.lit(0.0), F.lit(1.0))) is None
    assert one(spark, S.direction(F.lit(1.0), F.lit(0.5))) == "right"
    assert one(spark, S.direction(F.lit(1.0), F.lit(-0.5))) == "left"


def test_boxes(spark):
    box = lambda x, y, ex, ey, w: tuple(F.lit(float(v)) for v in (x, y, ex, ey, w))
    assert one(spark, G.box_distance(box(0, 0, 1, 1, 0), box(4, 0, 1, 1, 0))) == 2.0
    assert one(spark, G.box_distance(box(0, 0, 2, 2, 0), box(0, 0, 1, 1, 0))) == -2.0  # containing
    assert one(spark, G.box_distance(box(0, 0, 1, 1, 0), box(2, 0, 1, 1, 0))) == 0.0  # touching


def test_ray_along_a_face(spark):
    ray = lambda o: G.slab(tuple(map(F.lit, o)), (F.lit(1.0), F.lit(0.0), F.lit(0.0)), (F.lit(1.0),) * 3)[2]
    assert one(spark, ray((-5.0, 0.0, 0.0))) and not one(spark, ray((-5.0, 1.5, 0.0))) and not one(spark, ray((5.0, 0.0, 0.0)))


def test_voxel_tie_and_negative_cells(spark):
    df = spark.createDataFrame([(-0.1, "b"), (-0.2, "a"), (0.5, "c")], "x double, tag string")
    got = {r.c: r for r in voxel.aggregate(df, {"c": (F.col("x"), 1.0)}, "tag").collect()}
    assert got[-1].majority == "a" and got[-1].n_points == 2 and got[0].majority == "c"


def test_asof_edges(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 1), (1, 10.0, 10.0, 2), (1, 10.0, 20.0, 3)], "k int, t double, v double, id int")
    asks = spark.createDataFrame([(1, -1.0), (1, 5.0), (1, 10.0), (1, 11.0)], "k int, at double")
    assert {r["at"]: r.v for r in joins.asof_lerp(s, asks, "k", "t", "at", "v", "id").collect()} == {-1.0: None, 5.0: 5.0, 10.0: 20.0, 11.0: None}


def test_mesh(spark):
    tetra = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 3, 1), (2, 1, 3, 2), (3, 2, 3, 0)], "face int, a int, b int, c int")
    assert mesh.topology(tetra).first().closed
    assert mesh.topology(tetra.where("face > 0")).first().boundary == 3
    assert mesh.clean(tetra.union(spark.createDataFrame([(9, 2, 1, 0), (8, 1, 1, 2)], tetra.schema))).count() == 4


def test_batches_pool_tails(spark):
    df = spark.createDataFrame([(k, i) for k, n in ((1, 5), (2, 3), (3, 4)) for i in range(n)], "k int, i int")
    got = series.batches(df, "k", ["i"], 4, False).where("pooled").orderBy("batch", "slot").collect()
    assert [(r.k, r.i) for r in got] == [(1, 4), (2, 0), (2, 1), (2, 2)]


def test_frame_index_of_no_frames(spark):
    df = spark.createDataFrame([("a", 0), ("b", 2), ("c", None)], "s string, n int")
    assert [tuple(r) for r in store.frame_index(df, "s", "n").orderBy("frame").collect()] == [("b", 0), ("b", 1)]


def test_resume(spark):
    work = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, fingerprint string")
    seen = spark.createDataFrame([("a", "1", "done"), ("b", "9", "done"), ("c", "3", "failed")], "k string, fingerprint string, status string")
    assert sorted(r.k for r in store.unfinished(work, seen, "k").collect()) == ["b", "c"]


def steps(machine, rows):
    s = dict(machine.init)
    return [machine.step(s, *r) for r in rows]


def test_recovery_deadline_and_second_hit():
    m = machines.recovery(clear=2, window=4, progress=0.0, deviation=30.0)
    total, got = 0, []
    rows = []
    for hit in [0, 1, 0, 1, 0, 0, 1, 1, 1, 1, 1, 0]:
        total += hit
        rows.append((total, 0.0, 0.0, False, 9.0, False))
    got = [r and r[0] for r in steps(m, rows)]
    assert got == ["running", "recovering", "recovering", "recovering", "recovering", "running", "recovering", "recovering", "recovering", "recovering", "collision_unrecovered", None]


def test_recovery_needs_progress_and_the_route():
    m = machines.recovery(clear=1, window=9, progress=5.0, deviation=3.0, still=1.0, stuck=2)
    rows = [(1, 0.0, 0.0, False, 9.0, False), (1, 4.0, 0.0, False, 9.0, False), (1, 6.0, 4.0, False, 9.0, False), (1, 6.0, 2.0, False, 9.0, False)]
    assert [r[0] for r in steps(m, rows)] == ["recovering"] * 3 + ["running"]
    stalled = [(0, 0.0, 0.0, False, 0.0, True), (0, 0.0, 0.0, False, 0.0, False), (0, 0.0, 0.0, False, 0.0, False), (0, 0.0, 0.0, True, 0.0, False)]
    assert steps(m, stalled) == [("running", 0), ("running", 1), ("unjustified_stall", 2), None]


def test_segmenter_bounds():
    sizes = [(8,), (8,), (1,), (17,), (9,)]
    assert steps(machines.segmenter(16, keep=False), sizes) == [(0, 8, True), (0, 16, True), (1, 0, False), (1, 0, False), (1, 16, True)]
    assert steps(machines.segmenter(16, keep=True), sizes) == [(0, 8, True), (0, 16, True), (1, 8, True), (1, 8, False), (2, 16, True)]


def test_pid_law():
    got = steps(machines.pid(1.0, 0.5, 0.1, 2.0, 0.5, dt=0.1, deadband=0.3, throttle=10.0, brake=1.0), [(5.0, 4.0, 1.0), (5.0, 4.5, 1.0), (0.0, 2.0, -9.0)])
    assert [round(x, 6) for x in got[0]] == [1.0 + 0.5 * 0.1 + 1.0, 0.0, 0.5]  # the error before the first is 0
    assert [round(x, 6) for x in got[1]] == [round(0.5 + 0.5 * 0.15 - 0.1 * 5, 6), 0.0, 0.75]
    assert got[2][:2] == (0.0, 1.0) and got[2][2] == -0.125  # forced brake


def test_navigator_never_goes_back():
    m = machines.navigator([(10.0 * k, 0.0) for k in range(6)], 3, target=15.0, done=2.0)
    got = steps(m, [(12.0, 1.0, 0.0), (0.0, 0.0, 90.0), (49.0, 0.0, 0.0), (49.0, 0.0, 0.0)])
    assert [g[0] for g in got] == [1, 1, 3, 5] and [g[5] for g in got] == [False, False, True, True]
    assert got[0][3:5] == (18.0, -1.0) and got[3][2] == 1.0 and abs(got[1][4] + 30.0) < 1e-9


def test_drive_walker_and_queue():
    assert steps(machines.drive(2), [("collision",), ("partial",), ("collision",), ("done",)]) == [(0, 1, "retry"), (1, 1, "going"), (1, 1, "cut"), None]
    assert [r[0] for r in steps(machines.walker(2.0), [(0, 0, 5, 0), (3, 0, 9, 9), (4, 0, 9, 9)])] == [True, False, True]  # at exactly the radius it goes on
    assert steps(machines.waypoint_queue([(1.0, 0.0), (2.0, 0.0), (30.0, 0.0)], 3.0, 0.0), [(0.0, 0.0, 0.0), (29.5, 0.0, 0.0)]) == [(2, 1), (3, 0)]


def test_fold_of_empty_and_unordered_rows(spark):
    m = machines.segmenter(16, True)
    df = spark.createDataFrame([("b", 2, 8), ("a", 1, 8), ("a", 0, 16), ("b", 1, 8), (None, 0, 8)], "k string, t int, size int")
    assert sorted(map(tuple, machines.fold(df, "k", ["t"], m).collect()), key=str) == sorted([("a", 0, 0, 16, True), ("a", 1, 1, 8, True), ("b", 1, 0, 8, True), ("b", 2, 0, 16, True), (None, 0, 0, 8, True)], key=str)
    assert machines.fold(df.limit(0), "k", ["t"], m).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    total = {1: 0, 2: 0}
    data = []
    for t in range(40):
        for k in (1, 2):
            total[k] += rng.random() < 0.2
            data.append((k, float(t), total[k], float(t), rng.random() * 20, False, 5.0, False))
    data = pd.DataFrame(data, columns=["key", "t", "total", "place", "off", "reached", "speed", "justified"])
    m = machines.recovery()
    batch = machines.fold(spark.createDataFrame(data), "key", ["t"], m)
    for i in range(4):
        spark.createDataFrame(data[(data.t >= 10 * i) & (data.t < 10 * i + 10)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("key long, t double, total long, place double, off double, reached boolean, speed double, justified boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = machines.fold_stream(source, "key", ["t"], m, expire="3600000")
    q = out.writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, batch.collect())) and batch.count() > 40


def test_similar_routes_go_as_one_by_one(spark):
    """Against the loop over the order."""
    rng = random.Random(5)
    routes = [(i, rng.random(), *(rng.uniform(0, 40) for _ in range(4))) for i in range(150)] + [(900, 0.5, 1.0, 1.0, 1.0, 1.0), (901, 0.5, 1.0, 1.0, 1.0, 1.0)]
    done = [(20.0, 20.0, 20.0, 20.0)]
    near = lambda a, b: math.dist(a[:2], b[:2]) <= 8 and math.dist(a[2:], b[2:]) <= 8
    kept = []
    for r in sorted(routes, key=lambda r: (r[1], r[0])):
        if not any(near(r[2:], k) for k in done) and not any(near(r[2:], k[2:]) for k in kept):
            kept.append(r)
    df = spark.createDataFrame(routes, "r int, o double, sx double, sy double, ex double, ey double")
    old = spark.createDataFrame(done, "sx double, sy double, ex double, ey double")
    got = fusion.drop_similar(df, "r", "o", ["sx", "sy", "ex", "ey"], 8.0, old).collect()
    assert sorted(r.r for r in got) == sorted(r[0] for r in kept) and len(kept) < 140


def test_shortest_paths_of_a_loop(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 1, 0.0), (4, 1, 1.0)], "a int, b int, cost double")
    got = fusion.shortest_paths(e, spark.createDataFrame([(1,)], "node int"), 10).collect()
    assert {(r.node, r.cost, r.hops) for r in got} == {(1, 0.0, 0), (2, 1.0, 1), (3, 2.0, 2)}


def test_points_and_boxes(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0), (2, 0, 50.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0), (3, 1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0)], "box_id int, frame int, x double, y double, z double, ex double, ey double, ez double, yaw double")
    points = spark.createDataFrame([(0, 1.0, 1.0, 1.0, None), (0, 9.0, 9.0, 9.0, 2), (1, 1.1, 0.0, 0.0, None)], "frame int, x double, y double, z double, hit int")
    seen = lambda b, p: {r.box_id: r.visible for r in visibility.seen_by_points(b, p, 4.0).collect()}
    assert seen(boxes, points) == {1: True, 2: True, 3: False} and seen(boxes, points.limit(0)) == {1: False, 2: False, 3: False} and seen(boxes.limit(0), points) == {}


def test_losses_by_hand(spark):
    df = spark.createDataFrame([(0.0, 1.0, 1.0), (2.0, 0.0, 1.0), (9.0, 0.0, 0.0)], "x double, t double, m double")
    r = df.agg(losses.masked_mean(losses.bce(F.col("x"), F.col("t")), F.col("m")).alias("a"), losses.balanced_bce(F.col("x"), F.col("t"), F.col("m")).alias("b")).first()
    pos, neg = math.log(2), 2 + math.log1p(math.exp(-2))
    assert abs(r.a - (pos + neg) / 2) < 1e-12 and abs(r.b - (pos + neg) / 2) < 1e-12
    none = df.limit(0).agg(losses.masked_mean(F.col("x"), F.col("m")).alias("a")).first()
    assert none.a == 0.0
    assert abs(one(spark, losses.cross_entropy(F.array(F.lit(0.0), F.lit(0.0)), F.lit(1))) - math.log(2)) < 1e-12


def test_nearest_k_against_all_pairs(spark):
    """Ties, repeated places, keys without a right side."""
    rng = random.Random(9)
    left = [(i, rng.randrange(4), float(rng.randrange(12))) for i in range(60)] + [(99, 7, 1.0)]
    right = [(i, rng.randrange(4), float(rng.randrange(12))) for i in range(80)]
    want = set()
    for i, k, x in left:
        for place, (_, j) in enumerate(sorted((abs(x - b), j) for j, key, b in right if key == k)[:3], 1):
            want.add((i, j, place))
    a, b = spark.createDataFrame(left, "l int, k int, x double"), spark.createDataFrame(right, "r int, k int, x double")
    assert {tuple(r) for r in joins.nearest_k(a, b, "l", "r", ("k", "k"), ("x", "x"), 3).collect()} == want
    near = {(r.l, r.nearest) for r in joins.nearest_within(a, b, "l", "r", ("k", "k"), ("x", "x"), 2.0).collect()}
    assert near == {(i, min(((abs(x - c), j) for j, key, c in right if key == k and abs(x - c) <= 2), default=(0, -1))[1]) for i, k, x in left}


def test_fields_without_points(spark):
    cells = grids.bev_cells(spark, 2, 2, (0.0, 2.0), (0.0, 2.0))
    none = spark.createDataFrame([], "px double, py double")
    assert {r.value for r in grids.gaussian_field(cells, none, 1.0).collect()} == {0.0} and {r.distance for r in grids.distance_field(cells, none, 9.0).collect()} == {9.0}
    one_point = spark.createDataFrame([(0.5, 0.5)] * 2, "px double, py double")
    assert {(r.row, r.col): r.distance for r in grids.distance_field(cells, one_point, 9.0).collect()}[(1, 0)] == 0.0


def test_samples_in_step(spark):
    samples = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 2)], "sensor string, frame int")
    ticks = spark.createDataFrame([("a", 2), ("b", 2)], "sensor string, now int")
    assert sorted(map(tuple, joins.in_step(samples, ticks, "sensor", "frame", "now").collect())) == [("a", 2), ("b", 2)]
    with pytest.raises(Exception, match="of the future"):
        joins.in_step(samples, ticks.withColumn("now", F.lit(1)), "sensor", "frame", "now").collect()


def test_supervised_rows(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 90.0, 1.0), (1, 1, 1.0, 0.0, 2.0, 90.0, 3.0), (2, 2, 0.0, 5.0, 5.0, 0.0, 0.0)], "k int, f int, t double, x double, y double, yaw double, v double")
    ways = {(r.f, r.k): (round(r.wx, 9), round(r.wy, 9), r.valid) for r in rows.trajectory(s.withColumnRenamed("k", "scene"), "scene", "f", "t", "x", "y", "yaw", 2, 0.5).collect()}
    assert ways[(0, 1)] == (1.0, 0.0, True) and ways[(0, 2)] == (2.0, 0.0, True) and ways[(1, 1)] == (0.0, 0.0, False) and ways[(2, 2)] == (0.0, 0.0, False)
    out = {r.f: r for r in rows.driving_rows(s.withColumnRenamed("k", "scene"), "scene", "f", "t", "x", "y", "yaw", "v", 2, 0.5, F.lit(True), F.lit(False), F.lit(0.0)).collect()}
    assert [getattr(out[0], b) for b in rows.BEHAVIOURS] == [0, 0, 1, 1, 0, 0, 0, 0] and [getattr(out[2], b) for b in rows.BEHAVIOURS] == [1, 0, 0, 0, 0, 0, 0, 1]
    assert not out[0].previous_valid and out[1].previous_valid and round(out[1].tx, 9) == -2.0
    assert rows.driving_rows(s.limit(0).withColumnRenamed("k", "scene"), "scene", "f", "t", "x", "y", "yaw", "v", 2, 0.5, F.lit(True), F.lit(False), F.lit(0.0)).collect() == []
