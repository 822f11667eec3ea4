"""Work that must not grow faster than the tables: the rows that plans make, on inputs of many equal or crowded rows."""

import math
import random
import time

from pyspark.sql import functions as F

from gridloom.operators import fusion, joins, losses, mesh, rows, visibility, voxel


def nodes(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
        return
    yield plan
    if name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
    kids = plan.children()
    for k in range(kids.size()):
        yield from nodes(kids.apply(k))


def run(df):
    """(rows, the most rows that any operator of the plan has put out)."""
    got, most = df.collect(), 0
    for n in nodes(df._jdf.queryExecution().executedPlan()):
        m = n.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
    return got, most


def boxes_of(spark, n):
    return spark.range(n).select(F.col("id").alias("box_id"), F.lit(0).alias("frame"), F.lit(5.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("ex"), F.lit(1.0).alias("ey"), F.lit(1.0).alias("ez"), (F.col("id") * 1.0).alias("yaw"))


def test_equal_pixels_meet_a_box_once(spark):
    pixels = spark.range(5000).select(F.lit(0).alias("frame"), F.lit(100.0).alias("u"), F.lit(100.0).alias("v"), (F.lit(5.0) + F.col("id") % 2 * 20).alias("depth"))
    got, most = run(visibility.seen_by_depth(boxes_of(spark, 40), pixels, 100.0, 100.0, 100.0, 100.0, 60.0, 2, 8.0))
    assert {(r.pixels, r.visible) for r in got} == {(2500, True)} and len(got) == 40 and most <= 5000


def test_equal_points_meet_a_box_once(spark):
    points = spark.range(5000).select(F.lit(0).alias("frame"), F.lit(5.0).alias("x"), F.lit(0.0).alias("y"), (F.col("id") % 2 * 9.0).alias("z"), F.lit(None).cast("long").alias("hit"))
    got, most = run(visibility.seen_by_points(boxes_of(spark, 40), points, 4.0))
    assert [r.visible for r in got] == [True] * 40 and most <= 5000


def test_of_equal_frames_the_first_row_of_the_table_counts(spark, tmp_path):
    import duckdb
    import pandas as pd

    from gridloom.plans import catalogue, scenes  # noqa: F401 - it registers the query

    rng = random.Random(4)
    pd.DataFrame([{"l_partkey": rng.randrange(40), "l_orderkey": rng.randrange(3), "l_linenumber": 1, "l_quantity": rng.uniform(1, 50), "l_returnflag": rng.choice("ANR")} for _ in range(4000)]).to_parquet(tmp_path / "lineitem.parquet", row_group_size=500)
    pd.DataFrame({"p_partkey": [1, 90]}).to_parquet(tmp_path / "part.parquet")
    c = duckdb.connect(config={"threads": 1})
    for n in ("lineitem", "part"):
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet'")
    want = c.execute(catalogue.SQL["actor_catalogue"]).df().set_index("actor").sort_index()
    got = catalogue.QUERIES["actor_catalogue"](spark, str(tmp_path)).toPandas().set_index("actor").sort_index()
    assert got[want.columns].astype(str).equals(want.astype(str))


def test_no_frame_is_read_anew_for_each_row(spark):
    """A window to the end of its partition is quadratic in it."""
    a = spark.createDataFrame([(1, 0, 5.0), (2, 0, 9.0), (3, 0, 12.0), (4, 1, 5.0)], "e int, k int, s double")
    b = spark.createDataFrame([(7, 0, 9.0), (8, 0, 11.0), (6, 0, 11.0)], "c int, k int, s double")
    out = visibility.first_control(a, b, "e", "k", "s", "s", "c")
    assert {(r.e, r.c, r.route_distance, r.valid) for r in out.collect()} == {(1, 7, 4.0, True), (2, 6, 2.0, True), (3, None, None, False), (4, None, None, False)}
    near = joins.asof_nearest(a, b.withColumnRenamed("c", "rid"), "k", "s", "rid")
    lerp = joins.asof_lerp(b, a.withColumnRenamed("s", "at"), "k", "s", "at", "s", "c")
    for df in (out, near, lerp):
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()


def shares(df):
    """The largest task's share of the rows."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(n) / sum(n)


def test_pairs_are_made_by_all_tasks(spark):
    rng = random.Random(8)
    rows = [(i, rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(300)]
    df = spark.createDataFrame(rows, "p int, x double, y double, z double").coalesce(1)
    flat, space = joins.pairs_in_range(df, "p", "x", "y", 2.0, 9.0), fusion.pairs_in_range_3d(df, "p", ("x", "y", "z"), 4.0, 20.0)
    for got, k, least, most in ((flat, 3, 2.0, 9.0), (space, 4, 4.0, 20.0)):
        assert sorted((r.i, r.j) for r in got.collect()) == sorted((a[0], b[0]) for a in rows for b in rows if a != b and least <= math.dist(a[1:k], b[1:k]) <= most)
        assert shares(got) < 0.6


def test_a_key_is_placed_by_several_tasks(spark):
    points = spark.createDataFrame([(i, 1, i * 1.0, 0.0) for i in range(200)], "id int, o int, px double, py double").coalesce(1)
    poses = spark.createDataFrame([(s, 1, 1.0, 2.0, 0) for s in range(50)], "s int, o int, x double, y double, yaw int").coalesce(1)
    got = fusion.placed(points, poses, "o", ("px", "py"), ("x", "y", "yaw"))
    assert {(r.id, r.s, r.wx, r.wy) for r in got.collect()} == {(i, s, i + 1.0, 2.0) for i in range(200) for s in range(50)} and got.count() == 10000
    assert shares(got) < 0.9


def test_nearest_in_a_crowd_pairs_nothing(spark):
    rng = random.Random(14)
    left, right = [(i, 0, rng.uniform(0, 20)) for i in range(400)], [(i, 0, rng.randrange(2000) / 100) for i in range(500)]
    a, b = spark.createDataFrame(left, "l int, k int, x double"), spark.createDataFrame(right, "r int, k int, x double")
    got, most = run(joins.nearest_within(a, b, "l", "r", ("k", "k"), ("x", "x"), 10.0))
    assert {(r.l, r.nearest) for r in got} == {(i, min((abs(x - c), j) for j, _, c in right)[1]) for i, _, x in left}
    assert most <= 2500


def test_fallback_in_a_crowded_frame_pairs_nothing(spark):
    """The same rows as by all pairs of a frame."""
    rng = random.Random(10)
    points = spark.createDataFrame([(i, rng.randrange(300), rng.randrange(2), rng.randrange(2), rng.randrange(4000) / 100) for i in range(400)] * 2, "p int, key int, kind int, frame int, pos double")
    boxes = spark.createDataFrame([(i, rng.randrange(2), rng.randrange(2), rng.randrange(3000) / 100) for i in range(200)], "b int, kind int, frame int, at double")
    off = (F.col("p.pos") - F.col("b.at")) / 5
    want = joins.primary_fallback(points, boxes, ["p"], F.col("p.key") == F.col("b.b"), F.col("p.kind") == F.col("b.kind"), F.col("p.frame") == F.col("b.frame"), F.when(F.abs(F.col("p.pos") - F.col("b.at")) <= 5, off * off), "b")
    got, most = run(joins.primary_nearest(points, boxes, ["p"], ("key", "b"), ("kind", "kind"), ("frame", "frame"), ("pos", "at"), 5, "b"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect())) and {r.stage for r in got} == {"id", "box"} and most <= 1600


def test_pairs_of_the_queue_are_made_once(spark):
    from gridloom.plans import catalogue, scenes  # noqa: F401 - it registers the query

    plan = catalogue.QUERIES["route_queue"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join") == 1


def test_objects_of_one_size_meet_once(spark):
    objects = spark.range(1000).select("id", F.lit("a").alias("kind"), F.when(F.col("id") % 2 == 0, 10.0).otherwise(9.0).alias("s"), (F.col("id") % 5 / 10 + 100).alias("r"), (F.col("id") % 2 == 0).alias("dense"), (F.col("id") % 7 * 1.0).alias("c"))
    got, most = run(joins.donors(objects, "id", "kind", ["s", "r"], "c", "dense", 0.001, 0.15))
    # of each size the donor of the highest coverage, then the least number
    want = {i: min((-(j % 7), j) for j in range(0, 1000, 2) if j % 5 == i % 5)[1] for i in range(1, 1000, 2)}
    assert {r.id: r.donor for r in got} == want and most <= 1000


def test_equal_points_of_a_cell_count_once(spark):
    points = spark.range(4000).select(F.lit(0).alias("cx"), F.lit(0).alias("cy"), F.lit(1.0).alias("x"), (F.col("id") % 2 * 1.0).alias("y"), F.col("id").alias("v"))
    asked = spark.range(9).select((F.col("id") % 3 - 1).cast("int").alias("cx"), F.floor(F.col("id") / 3 - 1).cast("int").alias("cy"), F.lit(1.0).alias("qx"), F.lit(0.0).alias("qy"))
    got, most = run(voxel.nearest_in_reach(asked, points, ["cx", "cy"], {"x": ("qx", "x"), "y": ("qy", "y")}, 1, 6.0, "v"))
    assert [(r.v, r.distance) for r in got] == [(0, 0.0)] * 9 and most <= 4000


def test_driving_rows_keep_the_times(spark):
    """Waypoints are those of the times as they are, to the last bit; accelerations count by the unit."""
    states = [(i, 0, 1704067211.172425 + 3571.123456 * i + i % 3, i * 1.37, i % 5 * 1.0, i * 7.0, i * 0.2) for i in range(40)]
    df = spark.createDataFrame(states, "f int, u int, t double, x double, y double, yaw double, v double")
    out = rows.driving_rows(df, "u", "f", "t", "x", "y", "yaw", "v", 4, 21600.0, F.lit(False), F.lit(False), F.lit(9.0), 10000.0).collect()
    want = {(r.f, r.k1): r.wx for r in rows.trajectory(df, "u", "f", "t", "x", "y", "yaw", 4, 21600.0).toDF("u", "f", "k1", "wx", "wy", "ok").collect()}
    assert {(r.f, p.k): p.wx for r in out for p in r.trajectory} == want and {r.accelerate for r in out} == {1}


def test_the_nearest_at_a_corner_is_that_of_the_sql(spark):
    """Where two segments meet their distances differ in the last bit only, and DuckDB squares by pow."""
    rng, found = random.Random(6), []

    def off(px, py, ax, ay, bx, by):
        dx, dy = bx - ax, by - ay
        u = min(max(((px - ax) * dx + (py - ay) * dy) / max(dx * dx + dy * dy, 1e-12), 0.0), 1.0)
        return px - (ax + u * dx), py - (ay + u * dy)

    while len(found) < 3:
        a, c = (rng.uniform(0, 40), rng.uniform(0, 400)), (rng.uniform(60, 99), rng.uniform(0, 400))
        b, p = (rng.uniform(40, 60), rng.uniform(500, 560)), (rng.uniform(45, 55), rng.uniform(600, 900))
        q = [off(*p, *a, *b), off(*p, *b, *c)]
        by_pow, by_self = ([math.sqrt(f(x) + f(y)) for x, y in q] for f in (lambda v: math.pow(v, 2.0), lambda v: v * v))
        if (by_pow[0] <= by_pow[1]) != (by_self[0] <= by_self[1]):
            found.append((len(found), p, a, b, c, 1 if by_pow[0] <= by_pow[1] else 2))
    points = spark.createDataFrame([(k, k, *p) for k, p, *_ in found], "id int, line int, px double, py double")
    segs = spark.createDataFrame([s for k, _, a, b, c, _ in found for s in ((k, 1, *a, *b), (k, 2, *b, *c))], "line int, seq int, ax double, ay double, bx double, by double")
    assert {r.id: r.seq for r in joins.nearest_segment(points, segs, "id", "line", "px", "py").collect()} == {f[0]: f[-1] for f in found}


def test_a_point_meets_its_grid_once(spark):
    cells = spark.createDataFrame([(g, r, c, float(g * 100 + r * 4 + c)) for g in range(2) for r in range(4) for c in range(4) if (g, r, c) != (1, 0, 0)], "g int, row int, col int, v double")
    points = spark.range(2000).select("id", (F.col("id") % 2).cast("int").alias("g"), (F.col("id") % 9 / 2).alias("x"), (F.col("id") % 7 / 2).alias("y"))
    got, most = run(losses.bilinear(points, cells, ["g"], F.col("x"), F.col("y"), 4, 4, "v"))
    v = lambda g, r, c: 0.0 if (g, r, c) == (1, 0, 0) else g * 100 + r * 4 + c
    for r in got:
        a, b = min(max(r.x - 0.5, 0), 3), min(max(r.y - 0.5, 0), 3)
        i, j = int(a), int(b)
        want = sum(abs(1 - k - (a - i)) * abs(1 - m - (b - j)) * v(r.g, min(i + k, 3), min(j + m, 3)) for k in (0, 1) for m in (0, 1))
        assert abs(r.sampled - want) < 1e-9
    assert len(got) == 2000 and most <= 2000


def test_a_footprint_makes_no_rows(spark):
    from pyspark.sql import Window

    rng = random.Random(18)
    df = spark.createDataFrame([(k, n, n * 4.0 + rng.random(), rng.uniform(-5, 5)) for k in range(60) for n in range(8)], "k int, n int, x double, y double")
    args = ("x", "y", Window.partitionBy("k").orderBy("n"), F.lit(2.4), F.lit(1.1))
    loss = lambda fx, fy: losses.outside(fx, fy, F.col("x"), (0.0, 30.0), (-4.0, 4.0))
    want = losses.footprint_points(df, *args).groupBy("k", "n").agg(F.max(loss(F.col("fx"), F.col("fy"))).alias("loss")).collect()
    got, most = run(losses.worst_footprint(df, *args, loss, "loss").select("k", "n", "loss"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and most <= 480


def test_modes_and_losses_in_one_pass(spark):
    rng = random.Random(21)
    df = spark.createDataFrame([(k, g, rng.random(), rng.random() * 3) for k in range(50) for g in range(4) for _ in range(6)], "k int, g int, w double, e double")
    best = losses.match_modes(df, "k", "g", "w", F.col("e"))
    want = {r.k: (r.g, r.loss) for r in best.join(losses.trajectory_losses(df, "k", "g", "w", F.col("e") * F.col("e"), best, 0.1), "k").collect()}
    out = losses.matched_losses(df, "k", "g", "w", F.col("e"), F.col("e") * F.col("e"), 0.1)
    got = {r.k: (r.g, r.loss) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_faces_go_to_their_tasks_before_repeats_are_sought(spark):
    faces = spark.range(600).select((F.col("id") % 200).alias("face"), (F.col("id") % 200).alias("a"), (F.col("id") % 200 + 1).alias("b"), F.lit(9999).alias("c"))
    got = mesh.distinct_faces(faces)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 200 and plan.index("HashAggregate") < plan.index("REPARTITION_BY_NUM") and plan.count("Exchange") == 1


def test_corners_are_looked_up_without_sorting(spark):
    faces = spark.createDataFrame([(1, 1, 2, 3), (2, 1, 2, 4), (3, 3, 2, 1), (4, 5, 1, 2)], "face int, a int, b int, c int")
    kept = mesh.prune(faces, spark.createDataFrame([(1,), (2,), (3,), (3,)], "v int"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.face for r in kept.collect()) == [1, 3] and "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortMerge", "Sort")


def test_similar_routes_go_by_blocks(spark, monkeypatch):
    """The same routes over many blocks, and a crowd whose similar pairs are too many to write."""
    rng = random.Random(2)
    routes = [(i, f"{rng.random():.9f}", *(rng.uniform(0, 12) for _ in range(4))) for i in range(1200)]
    near = lambda a, b: math.dist(a[:2], b[:2]) <= 8 and math.dist(a[2:], b[2:]) <= 8
    kept = []
    for r in sorted(routes, key=lambda r: (r[1], r[0])):
        if not any(near(r[2:], k[2:]) for k in kept):
            kept.append(r)
    monkeypatch.setattr(fusion, "BLOCK", 60, raising=False)
    written = []
    real = fusion.checkpointed
    monkeypatch.setattr(fusion, "checkpointed", lambda df: written.append(real(df)) or written[-1])
    df = spark.createDataFrame(routes, "r int, o string, sx double, sy double, ex double, ey double")
    got = fusion.drop_similar(df, "r", "o", ["sx", "sy", "ex", "ey"], 8.0)
    assert sorted(r.r for r in got.collect()) == sorted(r[0] for r in kept) and got.columns == df.columns
    # similar pairs of all routes are some 300,000
    assert max(w.count() for w in written) < 6000


def test_a_pose_finds_its_route_point_in_its_row(spark):
    from gridloom.operators import costs

    states = spark.range(300).select((F.col("id") % 3).alias("drive"), F.col("id").alias("frame"), (F.col("id") * 0.7).alias("x"), (F.col("id") % 9 - 4.0).alias("y"), F.lit(2.4).alias("ex"), F.lit(1.0).alias("ey"), F.lit(0.0).alias("yaw"))
    route = spark.range(50).select((F.col("id") % 2).alias("drive"), F.floor(F.col("id") / 2).alias("seq"), F.floor(F.col("id") / 2) * 10.0, F.lit(0.0), F.floor(F.col("id") / 2) * 10.0, F.lit(0.0), F.lit(3.5)).toDF("drive", "seq", "rx", "ry", "arc", "ryaw", "width")
    got, most = run(costs.on_route(states, route, ["drive", "frame"], "drive", costs.Limits()))
    assert len(got) == 200 and most <= 300
    for r in got:
        x, y = r.frame * 0.7, r.frame % 9 - 4.0
        far = lambda px, py: min((math.hypot(px - 10 * k, py), k) for k in range(25))
        assert r.near.seq == far(x, y)[1] and abs(r.overflow - max(max(0.0, far(x + i * 2.4, y + j)[0] - 2.25) for i in (-1, 1) for j in (-1, 1))) < 1e-9
