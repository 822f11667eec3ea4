"""Registered queries: each runs an operator over whole tables; its SQL gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import scalar as S
from gridloom.operators import grids, joins, mesh, series, voxel
from gridloom.sources import store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, event_type, value, props, t): t in seconds, whatever the session's time zone."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))") / 1e6
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", t.alias("t"))


EV = "ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) / 1e6 AS t FROM events)"
W = lambda: Window.partitionBy("user_id").orderBy("t", "event_id")
OVER = "OVER (PARTITION BY user_id ORDER BY t, event_id)"
UPTO = "OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)"
AXES = lambda: {"vx": (F.col("l_quantity"), 5.0), "vy": (F.col("l_discount"), 0.02), "vz": (F.col("l_tax"), 0.02)}
CELL = "CAST(floor(l_quantity / CAST(5 AS DOUBLE)) AS BIGINT) AS vx, CAST(floor(l_discount / CAST(0.02 AS DOUBLE)) AS BIGINT) AS vy, CAST(floor(l_tax / CAST(0.02 AS DOUBLE)) AS BIGINT) AS vz"


# voxels


@query(f"""
WITH p AS (SELECT {CELL}, l_quantity AS a, l_discount AS b, l_tax AS c, l_returnflag AS tag FROM lineitem
), m AS (SELECT vx, vy, vz, tag FROM (SELECT vx, vy, vz, tag, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY count(*) DESC, tag) AS rn FROM p GROUP BY vx, vy, vz, tag) WHERE rn = 1)
SELECT vx, vy, vz, count(*) AS n_points, round(avg(a) + 1e-10, 6) AS c_vx, round(avg(b) + 1e-10, 6) AS c_vy, round(avg(c) + 1e-10, 6) AS c_vz, any_value(m.tag) AS majority FROM p JOIN m USING (vx, vy, vz) GROUP BY vx, vy, vz""")
def voxel_aggregate(spark, sf_dir):
    out = voxel.aggregate(table(spark, sf_dir, "lineitem"), AXES(), "l_returnflag")
    # the shift takes rounding away from halves, where the order of a sum would show
    return out.select(*(F.round(F.col(c) + 1e-10, 6).alias(c) if c.startswith("c_") else c for c in out.columns))


@query(f"""
WITH p AS (SELECT {CELL}, l_quantity - (floor(l_quantity / CAST(5 AS DOUBLE)) + 0.5) * 5 AS a, l_discount - (floor(l_discount / CAST(0.02 AS DOUBLE)) + 0.5) * CAST(0.02 AS DOUBLE) AS b, l_tax - (floor(l_tax / CAST(0.02 AS DOUBLE)) + 0.5) * CAST(0.02 AS DOUBLE) AS c FROM lineitem)
SELECT vx, vy, vz, count(*) AS n_points, round(avg(a), 6) + 0 AS mean_vx, round(stddev_pop(a), 6) AS std_vx, round(avg(b), 6) + 0 AS mean_vy, round(stddev_pop(b), 6) AS std_vy, round(avg(c), 6) + 0 AS mean_vz, round(stddev_pop(c), 6) AS std_vz FROM p GROUP BY vx, vy, vz""")
def voxel_stats(spark, sf_dir):
    out = voxel.statistics(table(spark, sf_dir, "lineitem"), AXES())
    return out.select(*((F.round(c, 6) + 0.0).alias(c) if c.startswith(("mean", "std")) else c for c in out.columns))


@query("""
SELECT DISTINCT CAST(floor(l_quantity / CAST(5 AS DOUBLE)) AS BIGINT) + a AS vx, CAST(floor(l_discount / CAST(0.02 AS DOUBLE)) AS BIGINT) + b AS vy, CAST(floor(l_tax / CAST(0.02 AS DOUBLE)) AS BIGINT) + c AS vz
FROM lineitem, (VALUES (-1), (0), (1)) x(a), (VALUES (-1), (0), (1)) y(b), (VALUES (-1), (0), (1)) z(c)""")
def tudf_band(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(*voxel.cells(AXES())).distinct()
    return voxel.band(cells, ["vx", "vy", "vz"], 1, 10_000_000)


@query("""
WITH p AS (SELECT CAST(floor(p_size / CAST(5 AS DOUBLE)) AS BIGINT) AS cx, CAST(floor(p_retailprice / CAST(10 AS DOUBLE)) AS BIGINT) AS cy, p_size AS x, p_retailprice AS y, p_partkey AS k FROM part
), q AS (SELECT DISTINCT cx, cy, (cx + 0.5) * CAST(5 AS DOUBLE) AS qx, (cy + 0.5) * CAST(10 AS DOUBLE) AS qy FROM p
), j AS (SELECT q.cx, q.cy, sqrt((qx - x) * (qx - x) + (qy - y) * (qy - y)) AS d, (p.cx - q.cx + 1) * 3 + (p.cy - q.cy + 1) AS o, k FROM q JOIN p ON abs(p.cx - q.cx) <= 1 AND abs(p.cy - q.cy) <= 1
), r AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY d, o, k) AS rn FROM j WHERE d <= 6)
SELECT q.cx, q.cy, r.k AS nearest, round(r.d, 6) AS distance FROM q LEFT JOIN r ON q.cx = r.cx AND q.cy = r.cy AND rn = 1""")
def tudf_nearest(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.floor(F.col("p_size") / 5.0).alias("cx"), F.floor(F.col("p_retailprice") / 10.0).alias("cy"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_partkey").alias("nearest"))
    asked = points.select("cx", "cy").distinct().withColumns({"qx": (F.col("cx") + 0.5) * 5.0, "qy": (F.col("cy") + 0.5) * 10.0})
    return voxel.nearest_in_reach(asked, points, ["cx", "cy"], {"x": ("qx", "x"), "y": ("qy", "y")}, 1, 6.0, "nearest").withColumn("distance", F.round("distance", 6))


# scalars and geometry


@query("SELECT l_orderkey, l_linenumber, round(sign(x) * ln(1 + abs(x)) / 7, 6) AS encoded, round(x, 4) AS decoded FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * (l_discount - 0.05::DOUBLE) AS x FROM lineitem)")
def symlog_roundtrip(spark, sf_dir):
    x = F.col("l_extendedprice") * (F.col("l_discount") - 0.05)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.symlog(x, 1 / 7), 6).alias("encoded"), F.round(S.symexp(S.symlog(x, 1 / 7), 1 / 7), 4).alias("decoded"))


@query("SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS target, l_extendedprice < 50000 AS valid FROM lineitem")
def depth_target_mask(spark, sf_dir):
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.symlog(p), 6).alias("target"), (p < 50000).alias("valid"))


@query("SELECT l_orderkey, l_linenumber, abs((((l_quantity * 20 - l_partkey % 360 + 180) % 360) + 360) % 360 - 180) AS turn, CAST(least(greatest(trunc(l_discount * 3000 / 256), 0), 255) AS INTEGER) AS bin FROM lineitem")
def angle_bins(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.angle_difference(F.col("l_quantity") * 20, F.col("l_partkey") % 360).alias("turn"), S.bearing_bin(F.col("l_discount") * 3000 / 256 / 256).alias("bin"))


_POSE = """
WITH a AS (SELECT l_orderkey, l_linenumber, radians(l_tax * 100) AS r, radians(l_discount * 100) AS p, radians(l_quantity * 7) AS y, l_quantity AS x1, l_discount * 10 AS x2, l_tax * 10 AS x3, CAST(l_linenumber AS DOUBLE) AS t1, l_quantity / 2 AS t2, CAST(1 AS DOUBLE) AS t3 FROM lineitem
), m AS (SELECT *, cos(p)*cos(y) AS m11, cos(y)*sin(p)*sin(r)-sin(y)*cos(r) AS m12, -(cos(y)*sin(p)*cos(r))-sin(y)*sin(r) AS m13, sin(y)*cos(p) AS m21, sin(y)*sin(p)*sin(r)+cos(y)*cos(r) AS m22, cos(y)*sin(r)-sin(y)*sin(p)*cos(r) AS m23, sin(p) AS m31, -(cos(p)*sin(r)) AS m32, cos(p)*cos(r) AS m33 FROM a)
"""


def _pose():
    rot = G.rotation(F.col("l_tax") * 100, F.col("l_discount") * 100, F.col("l_quantity") * 7)
    return (F.col("l_quantity"), F.col("l_discount") * 10, F.col("l_tax") * 10), (F.col("l_linenumber").cast("double"), F.col("l_quantity") / 2, F.lit(1.0)), rot


@query(_POSE + "SELECT l_orderkey, l_linenumber, round(m11*x1+m12*x2+m13*x3+t1, 4) + 0 AS wx, round(m21*x1+m22*x2+m23*x3+t2, 4) + 0 AS wy, round(m31*x1+m32*x2+m33*x3+t3, 4) + 0 AS wz, round(x1, 4) + 0 AS lx, round(x2, 4) + 0 AS ly, round(x3, 4) + 0 AS lz FROM m")
def pose_transform(spark, sf_dir):
    p, t, rot = _pose()
    world = G.to_world(p, t, rot)
    local = G.to_local(world, t, rot)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(c, 4).alias(n) for c, n in zip((*world, *local), ("wx", "wy", "wz", "lx", "ly", "lz"))))


@query("""
WITH s(k, a, b, c) AS (VALUES (0,-1,-1,-1),(1,1,-1,-1),(2,1,1,-1),(3,-1,1,-1),(4,-1,-1,1),(5,1,-1,1),(6,1,1,1),(7,-1,1,1))
SELECT p_partkey, k AS corner, round(cos(radians(p_partkey % 360)) * a * p_size - sin(radians(p_partkey % 360)) * b * 2 + p_retailprice, 4) + 0 AS x, round(sin(radians(p_partkey % 360)) * a * p_size + cos(radians(p_partkey % 360)) * b * 2, 4) + 0 AS y, CAST(c * 1.5 AS DOUBLE) AS z FROM part, s""")
def obb_corners(spark, sf_dir):
    yaw = F.radians(F.col("p_partkey") % 360)
    corner = F.explode(F.array(*(F.struct(F.lit(k).alias("corner"), *(F.lit(s).alias(n) for s, n in zip(c, "abc"))) for k, c in enumerate(G.CORNERS)))).alias("s")
    rows = table(spark, sf_dir, "part").select("*", corner)
    a, b = F.col("s.a") * F.col("p_size"), F.col("s.b") * 2
    return rows.select("p_partkey", "s.corner", F.round(F.cos(yaw) * a - F.sin(yaw) * b + F.col("p_retailprice"), 4).alias("x"), F.round(F.sin(yaw) * a + F.cos(yaw) * b, 4).alias("y"), (F.col("s.c") * 1.5).alias("z"))


@query("SELECT l_orderkey, l_linenumber, round(CAST(320 AS DOUBLE) * (l_discount - 0.05::DOUBLE) / z + 320, 4) AS u, round(CAST(320 AS DOUBLE) * -(l_tax) / z + 240, 4) AS v, x AS depth FROM (SELECT *, l_quantity - 1 AS x, CASE WHEN abs(l_quantity - 1) < 1e-6 THEN 1e-6 ELSE l_quantity - 1 END AS z FROM lineitem)")
def pinhole_projection(spark, sf_dir):
    u, v, z = G.pinhole((F.col("l_quantity") - 1, F.col("l_discount") - 0.05, F.col("l_tax")), F.lit(320.0), F.lit(320.0), F.lit(320.0), F.lit(240.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"), z.alias("depth"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, -CAST(l_linenumber AS DOUBLE) - 5 AS ox, l_discount * 20 - 1 AS oy, CAST(1 AS DOUBLE) AS dx, CASE WHEN l_returnflag = 'N' THEN CAST(0 AS DOUBLE) ELSE l_tax END AS dy FROM lineitem
), s AS (SELECT *, (-2 - ox) / dx AS x0, (2 - ox) / dx AS x1, CASE WHEN abs(dy) < 1e-9 THEN NULL ELSE (-1 - oy) / dy END AS y0, CASE WHEN abs(dy) < 1e-9 THEN NULL ELSE (1 - oy) / dy END AS y1 FROM r
), t AS (SELECT *, greatest(least(x0, x1), coalesce(least(y0, y1), CAST('-inf' AS DOUBLE))) AS n, least(greatest(x0, x1), coalesce(greatest(y0, y1), CAST('inf' AS DOUBLE))) AS f FROM s)
SELECT l_orderkey, l_linenumber, round(n, 6) AS near, round(f, 6) AS far, (y0 IS NOT NULL OR abs(oy) <= 1) AND f >= greatest(n, 0) AS hit FROM t""")
def ray_box_visibility(spark, sf_dir):
    origin = (-F.col("l_linenumber").cast("double") - 5, F.col("l_discount") * 20 - 1, F.lit(0.0))
    ray = (F.lit(1.0), F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_tax")), F.lit(0.0))
    near, far, hit = G.slab(origin, ray, (F.lit(2.0), F.lit(1.0), F.lit(1.0)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(near, 6).alias("near"), F.round(far, 6).alias("far"), hit.alias("hit"))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS ax, l_discount * 100 AS ay, l_quantity + 10 AS bx, l_tax * 100 AS byy FROM lineitem
), d AS (SELECT *, (bx - ax) * (10 - 0) - (byy - ay) * (30 - 20) AS den FROM s
), u AS (SELECT *, CASE WHEN den = 0 THEN NULL ELSE ((20 - ax) * 10 - (0 - ay) * 10) / den END AS t, CASE WHEN den = 0 THEN NULL ELSE ((20 - ax) * (byy - ay) - (0 - ay) * (bx - ax)) / den END AS u FROM d)
SELECT l_orderkey, l_linenumber, coalesce(t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1, false) AS crosses FROM u""")
def red_line_crossing(spark, sf_dir):
    ends = (F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_quantity") + 10, F.col("l_tax") * 100)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.segments_cross(*ends, F.lit(20.0), F.lit(0.0), F.lit(30.0), F.lit(10.0)).alias("crosses"))


_BOX = """
WITH b AS (SELECT p_partkey, p_size / CAST(5 AS DOUBLE) AS x, (p_retailprice - 950) / 5 AS y, radians(p_partkey % 360) AS w FROM part
), s(a, c) AS (VALUES (-1,-1),(1,-1),(1,1),(-1,1)
), k AS (SELECT p_partkey, x, y, w, x + cos(w) * (a * 2.25::DOUBLE) - sin(w) * (c * 1::DOUBLE) AS px, y + sin(w) * (a * 2.25::DOUBLE) + cos(w) * (c * 1::DOUBLE) AS py, a * 2.4::DOUBLE AS ex, c * 1.1::DOUBLE AS ey FROM b, s
), o AS (SELECT p_partkey,
  least(2.4::DOUBLE, max(px)) - greatest(-2.4::DOUBLE, min(px)) AS m1, least(1.1::DOUBLE, max(py)) - greatest(-1.1::DOUBLE, min(py)) AS m2,
  least(max(cos(w)*ex+sin(w)*ey), max(cos(w)*px+sin(w)*py)) - greatest(min(cos(w)*ex+sin(w)*ey), min(cos(w)*px+sin(w)*py)) AS m3,
  least(max(cos(w)*ey-sin(w)*ex), max(cos(w)*py-sin(w)*px)) - greatest(min(cos(w)*ey-sin(w)*ex), min(cos(w)*py-sin(w)*px)) AS m4,
  min(sqrt(pow(greatest(abs(px)-2.4::DOUBLE,0),2)+pow(greatest(abs(py)-1.1::DOUBLE,0),2))) AS d1,
  min(sqrt(pow(greatest(abs(cos(w)*(ex-x)+sin(w)*(ey-y))-2.25::DOUBLE,0),2)+pow(greatest(abs(cos(w)*(ey-y)-sin(w)*(ex-x))-1::DOUBLE,0),2))) AS d2 FROM k GROUP BY p_partkey)
SELECT p_partkey, round(CASE WHEN least(m1, m2, m3, m4) < 0 THEN least(d1, d2) ELSE -least(m1, m2, m3, m4) END, 4) + 0 AS distance FROM o"""


@query(_BOX)
def obb_signed_distance(spark, sf_dir):
    ego = (F.lit(0.0), F.lit(0.0), F.lit(2.4), F.lit(1.1), F.lit(0.0))
    box = (F.col("p_size") / 5, (F.col("p_retailprice") - 950) / 5, F.lit(2.25), F.lit(1.0), (F.col("p_partkey") % 360).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(G.box_distance(ego, box), 4).alias("distance"))


@query("""SELECT p_partkey, ['red','green','blue','grey'][(p_size % 4) + 1] AS wrapped, CASE WHEN p_size < 4 THEN ['red','green','blue','grey'][p_size + 1] ELSE 'magenta' END AS unknown, ['red','green','blue','grey'][least(p_size, 3) + 1] AS clamped FROM part""")
def palette_policies(spark, sf_dir):
    colours = ["red", "green", "blue", "grey"]
    return table(spark, sf_dir, "part").select("p_partkey", *(S.palette(F.col("p_size"), colours, p).alias(n) for p, n in (("modulo", "wrapped"), ("unknown", "unknown"), ("clamp", "clamped"))))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN x > 0 THEN CASE WHEN abs(a) <= 10 THEN 'straight' WHEN a < -10 THEN 'left' ELSE 'right' END END AS direction FROM (SELECT l_orderkey, l_linenumber, l_quantity - 2 AS x, degrees(atan2(l_discount * 100 - 5, l_quantity - 2)) AS a FROM lineitem)""")
def direction_of_waypoint(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.direction(F.col("l_quantity") - 2, F.col("l_discount") * 100 - 5).alias("direction"))


# joins


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 25 AS frame, l_linenumber % 3 AS kind, l_extendedprice / 10 AS pos FROM lineitem
), f AS (SELECT l_orderkey, l_linenumber, l_suppkey, frame, kind, pos, min(s_suppkey) AS box FROM p LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey % 3 = kind GROUP BY ALL
), s AS (SELECT f.l_orderkey, f.l_linenumber, f.l_suppkey, f.pos, s_suppkey AS box, row_number() OVER (PARTITION BY f.l_orderkey, f.l_linenumber, f.l_suppkey, f.pos ORDER BY ((pos - s_acctbal) / 525) * ((pos - s_acctbal) / 525), s_suppkey) AS rn FROM f JOIN supplier ON s_nationkey = frame AND s_nationkey % 3 = kind WHERE f.box IS NULL AND abs(pos - s_acctbal) <= 525)
SELECT l_orderkey, l_linenumber, l_suppkey, pos, box, 'id' AS stage FROM f WHERE box IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, pos, box, 'box' FROM s WHERE rn = 1""")
def fusion_primary_fallback(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_extendedprice") / 10).alias("pos"), (F.col("l_partkey") % 25).alias("frame"), (F.col("l_linenumber") % 3).alias("kind"))
    boxes = table(spark, sf_dir, "supplier").withColumn("s_kind", F.col("s_nationkey") % 3)
    return joins.primary_nearest(points, boxes, ["l_orderkey", "l_linenumber", "l_suppkey", "pos"], ("l_suppkey", "s_suppkey"), ("kind", "s_kind"), ("frame", "s_nationkey"), ("pos", "s_acctbal"), 525, "s_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s_nationkey = l_partkey % 25 AND s_suppkey = l_suppkey)")
def own_points_removed(spark, sf_dir):
    """Points of a frame that hit the car of that frame go."""
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 25).alias("frame"))
    cars = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("frame"), F.col("s_suppkey").alias("l_suppkey"))
    return points.join(cars, ["frame", "l_suppkey"], "left_anti").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") * 100.0).alias("y"))


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j, round(d, 4) AS distance FROM supplier a, supplier b, LATERAL (SELECT sqrt((a.s_acctbal - b.s_acctbal) * (a.s_acctbal - b.s_acctbal) + pow((a.s_nationkey - b.s_nationkey) * 100, 2)) AS d) WHERE a.s_suppkey <> b.s_suppkey AND d BETWEEN 150 AND 300")
def route_pairs_range(spark, sf_dir):
    return joins.pairs_in_range(_suppliers(spark, sf_dir), "s_suppkey", "s_acctbal", "y", 150.0, 300.0).select("i", "j", F.round("distance", 4).alias("distance"))


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a, supplier b WHERE a.s_suppkey <> b.s_suppkey AND sqrt((a.s_acctbal - b.s_acctbal) * (a.s_acctbal - b.s_acctbal) + pow((a.s_nationkey - b.s_nationkey) * 100, 2)) BETWEEN 150 AND 300 AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = (a.s_suppkey + b.s_suppkey) % 50)")
def route_pairs_resume(spark, sf_dir):
    pairs = joins.pairs_in_range(_suppliers(spark, sf_dir), "s_suppkey", "s_acctbal", "y", 150.0, 300.0)
    done = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    return pairs.withColumn("k", (F.col("i") + F.col("j")) % 50).join(done, "k", "left_anti").select("i", "j")


@query("""
WITH j AS (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS rn FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 500)
SELECT c.c_custkey, coalesce(s_suppkey, -1) AS nearest FROM customer c LEFT JOIN j ON c.c_custkey = j.c_custkey AND rn = 1""")
def control_nearest_radius(spark, sf_dir):
    return joins.nearest_within(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), "c_custkey", "s_suppkey", ("c_nationkey", "s_nationkey"), ("c_acctbal", "s_acctbal"), 500.0)


def _lines(spark, sf_dir):
    """All events as tracks, and customers over all user ids."""
    ev = events(spark, sf_dir).withColumn("x", F.col("t") / 3600 - 473000)
    users = ev.agg((F.max("user_id") + 1).alias("users"))
    points = table(spark, sf_dir, "customer").join(F.broadcast(users)).select("c_custkey", (F.col("c_custkey") % F.col("users")).alias("user_id"), (F.col("c_custkey") % 700 * 1.0).alias("px"), (F.abs("c_acctbal") / 20).alias("py"))
    return points, joins.segments(ev, "user_id", ["t", "event_id"], "x", "value")


_SEG = f"""
WITH {EV}, s AS (SELECT user_id, row_number() {OVER} AS seq, t / 3600 - 473000 AS ax, value AS ay, lead(t / 3600 - 473000) {OVER} AS bx, lead(value) {OVER} AS by_ FROM ev
), p AS (SELECT c_custkey, c_custkey % (SELECT max(user_id) + 1 FROM ev) AS user_id, c_custkey % 700 * CAST(1 AS DOUBLE) AS px, abs(c_acctbal) / 20 AS py FROM customer
), j AS (SELECT c_custkey, seq, px, py, ax, ay, bx - ax AS dx, by_ - ay AS dy FROM p JOIN s USING (user_id) WHERE bx IS NOT NULL
), u AS (SELECT *, least(greatest(((px - ax) * dx + (py - ay) * dy) / greatest(dx * dx + dy * dy, 1e-12), 0), 1) AS u FROM j
), d AS (SELECT c_custkey, seq, sqrt(pow(px - (ax + u * dx), 2) + pow(py - (ay + u * dy), 2)) AS d FROM u)
"""


@query(_SEG + "SELECT c_custkey, seq, round(d, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, seq) AS rn FROM d) WHERE rn = 1")
def polyline_match(spark, sf_dir):
    points, segs = _lines(spark, sf_dir)
    return joins.nearest_segment(points, segs, "c_custkey", "user_id", "px", "py").select("c_custkey", F.col("seq"), F.round("distance", 4).alias("distance"))


@query(_SEG + "SELECT c_custkey, seq FROM d WHERE d <= 25")
def segment_grid_candidates(spark, sf_dir):
    points, segs = _lines(spark, sf_dir)
    return joins.segments_near(points, segs, "c_custkey", "user_id", "px", "py", 25.0, 50.0)


@query(f"""
WITH {EV}, b AS (SELECT user_id, min(t) AS t0, max(t) AS t1 FROM ev GROUP BY user_id
), g AS (SELECT user_id, t0 + k * 86400 AS at_t FROM b, range(0, 31) r(k) WHERE t0 + k * 86400 <= t1
), s AS (SELECT user_id, t, value, lead(t) {OVER} AS tn, lead(value) {OVER} AS vn FROM ev)
SELECT user_id, at_t, round(CASE WHEN tn IS NULL OR tn = t THEN value ELSE value + (at_t - t) / (tn - t) * (vn - value) END, 4) AS value FROM g JOIN s USING (user_id) WHERE at_t >= t AND (at_t < tn OR tn IS NULL AND at_t = t)""")
def asof_lerp(spark, sf_dir):
    ev = events(spark, sf_dir)
    span = ev.groupBy("user_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    asks = span.select("user_id", "t0", "t1", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("t1") - F.col("t0")) / 86400) + 1)).alias("k")).withColumn("at_t", F.col("t0") + F.col("k") * 86400).where("at_t <= t1").select("user_id", "at_t")
    return joins.asof_lerp(ev, asks, "user_id", "t", "at_t", "value", "event_id").select("user_id", "at_t", F.round("value", 4).alias("value"))


@query(f"""
WITH {EV}, a AS (SELECT event_id, user_id, t FROM ev WHERE event_type = (SELECT min(event_type) FROM ev)), b AS (SELECT event_id AS rid, user_id, t AS rt FROM ev WHERE event_type = (SELECT max(event_type) FROM ev)
), j AS (SELECT event_id, a.user_id, rid, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - rt), rt, rid) AS rn FROM a LEFT JOIN b ON a.user_id = b.user_id)
SELECT event_id, user_id, rid AS nearest FROM j WHERE rn = 1""")
def asof_nearest(spark, sf_dir):
    ev = events(spark, sf_dir)
    kinds = ev.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    left = ev.join(F.broadcast(kinds), F.col("event_type") == F.col("a")).select("event_id", "user_id", "t")
    right = ev.join(F.broadcast(kinds), F.col("event_type") == F.col("b")).select(F.col("event_id").alias("rid"), "user_id", "t")
    return joins.asof_nearest(left, right, "user_id", "t", "rid").select("event_id", "user_id", "nearest")


@query(f"""
WITH {EV}, a AS (SELECT DISTINCT user_id, CAST(floor(t / 86400) AS BIGINT) AS day FROM ev WHERE value < 50), b AS (SELECT DISTINCT user_id, CAST(floor(t / 86400) AS BIGINT) AS day FROM ev WHERE value >= 50)
SELECT count(*) FILTER (WHERE a.day IS NOT NULL AND b.day IS NOT NULL) AS "both", count(*) FILTER (WHERE b.day IS NULL) AS only_left, count(*) FILTER (WHERE a.day IS NULL) AS only_right FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day""")
def frame_alignment(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400))
    return joins.aligned(ev.where("value < 50"), ev.where("value >= 50"), ["user_id", "day"])


@query("""
WITH o AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS s, p_retailprice AS r, p_size >= 10 AS dense FROM part
), j AS (SELECT a.p_partkey, b.p_partkey AS donor, abs(a.s - b.s) <= 0.001 AND abs(a.r - b.r) <= 0.001 AS exact, abs(a.s - b.s) / greatest(a.s, b.s) AS ds, abs(a.r - b.r) / greatest(a.r, b.r) AS dr, b.r AS coverage FROM o a JOIN o b ON a.p_brand = b.p_brand AND NOT a.dense AND b.dense
), k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY exact DESC, sqrt(ds * ds + dr * dr), coverage DESC, donor) AS rn FROM j WHERE exact OR (ds <= 0.15::DOUBLE AND dr <= 0.15::DOUBLE))
SELECT p_partkey, donor, CASE WHEN exact THEN 'exact' ELSE 'similar' END AS how FROM k WHERE rn = 1""")
def donor_rank(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"), (F.col("p_size") >= 10).alias("dense"))
    return joins.donors(parts, "p_partkey", "p_brand", ["s", "r"], "r", "dense", 0.001, 0.15)


@query("""
WITH c AS (SELECT label AS centre, k, avg(v) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY label, k
), e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings
), d AS (SELECT vec_id, centre, round(sum((v - m) * (v - m)), 6) AS d FROM e JOIN c USING (k) GROUP BY vec_id, centre)
SELECT vec_id, centre, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, centre) AS rn FROM d) WHERE rn = 1""")
def nearest_vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    flat = e.select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centres = flat.groupBy(F.col("label").alias("centre")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"))
    d = F.aggregate(F.zip_with("embedding", "c", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return e.crossJoin(centres).groupBy("vec_id").agg(F.min(F.struct(F.round(d, 6).alias("distance"), "centre")).alias("m")).select("vec_id", "m.centre", "m.distance")


@query("""SELECT c_custkey, s_suppkey, rn AS place FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS rn FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE rn <= 3""")
def topk_nearest(spark, sf_dir):
    return joins.nearest_k(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), "c_custkey", "s_suppkey", ("c_nationkey", "s_nationkey"), ("c_acctbal", "s_acctbal"), 3).select("c_custkey", "s_suppkey", "place")


# series


@query(f"""
WITH {EV}, s AS (SELECT event_id, CASE WHEN lead(t) {OVER} IS NULL THEN NULL WHEN lead(t) {OVER} - t > 0 THEN (lead(value) {OVER} - value) / (lead(t) {OVER} - t) ELSE 0 END AS f, CASE WHEN lag(t) {OVER} IS NULL THEN NULL WHEN t - lag(t) {OVER} > 0 THEN (value - lag(value) {OVER}) / (t - lag(t) {OVER}) ELSE 0 END AS b FROM ev)
SELECT event_id, round(CASE WHEN f IS NOT NULL AND b IS NOT NULL THEN (f + b) / 2 ELSE coalesce(f, b, 0) END, 6) + 0 AS acceleration FROM s""")
def speed_acceleration(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.round(series.acceleration(F.col("value"), F.col("t"), W()), 6).alias("acceleration"))


@query(f"WITH {EV} SELECT event_id, coalesce(lag(value, 2) {OVER}, value) AS previous, row_number() {OVER} > 2 AS valid FROM ev")
def previous_frame_fallback(spark, sf_dir):
    value, valid = series.previous(F.col("value"), W(), 2)
    return events(spark, sf_dir).select("event_id", value.alias("previous"), valid.alias("valid"))


_ARC = f"WITH {EV}, x AS (SELECT *, t / 3600 AS h FROM ev), st AS (SELECT *, coalesce(sqrt(pow(h - lag(h) {OVER}, 2) + pow(value - lag(value) {OVER}, 2)), 0) AS step FROM x), arc AS (SELECT *, sum(step) {UPTO} AS arc FROM st)"


@query(_ARC + " SELECT event_id, round(arc, 4) AS arc FROM arc")
def route_arclength(spark, sf_dir):
    return series.arc_length(events(spark, sf_dir).withColumn("h", F.col("t") / 3600), F.col("h"), F.col("value"), W()).select("event_id", F.round("arc", 4).alias("arc"))


@query(_ARC + f""", l AS (SELECT *, lag(arc) {OVER} AS la, lag(value) {OVER} AS lv FROM arc)
SELECT event_id, round(least(arc, 1000), 4) AS arc, round(CASE WHEN arc > 1000 THEN lv + (1000 - la) / (arc - la) * (value - lv) ELSE value END, 4) AS value, arc > 1000 AS boundary FROM l WHERE arc <= 1000 OR (la < 1000 AND arc > 1000)""")
def route_lookahead(spark, sf_dir):
    rows = series.arc_length(events(spark, sf_dir).withColumn("h", F.col("t") / 3600), F.col("h"), F.col("value"), W())
    return series.look_ahead(rows, "arc", "h", "value", W(), 1000.0).select("event_id", F.round("arc", 4).alias("arc"), F.round("value", 4).alias("value"), "boundary")


@query(f"WITH {EV}, l AS (SELECT event_id, value - lag(value) {OVER} AS d FROM ev) SELECT event_id FROM l WHERE d IS NULL OR sqrt(d * d) > 5")
def route_dedupe(spark, sf_dir):
    return series.drop_close(events(spark, sf_dir), F.lit(0.0), F.col("value"), W(), 5.0).select("event_id")


_COUNT = f"WITH {EV}, c AS (SELECT *, CAST(floor(value / 50) AS BIGINT) AS total FROM ev), d AS (SELECT *, greatest(total - lag(total, 1, 0) {OVER}, 0) AS fresh FROM c)"


@query(_COUNT + " SELECT event_id, fresh FROM d")
def collision_delta(spark, sf_dir):
    return events(spark, sf_dir).withColumn("total", F.floor(F.col("value") / 50)).select("event_id", series.new_events(F.col("total"), W()).alias("fresh"))


@query(_COUNT + f" SELECT event_id, CAST(sum(fresh) {UPTO} AS BIGINT) AS cost FROM d")
def cost_history(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("total", F.floor(F.col("value") / 50)).withColumn("fresh", series.new_events(F.col("total"), W()))
    return rows.select("event_id", F.sum("fresh").over(series.running(W())).alias("cost"))


_OW = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"


@query(f"""
WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice / 1000 AS x, CAST(o_orderkey % 100 AS DOUBLE) AS y FROM orders
), a AS (SELECT *, x - lag(x) {_OW} AS dx, y - lag(y) {_OW} AS dy FROM p), b AS (SELECT *, coalesce(sqrt(dx * dx + dy * dy) / 0.1, 0) AS speed, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-6 THEN degrees(atan2(dy, dx)) END AS h FROM a
), c AS (SELECT *, coalesce((speed - lag(speed) {_OW}) / 0.1, 0) AS accel FROM b), d AS (SELECT *, coalesce((accel - lag(accel) {_OW}) / 0.1, 0) AS jerk FROM c)
SELECT o_orderkey, round(speed, 3) AS speed, round(accel, 2) AS accel, round(jerk, 1) AS jerk, round(coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 0), 6) AS heading FROM d""")
def trajectory_kinematics(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 100).cast("double").alias("y"))
    out = series.kinematics(rows, "x", "y", 0.1, w)
    return out.select("o_orderkey", F.round("speed", 3).alias("speed"), F.round("accel", 2).alias("accel"), F.round("jerk", 1).alias("jerk"), F.round("heading", 6).alias("heading"))


@query("SELECT o_orderkey, CAST(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS start FROM (SELECT o_custkey, o_orderkey, o_orderkey % 7 + 1 AS n FROM orders)")
def packed_offsets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("n", F.col("o_orderkey") % 7 + 1)
    return rows.select("o_orderkey", series.offsets(F.col("n"), Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("start"))


@query(f"WITH {EV} SELECT * FROM (SELECT event_id, value AS a, lead(value) {OVER} AS b FROM ev) WHERE b IS NOT NULL")
def track_segments(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.col("value").alias("a"), F.lead("value").over(W()).alias("b")).where("b is not null")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem
), k AS (SELECT DISTINCT s, n, CAST(floor(k * (n - 1) / CAST(31 AS DOUBLE)) AS BIGINT) AS i FROM (SELECT DISTINCT l_suppkey AS s, n FROM r), range(32) g(k))
SELECT l_suppkey, i AS place, l_orderkey, l_linenumber FROM r WHERE n <= 32 UNION ALL SELECT l_suppkey, r.i, l_orderkey, l_linenumber FROM r JOIN k ON l_suppkey = s AND r.i = k.i WHERE r.n > 32""")
def uniform_subsample(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    return series.subsample(rows, ["l_suppkey"], w, 32).select("l_suppkey", "place", "l_orderkey", "l_linenumber")


@query("SELECT event_id, (event_id - 1) % 5 = 0 AS expert, event_id % 5 = 0 AS model FROM events WHERE (event_id - 1) % 5 = 0 OR event_id % 5 = 0")
def tick_capture(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") - 1) % 5 == 0).alias("expert"), (F.col("event_id") % 5 == 0).alias("model"))
    return rows.where("expert or model")


@query(f"""
WITH {EV}, r AS (SELECT event_id, user_id, row_number() {OVER} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev
), m AS (SELECT *, i >= n - n % 8 AS pooled FROM r), p AS (SELECT *, CASE WHEN pooled THEN row_number() OVER (PARTITION BY pooled ORDER BY user_id, i) - 1 ELSE i END AS place, sum(CASE WHEN pooled THEN 1 ELSE 0 END) OVER () AS total FROM m)
SELECT event_id, user_id, pooled, CAST(floor(place / 8) AS BIGINT) AS batch, CAST(place % 8 AS BIGINT) AS slot FROM p WHERE NOT pooled OR (floor(place / 8) + 1) * 8 <= total""")
def scene_batches(spark, sf_dir):
    out = series.batches(events(spark, sf_dir).select("event_id", "user_id", "t"), "user_id", ["t", "event_id"], 8, True)
    return out.select("event_id", "user_id", "pooled", F.col("batch").cast("long"), F.col("slot").cast("long"))


@query(f"""
WITH {EV}, f AS (SELECT *, sum(CASE WHEN value < 60 THEN 0 ELSE 1 END) {UPTO} AS g FROM ev)
SELECT event_id, CAST(sum(CASE WHEN value < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f""")
def stall_runs(spark, sf_dir):
    return series.runs(events(spark, sf_dir), F.col("value") < 60, ["user_id"], ["t", "event_id"]).select("event_id", "run")


@query(f"WITH {EV} SELECT event_id, coalesce(last_value(CASE WHEN value > 300 THEN event_id END IGNORE NULLS) {UPTO}, -1) AS light FROM ev")
def sticky_light(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.coalesce(series.sticky(F.when(F.col("value") > 300, F.col("event_id")), W()), F.lit(-1)).alias("light"))


# aggregates


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS other FROM orders GROUP BY o_orderpriority""")
def state_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), F.count_if(~s.isin("F", "O")).alias("other"))


_POLAR = """
WITH e AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings
), b AS (SELECT least(greatest(CAST(trunc((atan2(y, x) + pi()) / (2 * pi()) * 32) AS BIGINT), 0), 31) AS bin, max(sqrt(x * x + y * y)) AS reach FROM e GROUP BY 1
), env AS (SELECT g.bin, coalesce(reach, 0) AS reach FROM range(32) g(bin) LEFT JOIN b ON g.bin = b.bin)
"""


def _bearing(x, y):
    return S.bearing_bin((F.atan2(y, x) + math.pi) / (2 * math.pi), 32)


def _envelope(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return grids.envelope(e, _bearing(F.col("x"), F.col("y")), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 32)


@query(_POLAR + "SELECT bin, round(reach, 6) AS reach FROM env")
def polar_envelope(spark, sf_dir):
    return _envelope(spark, sf_dir).select("bin", F.round("reach", 6).alias("reach"))


_CELLS = "c AS (SELECT r AS row, k AS col, 0.6::DOUBLE - (r + 0.5) * ((0.6::DOUBLE - -0.6::DOUBLE) / 24) AS x, -0.6::DOUBLE + (k + 0.5) * ((0.6::DOUBLE - -0.6::DOUBLE) / 24) AS y FROM range(24) a(r), range(24) b(k))"


def _cells(spark):
    return grids.bev_cells(spark, 24, 24, (-0.6, 0.6), (-0.6, 0.6))


@query(_POLAR + f", {_CELLS} SELECT row, col, sqrt(x * x + y * y) > reach AS risk FROM c JOIN env ON least(greatest(CAST(trunc((atan2(y, x) + pi()) / (2 * pi()) * 32) AS BIGINT), 0), 31) = bin")
def risk_cells(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return grids.beyond(_cells(spark), _bearing(x, y), F.sqrt(x * x + y * y), _envelope(spark, sf_dir)).select("row", "col", "risk")


def _few(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 10000 - 0.4).alias("px"), (F.col("s_nationkey") / 25.0 - 0.5).alias("py"))


_FEW = f"WITH {_CELLS}, p AS (SELECT s_acctbal / 10000 - 0.4::DOUBLE AS px, s_nationkey / 25.0::DOUBLE - 0.5 AS py FROM supplier)"


@query(_FEW + " SELECT row, col, round(max(exp(-((x - px) * (x - px) + (y - py) * (y - py)) / (2 * 0.1::DOUBLE * 0.1::DOUBLE))), 6) AS value FROM c, p GROUP BY row, col")
def gaussian_field(spark, sf_dir):
    return grids.gaussian_field(_cells(spark), _few(spark, sf_dir), 0.1).withColumn("value", F.round("value", 6))


@query(_FEW + " SELECT row, col, round(min(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 6) AS distance FROM c, p GROUP BY row, col")
def distance_field(spark, sf_dir):
    return grids.distance_field(_cells(spark), _few(spark, sf_dir), 1.2 * math.sqrt(2)).withColumn("distance", F.round("distance", 6))


@query("SELECT p_brand, count(*) AS n, round(count(*) * 0.01::DOUBLE / (8 * (avg(p_size) * avg(p_retailprice) / 1000 + avg(p_size) + avg(p_retailprice) / 1000)), 6) AS coverage, count(*) >= 64 AS dense FROM part GROUP BY p_brand")
def surface_coverage(spark, sf_dir):
    a, b = F.avg("p_size"), F.avg("p_retailprice") / 1000
    n = F.count("*")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(n.alias("n"), F.round(n * 0.01 / (8 * (F.avg("p_size") * F.avg("p_retailprice") / 1000 + a + b)), 6).alias("coverage"), (n >= 64).alias("dense"))


def _faces(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("face"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_orderkey").alias("c"))


_FACES = "WITH f AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS face, l_partkey AS a, l_suppkey AS b, l_orderkey AS c FROM lineitem)"


@query(_FACES + """, e AS (SELECT least(a, b) AS u, greatest(a, b) AS v FROM f UNION ALL SELECT least(b, c), greatest(b, c) FROM f UNION ALL SELECT least(c, a), greatest(c, a) FROM f), n AS (SELECT u, v, count(*) AS n FROM e GROUP BY u, v)
SELECT count(*) FILTER (WHERE n = 1) AS boundary, count(*) FILTER (WHERE n = 2) AS regular, count(*) FILTER (WHERE n > 2) AS non_manifold, count(*) = count(*) FILTER (WHERE n = 2) AS closed FROM n""")
def edge_topology(spark, sf_dir):
    return mesh.topology(mesh.distinct_faces(_faces(spark, sf_dir)))


@query(_FACES + ", g AS (SELECT *, row_number() OVER (PARTITION BY list_sort([a, b, c]) ORDER BY face, a, b, c) AS rn FROM f WHERE a <> b AND b <> c AND a <> c) SELECT list_sort([a, b, c])[1] AS a, list_sort([a, b, c])[2] AS b, list_sort([a, b, c])[3] AS c, face FROM g WHERE rn = 1")
def face_clean(spark, sf_dir):
    k = F.array_sort(F.array("a", "b", "c"))
    return mesh.clean(mesh.distinct_faces(_faces(spark, sf_dir))).select(k[0].alias("a"), k[1].alias("b"), k[2].alias("c"), "face")


@query("SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / greatest(sum(l_quantity), 1), 4) AS mean FROM lineitem GROUP BY l_returnflag")
def loss_meter(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.greatest(F.sum("l_quantity"), F.lit(1.0)), 4).alias("mean"))


@query("WITH e AS (SELECT l_linenumber, l_extendedprice / l_quantity / 1000 - p_retailprice / 1000 AS e, l_discount > 0.05::DOUBLE AS m FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_linenumber, round(sum(CASE WHEN m THEN CASE WHEN abs(e) < 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END ELSE 0 END) / greatest(count(*) FILTER (WHERE m), 1), 6) AS loss FROM e GROUP BY l_linenumber")
def masked_smooth_l1(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    e, m = F.col("l_extendedprice") / F.col("l_quantity") / 1000 - F.col("p_retailprice") / 1000, F.col("l_discount") > 0.05
    return rows.groupBy("l_linenumber").agg(F.round(F.sum(F.when(m, S.smooth_l1(e)).otherwise(0.0)) / F.greatest(F.count_if(m), F.lit(1)), 6).alias("loss"))


@query("WITH c AS (SELECT l_orderkey, l_linenumber AS mode, sum(abs(l_discount - l_tax) * (0.1::DOUBLE + l_quantity / 50)) / count(*) AS cost FROM lineitem GROUP BY 1, 2), r AS (SELECT l_orderkey, mode, round(cost, 9) AS k FROM c) SELECT l_orderkey, mode FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k, mode) AS rn FROM r) WHERE rn = 1")
def ade_argmin(spark, sf_dir):
    cost = F.sum(F.abs(F.col("l_discount") - F.col("l_tax")) * (0.1 + F.col("l_quantity") / 50)) / F.count("*")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("mode")).agg(F.round(cost, 9).alias("k"))
    return rows.groupBy("l_orderkey").agg(F.min(F.struct("k", "mode")).alias("m")).select("l_orderkey", "m.mode")


@query(f"WITH {EV} SELECT user_id, count(*) AS steps, max(value) AS worst, arg_max(event_type, t * 1e6 + event_id / 1e9) AS last FROM ev GROUP BY user_id")
def episode_summary(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("steps"), F.max("value").alias("worst"), F.max_by("event_type", F.struct("t", "event_id")).alias("last"))


@query("SELECT o_orderpriority, round(count(*) FILTER (WHERE o_orderstatus = 'F') / greatest(count(*), 1), 6) AS rate FROM orders GROUP BY o_orderpriority")
def success_rate(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.count_if(F.col("o_orderstatus") == "F") / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"))


@query("SELECT event_type, round(quantile_cont(value, 0.99), 6) AS p99, round(median(value), 6) AS p50 FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.99)), 6).alias("p99"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def scene_discovery_dups(spark, sf_dir):
    return store.duplicates(table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("k")), "k").select("k.l_orderkey", "k.l_linenumber", "n")


@query("SELECT o_orderkey, sha256(CAST(to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority}) AS VARCHAR)) AS fingerprint FROM orders")
def fingerprint(spark, sf_dir):
    return store.fingerprint(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"]).select("o_orderkey", "fingerprint")


@query("SELECT s_suppkey, unnest(range(s_suppkey % 5)) AS frame FROM supplier")
def frame_index(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("n", F.col("s_suppkey") % 5)
    return store.frame_index(rows, "s_suppkey", "n").select("s_suppkey", F.col("frame").cast("long").alias("frame"))


@query("SELECT 'negative' AS rule, count(*) AS n FROM lineitem WHERE l_extendedprice < 0 UNION ALL SELECT 'flag', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N', 'R') UNION ALL SELECT 'orphan', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def constraint_violations(spark, sf_dir):
    rows, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    count = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
    return count(rows.where("l_extendedprice < 0"), "negative").union(count(rows.where("l_returnflag not in ('A', 'N', 'R')"), "flag")).union(count(rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"), "orphan"))


@query("SELECT event_id, CASE WHEN value > 400 THEN 'collision' WHEN value < 5 THEN 'success' WHEN value > 200 THEN 'off_route' WHEN event_id % 100 = 0 THEN 'max_steps' ELSE 'running' END AS status FROM events")
def status_priority(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.when(v > 400, "collision").when(v < 5, "success").when(v > 200, "off_route").when(F.col("event_id") % 100 == 0, "max_steps").otherwise("running").alias("status"))
