"""Scalars, frames and filters over whole tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import scalar as S
from gridloom.plans.catalogue import query, table

C = F.col
D = lambda c: F.col(c).cast("double")


def _r(c, n=6):
    return F.round(c, n) + 0.0


@query("""SELECT p_partkey, round((p_size + (p_partkey % 256) * 256e0 + (p_partkey % 7) * 65536e0) / 16777215 * 1000, 6) AS depth, round((p_partkey % 256 / 255e0 - 0.485e0) / 0.229e0, 6) + 0 AS red,
  round(least(greatest(p_size / 40e0, 0), 1), 6) AS linear, round(ln(least(greatest(p_size, 1e0), 40e0)) / ln(40e0), 6) AS log, round(p_size / 3.6e0, 6) AS limit_mps FROM part""")
def image_scalars(spark, sf_dir):
    k, s = C("p_partkey"), D("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", _r(S.depth_from_bgr(k % 7, k % 256, s)).alias("depth"), _r(S.normalise_channel(k % 256, 0.485, 0.229)).alias("red"), _r(S.depth_share(s, 40.0)).alias("linear"), _r(S.depth_share(s, 40.0, True)).alias("log"), _r(S.speed_limit(s)).alias("limit_mps"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, (l_linenumber * 64 + l_suppkey % 64) * CAST(128 AS BIGINT) + l_orderkey % 128 AS key FROM lineitem)
SELECT l_orderkey, l_linenumber, key, CAST(floor(key / 8192e0) AS BIGINT) AS x, CAST(floor(key / 128e0) AS BIGINT) % 64 - 10 AS y, key % 128 AS z, l_orderkey * 4294967296 + l_linenumber AS packed FROM k""")
def voxel_keys(spark, sf_dir):
    low, size = [0, -10, 0], [100, 64, 128]
    rows = table(spark, sf_dir, "lineitem").withColumn("key", S.voxel_key([C("l_linenumber"), C("l_suppkey") % 64 - 10, C("l_orderkey") % 128], low, size))
    x, y, z = S.voxel_cell(C("key"), low, size)
    return rows.select("l_orderkey", "l_linenumber", "key", x.cast("long").alias("x"), y.cast("long").alias("y"), z.cast("long").alias("z"), S.packed_key(C("l_orderkey"), C("l_linenumber")).alias("packed"))


@query("""WITH h AS (SELECT p_partkey, (p_partkey * 0.6180339887498949e0 - floor(p_partkey * 0.6180339887498949e0)) * 6 AS h FROM part), s AS (SELECT *, CAST(floor(h) AS INTEGER) AS i, h - floor(h) AS f, 0.95e0 AS v, 0.95e0 * 0.35e0 AS p FROM h)
SELECT p_partkey, round(CASE i WHEN 0 THEN v WHEN 1 THEN v * (1 - 0.65e0 * f) WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN v * (1 - 0.65e0 * (1 - f)) ELSE v END, 6) AS r, round(CASE i WHEN 0 THEN v * (1 - 0.65e0 * (1 - f)) WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN v * (1 - 0.65e0 * f) ELSE p END, 6) AS g,
  round(CASE i WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN v * (1 - 0.65e0 * (1 - f)) WHEN 3 THEN v WHEN 4 THEN v ELSE v * (1 - 0.65e0 * f) END, 6) AS b FROM s""")
def actor_hues(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", *(_r(c).alias(n) for c, n in zip(S.golden_hue(C("p_partkey")), "rgb")))


@query("""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT vec_id, max(x) AS m FROM e GROUP BY vec_id), z AS (SELECT vec_id, sum(exp(x - m)) AS z FROM e JOIN m USING (vec_id) GROUP BY vec_id)
SELECT vec_id, min(k) FILTER (WHERE x = m) AS mode, round(max(exp(x - m) / z), 6) AS p, round(1 / (1 + exp(-any_value(m))), 6) AS top FROM e JOIN m USING (vec_id) JOIN z USING (vec_id) GROUP BY vec_id""")
def mode_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", C("embedding").cast("array<double>").alias("x"))
    return rows.select("vec_id", S.argmax(C("x")).alias("mode"), _r(F.array_max(S.softmax(C("x")))).alias("p"), _r(S.sigmoid(F.array_max("x"))).alias("top"))


_XY = "l_quantity - 20 AS x, l_discount * 100 - 5 AS y, l_tax * 10 AS z, CAST(l_partkey % 360 AS DOUBLE) AS yaw"


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_XY}, CAST(l_suppkey % 360 AS DOUBLE) AS yaw0 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(cos(radians(yaw)) * x + sin(radians(yaw)) * y, 4) + 0 AS ahead, round(cos(radians(yaw)) * y - sin(radians(yaw)) * x, 4) + 0 AS aside,
  round(cos(radians(yaw0 - yaw)), 6) + 0 AS m11, round(-sin(radians(yaw0 - yaw)), 6) + 0 AS m12, round(cos(radians(yaw)) * (x - 3) + sin(radians(yaw)) * (y - 1), 4) + 0 AS tx, round(cos(radians(yaw)) * (y - 1) - sin(radians(yaw)) * (x - 3), 4) + 0 AS ty FROM p""")
def planar_frames(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (C("l_quantity") - 20).alias("x"), (C("l_discount") * 100 - 5).alias("y"), (C("l_partkey") % 360).cast("double").alias("yaw"), (C("l_suppkey") % 360).cast("double").alias("yaw0"))
    a, b = G.to_ego(C("x"), C("y"), C("yaw"))
    m = G.planar_previous_to_current((C("x"), C("y"), C("yaw0")), (F.lit(3.0), F.lit(1.0), C("yaw")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", _r(a, 4).alias("ahead"), _r(b, 4).alias("aside"), _r(m["m11"]).alias("m11"), _r(m["m12"]).alias("m12"), _r(m["tx"], 4).alias("tx"), _r(m["ty"], 4).alias("ty"))


@query("""WITH p AS (SELECT p_partkey, radians(p_partkey % 360) AS a, p_size - 25e0 AS x, p_retailprice / 100 - 10 AS y, 1e0 AS z FROM part), e AS (SELECT *, cos(a) * (x - 2) + sin(a) * (y + 1) AS ex, cos(a) * (y + 1) - sin(a) * (x - 2) AS ey, z - 0.5e0 AS ez FROM p)
SELECT p_partkey, round(cos(radians(30)) * (ex - 1.5e0) + sin(radians(30)) * ey, 4) + 0 AS cx, round(cos(radians(30)) * ey - sin(radians(30)) * (ex - 1.5e0), 4) + 0 AS cy, round(ez - 2, 4) + 0 AS cz FROM e""")
def camera_points(spark, sf_dir):
    zero = F.lit(0.0)
    p = (C("p_size") - 25.0, C("p_retailprice") / 100 - 10, F.lit(1.0))
    out = G.to_camera(p, (F.lit(2.0), F.lit(-1.0), F.lit(0.5)), G.rotation(zero, zero, (C("p_partkey") % 360).cast("double")), (F.lit(1.5), zero, F.lit(2.0)), G.rotation(zero, zero, F.lit(30.0)))
    return table(spark, sf_dir, "part").select("p_partkey", *(_r(c, 4).alias(n) for c, n in zip(out, ("cx", "cy", "cz"))))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, {_XY} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, abs(x) > 2.5e0 OR abs(y) > 1e0 OR abs(z) > 0.75e0 AS outside, x >= -10 AND x < 20 AND y >= -4 AND y < 4 AND z >= 0 AND z < 0.7e0 AS inside, l_returnflag IN ('A', 'R') AS moving,
  cos(radians(yaw)) * x + sin(radians(yaw)) * y BETWEEN 0 AND 16 AND cos(radians(yaw)) * y - sin(radians(yaw)) * x BETWEEN -8 AND 8 AS around, round((1 - x / 64) * 256, 4) AS px_row, round((y + 32) / 64 * 256, 4) AS px_col, x > 0 AND abs(degrees(atan2(y, greatest(x, 1e-3)))) <= 45 AS seen FROM p""")
def point_filters(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("*", (C("l_quantity") - 20).alias("x"), (C("l_discount") * 100 - 5).alias("y"), (C("l_tax") * 10).alias("z"), (C("l_partkey") % 360).cast("double").alias("yaw"))
    p = (C("x"), C("y"), C("z"))
    row, col = G.bev_pixel(C("x"), C("y"), 256, 256, (0.0, 64.0), (-32.0, 32.0))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", G.outside_box(p, (2.5, 1.0, 0.75)).alias("outside"), G.in_range(p, (-10, -4, 0), (20, 4, 0.7)).alias("inside"), C("l_returnflag").isin("A", "R").alias("moving"),
        G.in_ego_rectangle(C("x"), C("y"), C("yaw"), (0, 16), (-8, 8)).alias("around"), F.round(row, 4).alias("px_row"), F.round(col, 4).alias("px_col"), G.in_view(C("x"), C("y"), 90.0).alias("seen"),
    )


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_XY} FROM lineitem), q AS (SELECT *, sqrt(x * x + y * y) AS n FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, n <= 10 AS near, n < 0.001e0 OR (n < 25 AND degrees(acos(least(greatest((cos(radians(yaw)) * x + sin(radians(yaw)) * y) / CASE WHEN n = 0 THEN 1 ELSE n END, -1), 1))) > 0 AND degrees(acos(least(greatest((cos(radians(yaw)) * x + sin(radians(yaw)) * y) / CASE WHEN n = 0 THEN 1 ELSE n END, -1), 1))) < 60) AS ahead FROM q""")
def agent_distance_tests(spark, sf_dir):
    x, y = C("l_quantity") - 20, C("l_discount") * 100 - 5
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", S.within_radius(x, y, 10.0).alias("near"), S.is_within(x, y, (C("l_partkey") % 360).cast("double"), 25.0, 0.0, 60.0).alias("ahead"))


_BACK = "WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity AS d, l_partkey % 640 AS u, l_suppkey % 480 AS v FROM lineitem), q AS (SELECT *, (u - 320) * d / 320e0 AS right_, -(v - 240) * d / 320e0 AS up FROM p)"


@query(_BACK + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(d, 4) AS ahead, round(right_, 4) + 0 AS aside, round(up, 4) + 0 AS up, round(sqrt(d * d + right_ * right_), 4) AS reach, d > 0.1e0 AND d < 40 AND abs(degrees(atan2(right_, d))) <= 40 AS valid FROM q")
def depth_back_projection(spark, sf_dir):
    x, y, z = G.back_projection(C("l_partkey") % 640, C("l_suppkey") % 480, C("l_quantity"), 320.0, 320.0, 320.0, 240.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(x, 4).alias("ahead"), _r(y, 4).alias("aside"), _r(z, 4).alias("up"), F.round(F.hypot(x, y), 4).alias("reach"), G.depth_point_valid(x, y, C("l_quantity"), 40.0, 80.0).alias("valid"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 4 END AS class, CASE o_orderkey % 4 WHEN 0 THEN 'Road' WHEN 1 THEN 'Sign' ELSE 'Unknown-' || CAST(o_orderkey % 4 AS VARCHAR) END AS tag,
  printf('%5.1f / %3.0f km/h  T %.2f  %s', o_orderkey % 30 * 3.6e0, o_orderkey % 20 * 3.6e0, o_orderkey % 10 / 10e0, upper(o_orderstatus)) AS hud, CASE WHEN d < 35 OR d > 145 THEN 'straight' WHEN d > 90 THEN 'left' ELSE 'right' END AS option FROM (SELECT *, (o_custkey * 7 - o_orderkey % 360) % 180 + CASE WHEN (o_custkey * 7 - o_orderkey % 360) % 180 < 0 THEN 180 ELSE 0 END AS d FROM orders)""")
def labels_and_text(spark, sf_dir):
    k = C("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", S.label(C("o_orderpriority"), {"1-URGENT": 1, "2-HIGH": 2}, 4).alias("class"), S.tag_name((k % 4).cast("int"), {0: "Road", 1: "Sign"}).alias("tag"),
        S.hud_line((k % 30).cast("double"), (k % 20).cast("double"), k % 10 / 10.0, C("o_orderstatus")).alias("hud"), S.waypoint_option(k % 360, C("o_custkey") * 7).alias("option"),
    )


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn FROM lineitem WHERE l_returnflag <> 'R'), a AS (SELECT l_orderkey, l_quantity - 10 AS x, l_discount * 100 - 5 AS y FROM r WHERE rn = 1)
SELECT o_orderkey, CASE WHEN x > 0 AND abs(degrees(atan2(y, x))) <= 10 THEN 1 ELSE 0 END AS straight, CASE WHEN x > 0 AND degrees(atan2(y, x)) < -10 THEN 1 ELSE 0 END AS left_, CASE WHEN x > 0 AND degrees(atan2(y, x)) > 10 THEN 1 ELSE 0 END AS right_ FROM orders LEFT JOIN a ON o_orderkey = l_orderkey""")
def direction_labels(spark, sf_dir):
    """One-hot directions by the last valid waypoint of each order."""
    valid = table(spark, sf_dir, "lineitem").where("l_returnflag != 'R'")
    last = valid.groupBy("l_orderkey").agg(F.max_by(F.struct((C("l_quantity") - 10).alias("x"), (C("l_discount") * 100 - 5).alias("y")), F.struct("l_linenumber", "l_partkey", "l_extendedprice")).alias("p"))
    rows = table(spark, sf_dir, "orders").join(last, C("o_orderkey") == C("l_orderkey"), "left")
    return rows.select("o_orderkey", *(c.alias(n) for c, n in zip(S.one_hot_direction(C("p.x"), C("p.y")), ("straight", "left_", "right_"))))


@query(f"SELECT n_nationkey AS k, round(-90 + 180 * (n_nationkey + 0.5e0) / 25, 6) AS angle, round(2 * (pow(1.2e0, n_nationkey) - 1) / 0.2e0 + 1, 4) AS depth FROM nation WHERE 2 * (pow(1.2e0, n_nationkey) - 1) / 0.2e0 + 1 <= {2 * (1.2**30 - 1) / 0.2}")
def sector_and_depth_baselines(spark, sf_dir):
    angles, depths = S.sectors(25, 180.0), S.growing_depths(1.0, 2.0, 1.2, 1e9)
    pick = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs[:25])), C("n_nationkey") + 1)
    return table(spark, sf_dir, "nation").select(C("n_nationkey").alias("k"), F.round(pick(angles), 6).alias("angle"), F.round(pick(depths), 4).alias("depth"))


@query("""WITH a AS (SELECT s_suppkey AS i, s_acctbal AS x0, s_nationkey * 100e0 AS y0, s_acctbal + 400 AS x1, s_nationkey * 100e0 + 150 AS y1 FROM supplier), n AS (SELECT n_nationkey AS j, n_nationkey * 300e0 AS x, n_nationkey * 100e0 AS y FROM nation)
SELECT i, j, (x0 <= x + 200 AND x1 >= x AND y0 <= y + 100 AND y1 >= y) AS meets, sqrt(pow((x0 + x1) / 2 - x, 2) + pow((y0 + y1) / 2 - y, 2)) - sqrt(pow(200, 2) + pow(75, 2)) < 300 AS reaches FROM a JOIN n ON x0 <= x + 600 AND x1 >= x - 600 AND CAST(y0 / 100 AS BIGINT) = j""")
def window_filters(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("i"), C("s_acctbal").alias("x0"), (C("s_nationkey") * 100.0).alias("y0"), (C("s_acctbal") + 400).alias("x1"), (C("s_nationkey") * 100.0 + 150).alias("y1"), C("s_nationkey").alias("j"))
    n = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("j"), (C("n_nationkey") * 300.0).alias("x"), (C("n_nationkey") * 100.0).alias("y"))
    near = a.join(n, "j").where((C("x0") <= C("x") + 600) & (C("x1") >= C("x") - 600))
    return near.select("i", "j", G.boxes_overlap((C("x0"), C("y0"), C("x1"), C("y1")), (C("x"), C("y"), C("x") + 200, C("y") + 100)).alias("meets"), G.circle_reaches((C("x0") + C("x1")) / 2, (C("y0") + C("y1")) / 2, F.lit(math.hypot(200, 75)), C("x"), C("y"), 300.0).alias("reaches"))
