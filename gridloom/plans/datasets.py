"""Supervised rows, scene metadata, names and meshes over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.functions import text as T
from gridloom.operators import mesh, rows
from gridloom.plans.catalogue import EV, events, query, table
from gridloom.sources import store

C = F.col
_r = lambda c, n=5: F.round(c, n) + 0.0
_STATES = "s AS (SELECT event_id, user_id, t, value / 10 AS x, CAST(event_id % 50 AS DOUBLE) AS y, CAST(event_id % 360 AS DOUBLE) AS yaw, value / 20 AS speed, event_type FROM ev)"
_WAYS = """n AS (SELECT user_id, t, x, y, lead(t) OVER o AS nt, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM s WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)
), q AS (SELECT s.*, k, t + k * 21600e0 AS at FROM s, (SELECT unnest([1, 2, 3, 4]) AS k)
), i AS (SELECT q.user_id, q.event_id, q.k, any_value(n.x + coalesce((q.at - n.t) / (n.nt - n.t) * (n.nx - n.x), 0) - q.x) AS dx, any_value(n.y + coalesce((q.at - n.t) / (n.nt - n.t) * (n.ny - n.y), 0) - q.y) AS dy, any_value(q.yaw) AS yaw, count(n.t) > 0 AS valid
  FROM q LEFT JOIN n ON n.user_id = q.user_id AND n.t <= q.at AND (n.nt > q.at OR (n.nt IS NULL AND n.t = q.at)) GROUP BY ALL
), ways AS (SELECT user_id, event_id, k, valid, CASE WHEN valid THEN cos(radians(yaw)) * dx + sin(radians(yaw)) * dy ELSE 0e0 END AS wx, CASE WHEN valid THEN cos(radians(yaw)) * dy - sin(radians(yaw)) * dx ELSE 0e0 END AS wy FROM i)"""
_ACCEL = """c AS (SELECT *, CASE WHEN lead(t) OVER o > t THEN (lead(speed) OVER o - speed) / (lead(t) OVER o - t) WHEN lead(t) OVER o IS NOT NULL THEN 0 END AS f, CASE WHEN t > lag(t) OVER o THEN (speed - lag(speed) OVER o) / (t - lag(t) OVER o) WHEN lag(t) OVER o IS NOT NULL THEN 0 END AS b FROM s WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)
), a AS (SELECT *, CASE WHEN f IS NOT NULL AND b IS NOT NULL THEN (f + b) / 2 ELSE coalesce(f, b, 0) END * 10000 AS accel FROM c)"""


def _states(spark, sf_dir):
    k = C("event_id")
    return events(spark, sf_dir).select("event_id", "user_id", "t", (C("value") / 10).alias("x"), (k % 50).cast("double").alias("y"), (k % 360).cast("double").alias("yaw"), (C("value") / 20).alias("speed"), "event_type")


@query(f"WITH {EV}, {_STATES}, {_WAYS} SELECT user_id, event_id, k, round(wx, 5) + 0 AS wx, round(wy, 5) + 0 AS wy, valid FROM ways")
def trajectory_targets(spark, sf_dir):
    out = rows.trajectory(_states(spark, sf_dir), "user_id", "event_id", "t", "x", "y", "yaw", 4, 21600.0)
    return out.select("user_id", "event_id", "k", _r(C("wx")).alias("wx"), _r(C("wy")).alias("wy"), "valid")


_LABELS = """CAST(stands AND front AS INTEGER) AS obstacle_stop, CAST(red AS INTEGER) AS red_stop, CAST(accel >= 0.5 AS INTEGER) AS accelerate, CAST(coalesce(lx > 0 AND abs(degrees(atan2(ly, lx))) <= 10, false) AS INTEGER) AS straight,
  CAST(coalesce(lx > 0 AND degrees(atan2(ly, lx)) < -10, false) AS INTEGER) AS "left", CAST(coalesce(lx > 0 AND degrees(atan2(ly, lx)) > 10, false) AS INTEGER) AS "right", CAST(accel <= -0.5 AS INTEGER) AS brake, CAST(stands AS INTEGER) AS stationary"""


@query(f"""WITH {EV}, {_STATES}, {_WAYS}, {_ACCEL}, l AS (SELECT user_id, event_id, arg_max(wx, k) FILTER (WHERE valid) AS lx, arg_max(wy, k) FILTER (WHERE valid) AS ly, count(*) FILTER (WHERE valid) AS n_valid, list(round(wx, 5) + 0 ORDER BY k) AS xs FROM ways GROUP BY user_id, event_id
), p AS (SELECT *, coalesce(lag(x) OVER o, x) AS ox, coalesce(lag(y) OVER o, y) AS oy, coalesce(lag(yaw) OVER o, yaw) AS ow, row_number() OVER o > 1 AS previous_valid FROM a WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)
), j AS (SELECT p.*, lx, ly, n_valid, xs, speed <= 0.5 AS stands, event_id % 7 = 0 AS front, event_type = 'error' AND (speed <= 0.5 OR event_id % 30 >= speed * 1 + speed * speed / 8 + 2) AS red FROM p JOIN l USING (user_id, event_id))
SELECT event_id, previous_valid, round(cos(radians(ow - yaw)), 5) + 0 AS m11, round(-sin(radians(ow - yaw)), 5) + 0 AS m12, round(cos(radians(yaw)) * (ox - x) + sin(radians(yaw)) * (oy - y), 5) + 0 AS tx, round(cos(radians(yaw)) * (oy - y) - sin(radians(yaw)) * (ox - x), 5) + 0 AS ty,
  round(list_sum(xs), 5) + 0 AS way_sum, n_valid, red AS red_stop_valid, {_LABELS} FROM j""")
def driving_rows(spark, sf_dir):
    # events are hours apart, so accelerations count by 10,000 seconds
    k = C("event_id")
    out = rows.driving_rows(_states(spark, sf_dir), "user_id", "event_id", "t", "x", "y", "yaw", "speed", 4, 21600.0, k % 7 == 0, C("event_type") == "error", (k % 30).cast("double"), 10000.0)
    total = F.aggregate("trajectory", F.lit(0.0), lambda a, p: a + F.round(p["wx"], 5))
    return out.select("event_id", "previous_valid", *(_r(C(c)).alias(c) for c in ("m11", "m12", "tx", "ty")), _r(total).alias("way_sum"), F.size(F.filter("trajectory", lambda p: p["valid"])).cast("long").alias("n_valid"), "red_stop_valid", *rows.BEHAVIOURS)


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, round((l_partkey % 256 / 255e0 - 0.485e0) / 0.229e0, 6) + 0 AS red, round((l_suppkey % 256 / 255e0 - 0.456e0) / 0.224e0, 6) + 0 AS green, round(ln(1 + least(l_quantity * 3, 100)) / 5, 6) AS depth_target, l_quantity * 3 > 0 AND l_quantity * 3 < 100 AS in_range, CASE WHEN l_linenumber IN (1, 4) THEN 255 ELSE l_linenumber END AS class FROM lineitem""")
def perception_rows(spark, sf_dir):
    out = rows.perception_rows(table(spark, sf_dir, "lineitem"), C("l_linenumber"), C("l_suppkey") % 256, C("l_partkey") % 256, C("l_quantity") * 3, C("l_linenumber"), 100.0, 0.2, [1, 4])
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice", _r(C("red"), 6).alias("red"), _r(C("green"), 6).alias("green"), F.round("depth_target", 6).alias("depth_target"), "in_range", "class")


@query("SELECT event_id, (event_type = 'error') AND event_id % 3 > 0 AND (value / 20 <= 0.5 OR event_id % 60 >= value / 20 * 1 + value / 20 * (value / 20) / 8 + 2) AS must_stop FROM events")
def red_stop_gate(spark, sf_dir):
    k = C("event_id")
    return table(spark, sf_dir, "events").select("event_id", S.red_stop(C("event_type") == "error", k % 3 > 0, C("value") / 20, k % 60).alias("must_stop"))


@query(f"""WITH {EV}, {_STATES}, d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER o) * (x - lag(x) OVER o) + (y - lag(y) OVER o) * (y - lag(y) OVER o)), 0) AS step FROM s WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)
), a AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS arc FROM d), n AS (SELECT *, lead(arc) OVER o AS narc, lead(x) OVER o AS nx, lead(y) OVER o AS ny FROM a WINDOW o AS (PARTITION BY user_id ORDER BY arc, event_id)
), e AS (SELECT user_id, last(x ORDER BY t, event_id) AS ex, last(y ORDER BY t, event_id) AS ey FROM s GROUP BY user_id)
SELECT a.event_id, round(any_value(coalesce(n.x + (a.arc + 40 - n.arc) / (n.narc - n.arc) * (n.nx - n.x), ex)), 4) + 0 AS tx, round(any_value(coalesce(n.y + (a.arc + 40 - n.arc) / (n.narc - n.arc) * (n.ny - n.y), ey)), 4) + 0 AS ty
FROM a JOIN e USING (user_id) LEFT JOIN n ON n.user_id = a.user_id AND n.arc <= a.arc + 40 AND n.narc > a.arc + 40 GROUP BY a.event_id""")
def target_points(spark, sf_dir):
    out = rows.target_points(_states(spark, sf_dir), "user_id", "event_id", "x", "y", "t", 40.0)
    return out.select("event_id", _r(C("tx"), 4).alias("tx"), _r(C("ty"), 4).alias("ty"))


# names, stores, sets


@query("""SELECT c_custkey, regexp_replace(c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '_Opt' ELSE '' END, '_Opt$', '') AS map, TRY_CAST(split_part(c_name || '_' || c_custkey, '_', 2) AS BIGINT) AS scene, 'scene_' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS folder, c_name LIKE '%7' AS derived,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS epoch, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END AS rank FROM customer""")
def scene_names(spark, sf_dir):
    k, name = C("c_custkey"), C("c_name")
    file = F.when(k % 3 == 0, F.concat(F.lit("run/epoch_"), k.cast("string"), F.lit(".pt"))).otherwise("run/last.pt")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", T.map_name(F.concat("c_mktsegment", F.when(k % 2 == 0, "_Opt").otherwise(""))).alias("map"), T.number_after(F.concat(name, F.lit("_"), k)).alias("scene"), T.padded("scene_", k).alias("folder"), name.endswith("7").alias("derived"),
        T.epoch_of(file).alias("epoch"), T.display_rank(C("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("rank"),
    )


@query("SELECT 'run/epoch-' || max(c_custkey) || '.pt' AS path, max(c_custkey) AS epoch FROM customer")
def latest_checkpoint(spark, sf_dir):
    return T.latest(table(spark, sf_dir, "customer").select(F.concat(F.lit("run/epoch-"), "c_custkey", F.lit(".pt")).alias("path")), "path")


@query("SELECT max(s_suppkey) + 1 AS next FROM supplier")
def next_scene(spark, sf_dir):
    return T.next_number(table(spark, sf_dir, "supplier").select(T.padded("scene_", C("s_suppkey")).alias("n")), "n")


@query("SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S') AS stamp FROM events")
def run_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.run_stamp(C("ts")).alias("stamp"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE o_orderstatus END AS status, o_orderpriority AS priority, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS n FROM orders")
def merged_metadata(spark, sf_dir):
    left = F.create_map(F.lit("status"), C("o_orderstatus"), F.lit("priority"), C("o_orderpriority"))
    right = F.when(C("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), F.lit("new"), F.lit("by"), F.lit("model"))).otherwise(F.create_map().cast("map<string,string>"))
    m = table(spark, sf_dir, "orders").select("o_orderkey", T.merged_maps(left, right).alias("m"))
    return m.select("o_orderkey", F.try_element_at("m", F.lit("status")).alias("status"), F.try_element_at("m", F.lit("priority")).alias("priority"), F.size("m").alias("n"))


@query("SELECT c_custkey, c_mktsegment AS map, CASE WHEN c_custkey % 5 = 0 THEN 'model' ELSE 'behavior_agent' END AS controller, c_nationkey AS start_idx, c_custkey % 9 AS end_idx FROM customer WHERE c_custkey % 7 > 0 AND (c_custkey % 5 > 0 OR c_custkey % 10 = 0)")
def scene_identities(spark, sf_dir):
    k = C("c_custkey")
    meta = table(spark, sf_dir, "customer").select("c_custkey", C("c_mktsegment").alias("map"), F.when(k % 5 == 0, "model").alias("controller"), F.when(k % 7 > 0, C("c_nationkey")).alias("start_idx"), (k % 9).alias("end_idx"), F.lit(None).cast("boolean").alias("complete"), (k % 10 == 0).alias("terminal"))
    return store.identities(meta, "c_custkey")


@query("SELECT user_id, count(*) AS n, CAST(min(event_id) AS BIGINT) AS first FROM events WHERE event_type = 'click' OR user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click') GROUP BY user_id")
def kinematics_fallback(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return store.with_fallback(ev.where("event_type = 'click'"), ev, "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40)) AS compatible, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS expected, round((SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40)) / (SELECT count(DISTINCT l_partkey) FROM lineitem), 6) AS coverage")
def compatible_share(spark, sf_dir):
    out = store.coverage(table(spark, sf_dir, "lineitem").select(C("l_partkey").alias("k")), table(spark, sf_dir, "part").where("p_size < 40").select(C("p_partkey").alias("k")))
    return out.withColumn("coverage", F.round("coverage", 6))


# meshes


_MESH = "f AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS face, l_partkey AS a, l_suppkey AS b, l_orderkey AS c FROM lineitem), v AS (SELECT o_orderkey AS v, CAST(o_orderkey % 37 AS DOUBLE) AS x, CAST(o_orderkey % 23 AS DOUBLE) AS y, CAST(o_custkey % 7 AS DOUBLE) AS z FROM orders)"


def _mesh(spark, sf_dir):
    k = C("o_orderkey")
    faces = table(spark, sf_dir, "lineitem").select((C("l_orderkey") * 10 + C("l_linenumber")).alias("face"), C("l_partkey").alias("a"), C("l_suppkey").alias("b"), C("l_orderkey").alias("c"))
    return mesh.distinct_faces(faces), table(spark, sf_dir, "orders").select(k.alias("v"), (k % 37).cast("double").alias("x"), (k % 23).cast("double").alias("y"), (C("o_custkey") % 7).cast("double").alias("z"))


@query(f"""WITH {_MESH}, j AS (SELECT f.*, vb.x - va.x AS ux, vb.y - va.y AS uy, vb.z - va.z AS uz, vc.x - va.x AS wx, vc.y - va.y AS wy, vc.z - va.z AS wz FROM f JOIN v va ON a = va.v JOIN v vb ON b = vb.v JOIN v vc ON c = vc.v
), n AS (SELECT unnest([a, b, c]) AS v, uy * wz - uz * wy AS x, uz * wx - ux * wz AS y, ux * wy - uy * wx AS z FROM j), s AS (SELECT v, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM n GROUP BY v)
SELECT v, round(x / greatest(sqrt(x * x + y * y + z * z), 1e-12), 6) + 0 AS nx, round(y / greatest(sqrt(x * x + y * y + z * z), 1e-12), 6) + 0 AS ny, round(z / greatest(sqrt(x * x + y * y + z * z), 1e-12), 6) + 0 AS nz FROM s""")
def vertex_normals(spark, sf_dir):
    return mesh.normals(*_mesh(spark, sf_dir)).select("v", *(_r(C(c), 6).alias(c) for c in ("nx", "ny", "nz")))


@query(f"WITH {_MESH} SELECT face, a, b, c FROM f WHERE a IN (SELECT v FROM v WHERE z < 5) AND b IN (SELECT v FROM v WHERE z < 5) AND c IN (SELECT v FROM v WHERE z < 5)")
def pruned_faces(spark, sf_dir):
    faces, vertices = _mesh(spark, sf_dir)
    return mesh.prune(faces, vertices.where("z < 5"))


@query(f"""WITH {_MESH}, m AS (SELECT v, min(v) OVER (PARTITION BY x, y, z) AS t, x, y, z FROM v), j AS (SELECT face, va.t AS a, vb.t AS b, vc.t AS c, vb.x - va.x AS ux, vb.y - va.y AS uy, vb.z - va.z AS uz, vc.x - va.x AS wx, vc.y - va.y AS wy, vc.z - va.z AS wz FROM f JOIN m va ON a = va.v JOIN m vb ON b = vb.v JOIN m vc ON c = vc.v
), k AS (SELECT face, list_sort([a, b, c]) AS s FROM j WHERE a <> b AND b <> c AND a <> c AND sqrt((uy * wz - uz * wy) * (uy * wz - uz * wy) + (uz * wx - ux * wz) * (uz * wx - ux * wz) + (ux * wy - uy * wx) * (ux * wy - uy * wx)) / 2 > 1e-9)
SELECT min(face) AS face, s[1] AS a, s[2] AS b, s[3] AS c FROM k GROUP BY s""")
def merged_mesh(spark, sf_dir):
    faces, _ = mesh.merged(*_mesh(spark, sf_dir), 1e-9)
    k = F.array_sort(F.array("a", "b", "c"))
    return faces.select("face", k[0].alias("a"), k[1].alias("b"), k[2].alias("c"))


@query("""WITH p AS (SELECT l_suppkey AS k, l_quantity AS x, l_discount * 300 AS y, l_tax * 100 + l_quantity / 5 AS z FROM lineitem), c AS (SELECT k, count(*) AS n, covar_pop(x, x) AS a, covar_pop(y, y) AS b, covar_pop(z, z) AS c, covar_pop(x, y) AS d, covar_pop(y, z) AS e, covar_pop(x, z) AS f FROM p GROUP BY k
), q AS (SELECT *, (a + b + c) / 3 AS q FROM c), r AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q
), s AS (SELECT *, ((a - q) * ((b - q) * (c - q) - e * e) - d * (d * (c - q) - e * f) + f * (d * e - (b - q) * f)) / (2 * p * p * p) AS r FROM r WHERE p > 0)
SELECT k, n, round(greatest(q + 2 * p * cos(acos(least(greatest(r, -1), 1)) / 3 + 2 * pi() / 3), 0), 4) AS least FROM s""")
def covariance_spread(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(C("l_suppkey").alias("k"), C("l_quantity").alias("x"), (C("l_discount") * 300).alias("y"), (C("l_tax") * 100 + C("l_quantity") / 5).alias("z"))
    return mesh.least_spread(points, "k", ["x", "y", "z"]).select("k", "n", F.round("least", 4).alias("least"))


@query("SELECT p_brand, count(*) FILTER (WHERE p_size < 10) AS poisson, count(*) FILTER (WHERE p_size >= 10 AND p_size < 20) AS donor, count(*) FILTER (WHERE p_size >= 20) AS box FROM part GROUP BY p_brand")
def method_histogram(spark, sf_dir):
    s = C("p_size")
    method = F.when(s < 10, "poisson").when(s < 20, "donor").otherwise("box")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(*(F.count_if(method == m).alias(m) for m in ("poisson", "donor", "box")))
