"""Losses, trajectory weights and scores over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions.scalar import smooth_l1
from gridloom.operators import losses
from gridloom.plans.catalogue import query, table

C = F.col
_r = lambda c, n=6: F.round(c + 1e-10, n) + 0.0
_BCE = lambda x, t: f"(greatest({x}, 0) - ({x}) * ({t}) + ln(1 + exp(-abs({x}))))"


@query(f"""WITH r AS (SELECT l_linenumber, l_extendedprice / 20000 - 2 AS x, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS t, CASE WHEN l_discount > 0.03::DOUBLE THEN 1e0 ELSE 0e0 END AS m, least(greatest(1 - (1 - 0.1e0) * l_quantity / 40, 0.1e0), 1) AS w FROM lineitem
), b AS (SELECT *, {_BCE('x', 't')} AS l FROM r)
SELECT l_linenumber, round(sum(l * m) / greatest(sum(m), 1) + 1e-10, 6) AS masked, round(sum(l * m * w) / greatest(sum(m * w), 1) + 1e-10, 6) AS weighted,
  round(sum(CASE WHEN t <= 0.5 THEN l * m ELSE 0 END) / greatest(sum(CASE WHEN t <= 0.5 THEN m ELSE 0 END), 1) * CASE WHEN sum(CASE WHEN t > 0.5 THEN m ELSE 0 END) > 0 THEN 0.5e0 ELSE 1 END
    + 0.5e0 * sum(CASE WHEN t > 0.5 THEN l * m ELSE 0 END) / greatest(sum(CASE WHEN t > 0.5 THEN m ELSE 0 END), 1) + 1e-10, 6) AS balanced FROM b GROUP BY l_linenumber""")
def binary_losses(spark, sf_dir):
    x, t, m = C("l_extendedprice") / 20000 - 2, (C("l_returnflag") == "R").cast("double"), (C("l_discount") > 0.03).cast("double")
    w = losses.distance_weight(C("l_quantity"), 40.0)
    loss = losses.bce(x, t)
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(_r(losses.masked_mean(loss, m)).alias("masked"), _r(losses.masked_mean(loss, m * w)).alias("weighted"), _r(losses.balanced_bce(x, t, m)).alias("balanced"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), l AS (SELECT label, vec_id % 7 AS g, -(x[label % 10 + 1] - list_max(x) - ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x)))))) AS ce, label % 10 AS k FROM e)
SELECT g, round(sum(CASE WHEN k = 9 THEN 0 ELSE ce END) / greatest(sum(CASE WHEN k = 9 THEN 0 ELSE 1 END), 1) + 1e-10, 6) AS semantic, round(sum(ce * CASE WHEN k = 0 THEN 0.1e0 ELSE 1 END) / greatest(count(*), 1) + 1e-10, 6) AS lane FROM l GROUP BY g""")
def class_losses(spark, sf_dir):
    x, k = F.slice(C("embedding").cast("array<double>"), 1, 10), C("label") % 10
    rows = table(spark, sf_dir, "embeddings").select((C("vec_id") % 7).alias("g"), k.alias("k"), losses.cross_entropy(x, k, ignore=9).alias("s"), losses.cross_entropy(x, k, [0.1] + [1.0] * 9).alias("l"))
    return rows.groupBy("g").agg(_r(losses.masked_mean(C("s"), (C("k") != 9).cast("double"))).alias("semantic"), _r(losses.masked_mean(C("l"), F.lit(1.0))).alias("lane"))


@query("""WITH v AS (SELECT l_linenumber, l_quantity - 20 AS px, l_discount * 100 - 5 AS py, CAST(l_partkey % 5 - 2 AS DOUBLE) AS tx, CAST(l_suppkey % 3 - 1 AS DOUBLE) AS ty, CASE WHEN l_returnflag <> 'N' THEN 1e0 ELSE 0e0 END AS m FROM lineitem
), d AS (SELECT *, CASE WHEN tx * tx + ty * ty > 1e-12 THEN 1 - (px * tx + py * ty) / (greatest(sqrt(px * px + py * py), 1e-6) * greatest(sqrt(tx * tx + ty * ty), 1e-6)) END AS l FROM v)
SELECT l_linenumber, round(coalesce(sum(l * m), 0) / greatest(sum(CASE WHEN l IS NULL THEN 0 ELSE m END), 1) + 1e-10, 6) AS loss FROM d GROUP BY l_linenumber""")
def direction_cosine(spark, sf_dir):
    loss = losses.direction_loss(C("l_quantity") - 20, C("l_discount") * 100 - 5, (C("l_partkey") % 5 - 2).cast("double"), (C("l_suppkey") % 3 - 1).cast("double"))
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", loss.alias("l"), (C("l_returnflag") != "N").cast("double").alias("m"))
    return rows.groupBy("l_linenumber").agg(_r(losses.masked_mean(F.coalesce("l", F.lit(0.0)), F.when(C("l").isNull(), 0.0).otherwise(C("m")))).alias("loss"))


_IMAGE = "i AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, CAST(unnest(embedding) AS DOUBLE) AS p FROM embeddings), m AS (SELECT vec_id, k // 8 AS r, k % 8 AS c, p * 3 AS p, CAST((vec_id + k) % 5 AS DOUBLE) / 2 AS t, CASE WHEN (vec_id * 3 + k) % 4 > 0 THEN 1e0 ELSE 0e0 END AS m FROM i)"


def _image(spark, sf_dir):
    k = C("k")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "p"))
    return rows.select("vec_id", F.floor(k / 8).alias("r"), (k % 8).alias("c"), (C("p").cast("double") * 3).alias("p"), (((C("vec_id") + k) % 5).cast("double") / 2).alias("t"), ((C("vec_id") * 3 + k) % 4 > 0).cast("double").alias("m"))


@query(f"""WITH {_IMAGE}, e AS (SELECT a.vec_id, (b.p - a.p) - (b.t - a.t) AS e, a.m * b.m AS m FROM m a JOIN m b ON a.vec_id = b.vec_id AND ((a.r = b.r AND b.c = a.c + 1) OR (a.c = b.c AND b.r = a.r + 1)))
SELECT vec_id, round(sum(CASE WHEN abs(e) < 1 THEN 0.5e0 * e * e ELSE abs(e) - 0.5e0 END * m) / greatest(sum(m), 1) + 1e-10, 6) AS loss FROM e GROUP BY vec_id""")
def gradient_l1(spark, sf_dir):
    out = losses.gradient_loss(_image(spark, sf_dir), ["vec_id"], "r", "c", "p", "t", "m")
    return out.select("vec_id", _r(C("loss")).alias("loss"))


@query(f"WITH {_IMAGE}, z AS (SELECT vec_id, ln(sum(exp(p - x))) + any_value(x) AS z FROM (SELECT *, max(p) OVER (PARTITION BY vec_id) AS x FROM m WHERE m > 0) GROUP BY vec_id) SELECT vec_id, round(sum(-t / greatest(s, 1) * (p - z)) + 1e-10, 6) AS loss FROM (SELECT *, sum(t) OVER (PARTITION BY vec_id) AS s FROM m WHERE m > 0) JOIN z USING (vec_id) GROUP BY vec_id")
def distribution_energy(spark, sf_dir):
    return losses.energy(_image(spark, sf_dir), "vec_id", "p", "t", "m").select("vec_id", _r(C("loss")).alias("loss"))


# trajectories: the lines of an order are its waypoints


_TRACK = "w AS (SELECT l_orderkey AS k, CAST(n AS INTEGER) AS n, n * 4 + l_quantity / 10 AS x, (l_partkey % 21 - 10) * 0.5e0 AS y, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE 1 END AS valid FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem))"
_WEIGHTS = f"""{_TRACK}, a AS (SELECT *, x - coalesce(lag(x) OVER o, 0) AS sx, y - coalesce(lag(y) OVER o, 0) AS sy, valid > 0 AND coalesce(lag(valid) OVER o, 1) > 0 AS ok FROM w WINDOW o AS (PARTITION BY k ORDER BY n)
), b AS (SELECT *, sqrt(sx * sx + sy * sy) AS len FROM a), c AS (SELECT *, sum(CASE WHEN ok THEN len ELSE 0 END) OVER (PARTITION BY k ORDER BY n ROWS UNBOUNDED PRECEDING) AS path, lead(sx) OVER o AS nx, lead(sy) OVER o AS ny, lead(len) OVER o AS nl, lead(ok) OVER o AS nok FROM b WINDOW o AS (PARTITION BY k ORDER BY n)
), d AS (SELECT *, CASE WHEN ok AND nok AND len > 1e-6 AND nl > 1e-6 THEN acos(least(greatest((sx * nx + sy * ny) / (len * nl), -1), 1)) ELSE 0 END AS turn FROM c
), weighted AS (SELECT k, n, x, y, valid, CASE WHEN valid > 0 THEN (0.2e0 + 0.8e0 * exp(-path / 20)) * (1 + 2 * least(turn / radians(30), 1)) ELSE 0e0 END AS weight FROM d)"""


def _weighted(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").withColumn("n", place).select(
        C("l_orderkey").alias("k"), "n", (C("n") * 4 + C("l_quantity") / 10).alias("x"), ((C("l_partkey") % 21 - 10) * 0.5).alias("y"), F.when(C("l_suppkey") % 9 == 0, 0).otherwise(1).alias("valid"),
    )
    return losses.waypoint_weights(rows, "x", "y", "valid", _order(), 0.2, 20.0, 2.0, 30.0)


def _order():
    return Window.partitionBy("k").orderBy("n")


@query(f"WITH {_WEIGHTS} SELECT k, n, round(weight, 5) AS weight FROM weighted")
def waypoint_weights(spark, sf_dir):
    return _weighted(spark, sf_dir).select("k", "n", F.round("weight", 5).alias("weight"))


_MODES = f"{_WEIGHTS}, z AS (SELECT k, n, weight, g AS mode, x * (g - 1) * 0.1e0 AS ex, CAST((k + g) % 3 - 1 AS DOUBLE) AS ey FROM weighted, (SELECT unnest([0, 1, 2, 3]) AS g)), cost AS (SELECT k, mode, round(sum(sqrt(ex * ex + ey * ey) * weight) / greatest(sum(weight), 1), 9) AS cost FROM z GROUP BY k, mode), best AS (SELECT k, mode FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cost, mode) AS rn FROM cost) WHERE rn = 1)"


@query(f"""WITH {_MODES}, p AS (SELECT z.k, z.mode, sum((CASE WHEN abs(ex) < 1 THEN 0.5e0 * ex * ex ELSE abs(ex) - 0.5e0 END + CASE WHEN abs(ey) < 1 THEN 0.5e0 * ey * ey ELSE abs(ey) - 0.5e0 END) * weight) AS l, sum(weight) AS w, CASE WHEN z.mode = any_value(best.mode) THEN 1e0 ELSE 0.1e0 END AS s FROM z JOIN best USING (k) GROUP BY z.k, z.mode)
SELECT k, best.mode, round(sum(l * s) / greatest(max(w) * sum(s), 1) + 1e-9, 5) AS loss FROM p JOIN best USING (k) GROUP BY k, best.mode""")
def trajectory_matching(spark, sf_dir):
    rows = _weighted(spark, sf_dir).withColumn("mode", F.explode(F.array(*map(F.lit, range(4)))))
    rows = rows.select("k", "n", "weight", "mode", (C("x") * (C("mode") - 1) * 0.1).alias("ex"), ((C("k") + C("mode")) % 3 - 1).cast("double").alias("ey"))
    out = losses.matched_losses(rows, "k", "mode", "weight", F.sqrt(C("ex") * C("ex") + C("ey") * C("ey")), smooth_l1(C("ex")) + smooth_l1(C("ey")), 0.1)
    return out.select("k", "mode", F.round(C("loss") + 1e-9, 5).alias("loss"))


@query(f"""WITH {_TRACK}, t AS (SELECT *, lag(x) OVER o AS bx, lag(y) OVER o AS by_, lead(x) OVER o AS ax, lead(y) OVER o AS ay FROM w WINDOW o AS (PARTITION BY k ORDER BY n)
), u AS (SELECT *, CASE WHEN bx IS NULL THEN x WHEN ax IS NULL THEN x - bx ELSE ax - bx END AS tx, CASE WHEN by_ IS NULL THEN y WHEN ay IS NULL THEN y - by_ ELSE ay - by_ END AS ty FROM t
), v AS (SELECT k, n, x, y, CASE WHEN sqrt(tx * tx + ty * ty) > 1e-6 THEN tx / sqrt(tx * tx + ty * ty) ELSE 1 END AS tx, CASE WHEN sqrt(tx * tx + ty * ty) > 1e-6 THEN ty / sqrt(tx * tx + ty * ty) ELSE 0 END AS ty FROM u
), f AS (SELECT k, n, x, x + i * 2.4e0 * tx - j * 1.1e0 * ty AS fx, y + i * 2.4e0 * ty + j * 1.1e0 * tx AS fy FROM v, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j))
SELECT k, n, round(max(greatest(0 - x, 0) + greatest(fx - 30, 0) + greatest(-4 - fy, 0) + greatest(fy - 4, 0)), 6) + 0 AS loss FROM f GROUP BY k, n""")
def boundary_overflow(spark, sf_dir):
    out = losses.worst_footprint(_weighted(spark, sf_dir), "x", "y", _order(), F.lit(2.4), F.lit(1.1), lambda fx, fy: losses.outside(fx, fy, C("x"), (0.0, 30.0), (-4.0, 4.0)), "loss")
    return out.select("k", "n", (F.round("loss", 6) + 0.0).alias("loss"))


@query(f"WITH {_TRACK} SELECT k, round(max(greatest((x - 18) * cos(0.3e0) + (y - 1) * sin(0.3e0) + 0.5e0, 0)) + 1e-10, 6) AS loss FROM w GROUP BY k")
def stop_line_crossing(spark, sf_dir):
    dx, dy = C("x") - 18, C("y") - 1
    return _weighted(spark, sf_dir).groupBy("k").agg(_r(F.max(losses.stop_crossing(dx, dy, F.cos(F.lit(0.3)), F.sin(F.lit(0.3)), 0.5))).alias("loss"))


_FIELD = "f AS (SELECT vec_id AS g, (generate_subscripts(embedding, 1) - 1) // 8 AS r, (generate_subscripts(embedding, 1) - 1) % 8 AS c, abs(CAST(unnest(embedding) AS DOUBLE)) AS v FROM embeddings)"


@query(f"""WITH {_TRACK}, {_FIELD}, q AS (SELECT k, n, k % 100 AS g, least(greatest(x / 4 - 0.5, 0), 7) AS pr, least(greatest(y + 4 - 0.5, 0), 7) AS pc FROM w
), s AS (SELECT k, n, g, CAST(least(floor(pr) + i, 7) AS BIGINT) AS r, CAST(least(floor(pc) + j, 7) AS BIGINT) AS c, CASE WHEN i = 1 THEN pr - floor(pr) ELSE 1 - (pr - floor(pr)) END * CASE WHEN j = 1 THEN pc - floor(pc) ELSE 1 - (pc - floor(pc)) END AS s FROM q, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT k, n, round(sum(s * v), 6) AS distance FROM s JOIN f USING (g, r, c) GROUP BY k, n""")
def centreline_distance(spark, sf_dir):
    field = table(spark, sf_dir, "embeddings").select(C("vec_id").alias("g"), F.posexplode("embedding").alias("p", "v")).select("g", F.floor(C("p") / 8).alias("row"), (C("p") % 8).alias("col"), F.abs(C("v").cast("double")).alias("v"))
    rows = _weighted(spark, sf_dir).select("k", "n", (C("k") % 100).alias("g"), "x", "y")
    out = losses.bilinear(rows, field, ["g"], C("x") / 4, C("y") + 4, 8, 8, "v")
    return out.select("k", "n", F.round("sampled", 6).alias("distance"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS mode, round(1e0 * l_quantity / 50 - 0.5e0 * l_discount - 0.25e0 * (1 - l_tax) - 0.3e0 * (1 - cos(radians(l_partkey % 360))), 9) AS score FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, mode) AS rank FROM s)
SELECT l_orderkey, mode, round(max(score) OVER (PARTITION BY l_orderkey), 6) AS top, rank FROM r""")
def candidate_ranking(spark, sf_dir):
    score = C("l_quantity") / 50 - 0.5 * C("l_discount") - 0.25 * (1 - C("l_tax")) - 0.3 * (1 - F.cos(F.radians(C("l_partkey") % 360)))
    out = losses.candidate_scores(table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "mode"), "l_orderkey", "mode", score)
    return out.select("l_orderkey", "mode", F.round(F.max("score").over(Window.partitionBy("l_orderkey")), 6).alias("top"), C("rank").cast("long").alias("rank"))


@query(f"""WITH {_TRACK}, v AS (SELECT k, row_number() OVER o AS i, sqrt((x - coalesce(lag(x) OVER o, 0)) ** 2 + (y - coalesce(lag(y) OVER o, 0)) ** 2) / 0.5e0 AS v FROM w WINDOW o AS (PARTITION BY k ORDER BY n))
SELECT k, round(least(greatest(median(v), 1e0), 14e0), 6) AS speed FROM v WHERE i <= 4 GROUP BY k""")
def median_speed(spark, sf_dir):
    return losses.target_speed("x", "y", _weighted(spark, sf_dir), "k", "n", 4, 0.5, 1.0, 14.0).select("k", F.round("speed", 6).alias("speed"))
