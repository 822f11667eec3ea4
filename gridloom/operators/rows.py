"""Supervised rows: waypoints of the future, behaviour labels, previous frames, red stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions import geometry as G
from gridloom.functions import scalar as S
from gridloom.operators import joins, series

C = F.col
BEHAVIOURS = ("obstacle_stop", "red_stop", "accelerate", "straight", "left", "right", "brake", "stationary")


def trajectory(states: DataFrame, key: str, frame: str, t: str, x: str, y: str, yaw: str, count: int, dt: float) -> DataFrame:
    """(key, frame, k, wx, wy, valid): ``count`` waypoints of each frame, ``dt`` apart, in the frame's own axes.

    Positions are interpolated in the key's series; beyond its last time a waypoint is (0, 0) and not valid.
    """
    asks = states.select(key, C(frame), C(x).alias("_x0"), C(y).alias("_y0"), C(yaw).alias("_w"), C(t).alias("_t"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("k")).withColumn("_at", C("_t") + C("k") * dt)
    at = joins.asof_lerp(states.select(key, t, x, y, frame), asks, key, t, "_at", [x, y], frame)
    a, b = G.to_ego(C(x) - C("_x0"), C(y) - C("_y0"), C("_w"))
    ok = C(x).isNotNull()
    return at.select(key, frame, "k", F.when(ok, a).otherwise(0.0).alias("wx"), F.when(ok, b).otherwise(0.0).alias("wy"), ok.alias("valid"))


def last_valid(waypoints: DataFrame, key: str, frame: str) -> DataFrame:
    """(key, frame, lx, ly, n_valid): the farthest valid waypoint; nulls without any."""
    last = F.max(F.when(C("valid"), F.struct("k", "wx", "wy")))
    return waypoints.groupBy(key, frame).agg(last.alias("m"), F.count_if("valid").alias("n_valid")).select(key, frame, C("m.wx").alias("lx"), C("m.wy").alias("ly"), "n_valid")


def behaviours(speed: Column, accel: Column, lx: Column, ly: Column, front: Column, red: Column, still: float = 0.5, jolt: float = 0.5, turn: float = 10.0) -> list[Column]:
    """The eight labels, in the order of ``BEHAVIOURS``. A stop for an obstacle only while standing; a red one while it is relevant."""
    stands = speed <= still
    angle = F.degrees(F.atan2(ly, lx))
    ahead = F.coalesce(lx > 0, F.lit(False))
    way = [ahead & (F.abs(angle) <= turn), ahead & (angle < -turn), ahead & (angle > turn)]
    flags = [stands & front, red, accel >= jolt, *way, accel <= -jolt, stands]
    return [F.coalesce(f, F.lit(False)).cast("int").alias(n) for f, n in zip(flags, BEHAVIOURS)]


def with_previous(frames: DataFrame, w: WindowSpec, pose: tuple[str, str, str], back: int = 1) -> DataFrame:
    """Adds previous_valid and m11, m12, m21, m22, tx, ty from the frame ``back`` before; the first ones have themselves and the identity."""
    rows, olds = frames, []
    for c in pose:
        old, valid = series.previous(C(c), w, back)
        rows = rows.withColumn(f"_p{c}", old)
        olds.append(C(f"_p{c}"))
    rows = rows.withColumn("previous_valid", F.row_number().over(w) > back)
    m = G.planar_previous_to_current(tuple(olds), tuple(C(c) for c in pose))
    return rows.withColumns(m).drop(*(f"_p{c}" for c in pose))


def driving_rows(states: DataFrame, key: str, frame: str, t: str, x: str, y: str, yaw: str, speed: str, count: int, dt: float, front: Column, red: Column, distance: Column, unit: float = 1.0) -> DataFrame:
    """One supervised row a frame: the previous frame's transform, waypoints as an array, labels, and the red stop that still can be made.

    Accelerations count by ``unit`` of the time; times stay as they are, since scaled ones round otherwise.
    """
    w = Window.partitionBy(key).orderBy(t, frame)
    base = with_previous(states, w, (x, y, yaw)).withColumns({"_a": series.acceleration(C(speed), C(t), w) * unit, "_front": front, "red_stop_valid": S.red_stop(red, F.lit(True), C(speed), distance)})
    ways = trajectory(states, key, frame, t, x, y, yaw, count, dt)
    each = ways.groupBy(key, frame).agg(F.array_sort(F.collect_list(F.struct("k", "wx", "wy", "valid"))).alias("trajectory"))
    last = F.element_at(F.filter("trajectory", lambda p: p["valid"]), -1)
    rows = base.join(each, [key, frame]).withColumn("_l", F.when(F.exists("trajectory", lambda p: p["valid"]), last))
    labels = behaviours(C(speed), C("_a"), C("_l.wx"), C("_l.wy"), C("_front"), C("red_stop_valid"))
    return rows.select(*(c for c in rows.columns if not c.startswith("_")), *labels)


def perception_rows(pixels: DataFrame, b: Column, g: Column, r: Column, depth: Column, tag: Column, most: float, scale: float, ignore: list[int], ignored: int = 255) -> DataFrame:
    """Adds red, green, blue (normalised), depth_target, in_range and the class; tags to ignore become ``ignored``."""
    means, stds = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
    rgb = {n: S.normalise_channel(c, m, d) for n, c, m, d in zip(("red", "green", "blue"), (r, g, b), means, stds)}
    return pixels.withColumns({**rgb, "depth_target": S.symlog(F.least(depth, F.lit(most)), scale), "in_range": (depth > 0) & (depth < most), "class": F.when(tag.isin(ignore), ignored).otherwise(tag)})


def target_points(states: DataFrame, key: str, frame: str, x: str, y: str, t: str, ahead: float) -> DataFrame:
    """(key, frame, tx, ty): the place ``ahead`` along the future track, or the last one of the key."""
    w = Window.partitionBy(key).orderBy(t, frame)
    arcs = series.arc_length(states, C(x), C(y), w, "_s").withColumn("_ask", C("_s") + ahead)
    # along the track the arc never falls, so the next row past the ask is found in one order of arcs
    asks = arcs.select(key, frame, C("_ask").alias("_at"))
    at = joins.asof_lerp(arcs.select(key, "_s", x, y, frame), asks, key, "_s", "_at", [x, y], frame)
    end = arcs.groupBy(key).agg(F.max_by(F.struct(x, y), F.struct(t, frame)).alias("_e"))
    return at.join(end, key).select(key, frame, F.coalesce(x, f"_e.{x}").alias("tx"), F.coalesce(y, f"_e.{y}").alias("ty"))
