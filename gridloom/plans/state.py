"""State machines over each user's events, with recursive SQL that steps through the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.operators import series
from gridloom.plans.catalogue import EV, W, events, query
from gridloom.streaming import machines

C = F.col
ROUTE = [(20.0 * k, 5.0 * (k % 3)) for k in range(30)]
_ARC = [0.0]
for (_ax, _ay), (_bx, _by) in zip(ROUTE, ROUTE[1:]):
    _ARC.append(_ARC[-1] + math.sqrt((_bx - _ax) * (_bx - _ax) + (_by - _ay) * (_by - _ay)))
_list = lambda xs: "[" + ", ".join(f"{x!r}::DOUBLE" for x in xs) + "]"
_RX, _RY, _RA = _list([p[0] for p in ROUTE]), _list([p[1] for p in ROUTE]), _list(_ARC)
_KEYS = "user_id AS key, event_id, t"


def _rows(spark, sf_dir, **extra):
    return events(spark, sf_dir).select(C("user_id").alias("key"), "t", "event_id", *(c.alias(n) for n, c in extra.items()))


def _fold(rows, machine):
    return machines.fold(rows, "key", ["t", "event_id"], machine)


def _recursive(inputs: str, start: str, step: str, out: str, going: str = "true") -> str:
    """Steps of a machine: ``start`` names its state, ``step`` the next one from m (state) and r (row)."""
    return f"""WITH RECURSIVE {EV}, r AS (SELECT {_KEYS}, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn, {inputs} FROM ev
), m AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS rn, CAST(-1 AS BIGINT) AS event_id, CAST(0 AS DOUBLE) AS t, {start} FROM r UNION ALL {step} WHERE r.key = m.key AND r.rn = m.rn + 1 AND {going})
SELECT key, t, event_id, {out} FROM m WHERE rn > 0"""


_SUM = lambda x: f"CAST(sum({x}) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT)"
_run = lambda c: F.sum(c).over(series.running(W()))


@query(_recursive(
    f"{_SUM('CASE WHEN value > 150 THEN 1 ELSE 0 END')} AS total, {_SUM('CAST(floor(value) AS BIGINT)')} / 20e0 AS place, value / 10 AS off, event_id % 499 = 0 AS reached, event_id % 10 AS speed, event_type = 'click' AS justified",
    "CAST(0 AS BIGINT) AS total, false AS active, CAST(0 AS BIGINT) AS deadline, CAST(0 AS DOUBLE) AS begun, CAST(0 AS BIGINT) AS clear, 0 AS stuck, 'running' AS status",
    """SELECT key, rn, event_id, t, total, active2, deadline1, begun1, clear1, CASE WHEN dead THEN stuck WHEN active2 THEN 0 ELSE stuck1 END,
  CASE WHEN dead THEN 'collision_unrecovered' WHEN active2 THEN 'recovering' WHEN reached THEN 'success' WHEN off > 30 THEN 'off_route' WHEN stuck1 >= 5 THEN 'unjustified_stall' ELSE 'running' END
FROM (SELECT *, active1 AND NOT good AS active2, active1 AND NOT good AND rn >= deadline1 AS dead, CASE WHEN speed < 3 AND NOT justified THEN stuck + 1 ELSE 0 END AS stuck1
FROM (SELECT *, active1 AND clear1 >= 3 AND place - begun1 >= 5 AND off <= 30 AS good
FROM (SELECT r.*, m.stuck, m.active OR r.total > m.total AS active1, CASE WHEN r.total > m.total AND NOT m.active THEN r.rn + 10 ELSE m.deadline END AS deadline1,
  CASE WHEN r.total > m.total AND NOT m.active THEN r.place ELSE m.begun END AS begun1, CASE WHEN r.total > m.total THEN 0 WHEN m.active THEN m.clear + 1 ELSE m.clear END AS clear1 FROM m, r""",
    "status, stuck", "m.status IN ('running', 'recovering'))))"))
def recovery_machine(spark, sf_dir):
    v = C("value")
    rows = _rows(spark, sf_dir, total=_run((v > 150).cast("long")), place=_run(F.floor(v)) / 20, off=v / 10, reached=C("event_id") % 499 == 0, speed=(C("event_id") % 10).cast("double"), justified=C("event_type") == "click")
    return _fold(rows, machines.recovery(still=3.0))


_SEGMENTS = lambda keep: _recursive(
    "(CAST(floor(value * 10) AS BIGINT) + 7) // 8 * 8 AS size", "CAST(0 AS BIGINT) AS segment, CAST(0 AS BIGINT) AS used, false AS stored",
    f"""SELECT r.key, r.rn, r.event_id, r.t, CASE WHEN r.size <= 2048 AND m.used + r.size > 2048 THEN m.segment + 1 ELSE m.segment END,
  CASE WHEN r.size > 2048 THEN m.used WHEN m.used + r.size > 2048 THEN {'r.size' if keep else '0'} ELSE m.used + r.size END, r.size <= 2048 AND ({str(keep).lower()} OR m.used + r.size <= 2048) FROM m, r""", "segment, used, stored")


@query(_SEGMENTS(True))
def segmenter(spark, sf_dir):
    return _fold(_rows(spark, sf_dir, size=F.floor(C("value") * 10)), machines.segmenter(2048, True))


@query(_SEGMENTS(False))
def segmenter_dropping(spark, sf_dir):
    return _fold(_rows(spark, sf_dir, size=F.floor(C("value") * 10)), machines.segmenter(2048, False))


@query(_recursive(
    "CAST(event_id % 15 AS DOUBLE) AS target, value / 20 AS speed, (value - 100) / 100 AS steer", "CAST(0 AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS last, CAST(0 AS DOUBLE) AS effort, CAST(0 AS DOUBLE) AS steered",
    """SELECT key, rn, event_id, t, s, e, CASE WHEN target <= 0.3e0 AND speed > 0.3e0 THEN least(effort, -1) ELSE effort END, steered FROM (SELECT *, 0.5e0 * e + 0.05e0 * s + 0.01e0 * (e - last) / 0.1e0 AS effort FROM (
  SELECT r.*, r.target - r.speed AS e, m.last, least(2e0, greatest(-2e0, m.s + (r.target - r.speed) * 0.1e0)) AS s, 0.2e0 * m.steered + (1 - 0.2e0) * least(1, greatest(-1, r.steer)) AS steered FROM m, r""",
    "round(least(0.75e0, greatest(0, effort)) + 1e-9, 6) + 0 AS throttle, round(least(1e0, greatest(0, -effort)) + 1e-9, 6) + 0 AS brake, round(steered + 1e-9, 6) + 0 AS steered", "true))"))
def pid_control(spark, sf_dir):
    v = C("value")
    out = _fold(_rows(spark, sf_dir, target=(C("event_id") % 15).cast("double"), speed=v / 20, steer=(v - 100) / 100), machines.pid(0.5, 0.05, 0.01, 2.0, 0.2))
    return out.select("key", "t", "event_id", *((F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) for c in ("throttle", "brake", "steered")))


_D2 = lambda k: f"(({_RX}[{k}] - r.x) * ({_RX}[{k}] - r.x) + ({_RY}[{k}] - r.y) * ({_RY}[{k}] - r.y))"


@query(_recursive(
    f"{_SUM('CAST(floor(value) AS BIGINT)')} / 5e0 AS x, CAST(event_id % 11 AS DOUBLE) AS y, CAST(event_id % 360 AS DOUBLE) AS yaw", "0 AS i, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS yaw",
    f"SELECT r.key, r.rn, r.event_id, r.t, CAST(list_sort(list_transform(range(m.i, least(m.i + 5, 30)), lambda k: {{'d': {_D2('k + 1')}, 'k': k}}))[1].k AS INTEGER), r.x, r.y, r.yaw FROM m, r",
    f"""i AS "index", round(sqrt(({_RX}[i + 1] - x) ** 2 + ({_RY}[i + 1] - y) ** 2), 6) AS deviation, round({_RA}[i + 1] / {_RA}[30], 6) AS completion, sqrt(({_RX}[30] - x) ** 2 + ({_RY}[30] - y) ** 2) <= 3 AS reached,
  round(cos(radians(yaw)) * ({_RX}[least(30, len(list_filter({_RA}, lambda a: a < {_RA}[i + 1] + 10)) + 1)] - x) + sin(radians(yaw)) * ({_RY}[least(30, len(list_filter({_RA}, lambda a: a < {_RA}[i + 1] + 10)) + 1)] - y), 6) + 0 AS target_x,
  round(cos(radians(yaw)) * ({_RY}[least(30, len(list_filter({_RA}, lambda a: a < {_RA}[i + 1] + 10)) + 1)] - y) - sin(radians(yaw)) * ({_RX}[least(30, len(list_filter({_RA}, lambda a: a < {_RA}[i + 1] + 10)) + 1)] - x), 6) + 0 AS target_y"""))
def nav_progress(spark, sf_dir):
    out = _fold(_rows(spark, sf_dir, x=_run(F.floor("value")) / 5, y=(C("event_id") % 11).cast("double"), yaw=(C("event_id") % 360).cast("double")), machines.navigator(ROUTE, 5))
    return out.select("key", "t", "event_id", "index", "reached", *((F.round(c, 6) + 0.0).alias(c) for c in ("deviation", "completion", "target_x", "target_y")))


@query(_recursive(
    f"{_SUM('CAST(floor(value) AS BIGINT)')} / 5e0 AS x, CAST(event_id % 11 AS DOUBLE) AS y, event_id % 20 AS speed", "0 AS gone",
    f"SELECT r.key, r.rn, r.event_id, r.t, coalesce(CAST(list_min(list_filter(range(m.gone, 30), lambda k: NOT sqrt({_D2('k + 1')}) < CASE WHEN k = 29 THEN 1e0 ELSE 6 + 2 * r.speed END)) AS INTEGER), 30) FROM m, r",
    "gone, 30 - gone AS remaining"))
def planner_queue(spark, sf_dir):
    return _fold(_rows(spark, sf_dir, x=_run(F.floor("value")) / 5, y=(C("event_id") % 11).cast("double"), speed=(C("event_id") % 20).cast("double")), machines.waypoint_queue(ROUTE, 6.0, 2.0))


@query(_recursive(
    "value AS x, CAST(event_id % 50 AS DOUBLE) AS y, CAST(event_id % 97 AS DOUBLE) AS ox, CAST(event_id % 53 AS DOUBLE) AS oy", "false AS retargeted, CAST(NULL AS DOUBLE) AS target_x, CAST(NULL AS DOUBLE) AS target_y, 0 AS turns",
    "SELECT key, rn, event_id, t, near, CASE WHEN near THEN ox ELSE target_x END, CASE WHEN near THEN oy ELSE target_y END, turns + CASE WHEN near THEN 1 ELSE 0 END FROM (SELECT r.*, m.target_x, m.target_y, m.turns, m.target_x IS NULL OR sqrt((m.target_x - r.x) * (m.target_x - r.x) + (m.target_y - r.y) * (m.target_y - r.y)) < 25 AS near FROM m, r",
    "retargeted, target_x, target_y, turns", "true)"))
def walker_retarget(spark, sf_dir):
    k = C("event_id")
    return _fold(_rows(spark, sf_dir, x=C("value"), y=(k % 50).cast("double"), offer_x=(k % 97).cast("double"), offer_y=(k % 53).cast("double")), machines.walker(25.0))


_STATUS = "CASE WHEN value > 150 THEN 'collision' WHEN event_id % 37 = 0 THEN 'done' WHEN event_id % 5 = 0 THEN 'partial' ELSE 'running' END"


@query(_recursive(
    f"{_STATUS} AS status", "0 AS kept, 0 AS tried, 'going' AS result",
    """SELECT r.key, r.rn, r.event_id, r.t, m.kept + CASE WHEN r.status IN ('partial', 'done') THEN 1 ELSE 0 END, m.tried + CASE WHEN r.status = 'collision' AND m.kept = 0 THEN 1 ELSE 0 END,
  CASE WHEN r.status = 'done' THEN 'finished' WHEN r.status = 'collision' THEN CASE WHEN m.kept > 0 THEN 'cut' WHEN m.tried + 1 >= 3 THEN 'failed' ELSE 'retry' END ELSE 'going' END FROM m, r""",
    "kept, tried, result", "m.result IN ('going', 'retry')"))
def drive_loop(spark, sf_dir):
    return _fold(_rows(spark, sf_dir, status=F.expr(_STATUS)), machines.drive())


@query(f"WITH {EV}, r AS (SELECT event_id, value, row_number() OVER w AS rn, list(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id, rn > 4 AS full, round(coalesce(list_sum(h), 0), 6) AS total, coalesce(h[1], value) AS oldest FROM r")
def history_buffer(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("h", series.history(C("value"), W(), 4)).withColumn("full", F.size("h") == 4)
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    return rows.select("event_id", "full", F.round(total, 6).alias("total"), F.coalesce(F.get("h", F.lit(0)), "value").alias("oldest"))


@query(f"""WITH {EV}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 43200 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS drive FROM g)
SELECT event_id, CAST(drive AS BIGINT) AS drive, count(*) OVER d AS frames, count(*) OVER (PARTITION BY user_id, drive ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS future, lead(value) OVER o AS next_value FROM s WINDOW d AS (PARTITION BY user_id, drive), o AS (PARTITION BY user_id, drive ORDER BY t, event_id)""")
def finalised_drives(spark, sf_dir):
    return series.finalised(events(spark, sf_dir), "user_id", "t", "event_id", 43200.0, "value").select("event_id", "drive", "frames", "future", "next_value")
