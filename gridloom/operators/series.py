"""Ordered series: slopes, arcs, running costs, kinematics, batches. Every order carries a tie column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def acceleration(v: Column, t: Column, w: WindowSpec) -> Column:
    """Slopes of a series: inside the mean of both sides, at the ends one; times that don't grow give a slope of 0."""
    slope = lambda dv, dt: F.when(dt > 0, F.try_divide(dv, dt)).otherwise(0.0)
    ahead, behind = slope(F.lead(v).over(w) - v, F.lead(t).over(w) - t), slope(v - F.lag(v).over(w), t - F.lag(t).over(w))
    has_next, has_last = F.lead(t).over(w).isNotNull(), F.lag(t).over(w).isNotNull()
    return F.when(has_next & has_last, (ahead + behind) / 2).when(has_next, ahead).when(has_last, behind).otherwise(0.0)


def previous(c: Column, w: WindowSpec, k: int = 1) -> tuple[Column, Column]:
    """The value k rows before, or the current one, and whether there was one."""
    return F.coalesce(F.lag(c, k).over(w), c), F.row_number().over(w) > k


def step_length(x: Column, y: Column, w: WindowSpec) -> Column:
    dx, dy = x - F.lag(x).over(w), y - F.lag(y).over(w)
    return F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))


def arc_length(df: DataFrame, x: Column, y: Column, w: WindowSpec, name: str = "arc") -> DataFrame:
    return df.withColumn("_step", step_length(x, y, w)).withColumn(name, F.sum("_step").over(running(w))).drop("_step")


def look_ahead(df: DataFrame, arc: str, x: str, y: str, w: WindowSpec, limit: float) -> DataFrame:
    """Points up to ``limit`` along the arc, and the interpolated point where it is passed (``boundary``)."""
    before = F.lag(arc).over(w)
    share = F.try_divide(F.lit(limit) - before, F.col(arc) - before)
    rows = df.withColumns({"_before": before, "_x": F.lag(x).over(w), "_y": F.lag(y).over(w), "_s": share})
    crosses = (F.col("_before") < limit) & (F.col(arc) > limit)
    return (
        rows.where((F.col(arc) <= limit) | crosses)
        .withColumns({"boundary": F.coalesce(crosses, F.lit(False)), x: F.when(crosses, F.col("_x") + F.col("_s") * (F.col(x) - F.col("_x"))).otherwise(F.col(x)), y: F.when(crosses, F.col("_y") + F.col("_s") * (F.col(y) - F.col("_y"))).otherwise(F.col(y)), arc: F.least(F.col(arc), F.lit(limit))})
        .drop("_before", "_x", "_y", "_s")
    )


def drop_close(df: DataFrame, x: Column, y: Column, w: WindowSpec, least: float = 1e-3) -> DataFrame:
    """Rows more than ``least`` from the row before them; the first stays. Points that aren't finite go first."""
    inf = float("inf")
    df = df.where(~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < inf) & (F.abs(y) < inf))
    dx, dy = x - F.lag(x).over(w), y - F.lag(y).over(w)
    return df.withColumn("_d", F.sqrt(dx * dx + dy * dy)).where(F.col("_d").isNull() | (F.col("_d") > least)).drop("_d")


def new_events(total: Column, w: WindowSpec) -> Column:
    """Events since the row before, of a counter that may restart."""
    return F.greatest(total - F.lag(total, 1, 0).over(w), F.lit(0))


def kinematics(df: DataFrame, x: str, y: str, dt: float, w: WindowSpec, eps: float = 1e-6) -> DataFrame:
    """speed, accel, jerk by finite differences and the heading, which is carried on over steps of at most ``eps``."""
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    out = df.withColumns({"_n": F.sqrt(dx * dx + dy * dy), "_h": F.degrees(F.atan2(dy, dx))})
    out = out.withColumn("speed", F.coalesce(F.col("_n") / dt, F.lit(0.0)))
    out = out.withColumn("accel", F.coalesce((F.col("speed") - F.lag("speed").over(w)) / dt, F.lit(0.0)))
    out = out.withColumn("jerk", F.coalesce((F.col("accel") - F.lag("accel").over(w)) / dt, F.lit(0.0)))
    return out.withColumn("heading", F.coalesce(F.last(F.when(F.col("_n") > eps, F.col("_h")), True).over(running(w)), F.lit(0.0))).drop("_n", "_h")


def offsets(size: Column, w: WindowSpec) -> Column:
    """Exclusive running sum: where each row's items begin."""
    return F.sum(size).over(running(w)) - size


def subsample(df: DataFrame, key: list[str], w: WindowSpec, limit: int) -> DataFrame:
    """All rows of a group of at most ``limit``; else those at trunc(linspace(0, n - 1, limit))."""
    whole = Window.partitionBy(*key)
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)})
    # row i is drawn iff some k has floor(k * (n - 1) / (limit - 1)) = i, that is iff the first k at or past i gives i
    k = F.ceil(F.col("_i") * (limit - 1) / (F.col("_n") - 1)).cast("long")
    drawn = (k < limit) & (F.floor(F.expr("0") + k * (F.col("_n") - 1) / F.lit(limit - 1)) == F.col("_i"))
    return rows.where((F.col("_n") <= limit) | drawn).drop("_i", "_n")


def batches(df: DataFrame, key: str, order: list[str], size: int, drop_last: bool) -> DataFrame:
    """Full batches within a key; the tails of all keys are pooled in key order, and their last, short batch may go.

    Adds ``pooled``, ``batch`` (numbered within its key, or within the pool) and ``slot``.
    """
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(key))})
    rows = rows.withColumn("pooled", F.col("_i") >= F.col("_n") - F.col("_n") % size)
    # one row a key is enough to place the tails: there are fewer than ``size`` rows of a key in the pool
    tails = rows.where("pooled").groupBy(key).agg(F.count("*").alias("_c"))
    starts = tails.withColumn("_start", F.sum("_c").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1))).select(key, F.coalesce("_start", F.lit(0)).alias("_start"))
    total = tails.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_total"))
    rows = rows.join(starts, key, "left").crossJoin(F.broadcast(total))
    place = F.when(F.col("pooled"), F.col("_start") + F.col("_i") - (F.col("_n") - F.col("_n") % size)).otherwise(F.col("_i"))
    rows = rows.withColumns({"batch": F.floor(place / size), "slot": place % size})
    if drop_last:
        rows = rows.where(~F.col("pooled") | ((F.col("batch") + 1) * size <= F.col("_total")))
    return rows.drop("_i", "_n", "_start", "_total")


def runs(df: DataFrame, flag: Column, key: list[str], order: list[str], name: str = "run") -> DataFrame:
    """Adds ``name``: for how many rows on end the flag has held, 0 where it doesn't."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_g", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(running(w)))
    inner = Window.partitionBy(*key, "_g").orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(running(inner))).drop("_f", "_g")


def sticky(value: Column, w: WindowSpec) -> Column:
    """The last value that wasn't null."""
    return F.last(value, True).over(running(w))


def history(value: Column, w: WindowSpec, n: int) -> Column:
    """The up to n values before a row, the oldest first; it is full when there are n."""
    return F.collect_list(value).over(w.rowsBetween(-n, -1))


def finalised(df: DataFrame, key: str, t: str, tie: str, gap: float, value: str) -> DataFrame:
    """Rows of drives that end where the key is silent for more than ``gap``, with what is known only at a drive's end.

    Adds ``drive`` (from 1), ``frames`` of the drive, ``future`` rows left in it and the ``next_value``.
    """
    w = Window.partitionBy(key).orderBy(t, tie)
    new = F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1)
    rows = df.withColumn("_new", new).withColumn("drive", F.sum("_new").over(running(w)).cast("long"))
    inner = Window.partitionBy(key, "drive").orderBy(t, tie)
    rows = rows.withColumns({"frames": F.count("*").over(Window.partitionBy(key, "drive")), "_i": F.row_number().over(inner), "next_value": F.lead(value).over(inner)})
    return rows.withColumn("future", F.col("frames") - F.col("_i")).drop("_new", "_i")
