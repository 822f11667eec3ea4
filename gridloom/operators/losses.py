"""Masked means, losses and trajectory scores as aggregates, so that each is a sum and a count that combine before the shuffle."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions.scalar import smooth_l1
from gridloom.operators.series import running

C = F.col


def masked_mean(loss: Column, mask: Column) -> Column:
    """The sum over the mask, by its sum or 1."""
    return F.coalesce(F.sum(loss * mask), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(mask), F.lit(0.0)), F.lit(1.0))


def bce(logit: Column, target: Column) -> Column:
    """Binary cross entropy of a logit, without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def balanced_bce(logit: Column, target: Column, valid: Column) -> Column:
    """The means over foreground and background, in equal parts; without foreground only the background's."""
    pos, neg = valid * (target > 0.5).cast("double"), valid * (target <= 0.5).cast("double")
    p, n = masked_mean(bce(logit, target), pos), masked_mean(bce(logit, target), neg)
    return n + F.when(F.sum(pos) > 0, 0.5 * (p - n)).otherwise(0.0)


def log_softmax(logits: Column, k: Column) -> Column:
    """Log share of class k (from 0) of an array of logits."""
    top = F.array_max(logits)
    return F.get(logits, k) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def cross_entropy(logits: Column, k: Column, weights: list[float] | None = None, ignore: int | None = None) -> Column:
    """-log share of the class, times the class's weight; 0 for the class to ignore."""
    loss = -log_softmax(logits, k)
    if weights is not None:
        loss = loss * F.get(F.array(*map(F.lit, weights)), k)
    return loss if ignore is None else F.when(k == ignore, 0.0).otherwise(loss)


def direction_loss(px: Column, py: Column, tx: Column, ty: Column, eps: float = 1e-6) -> Column:
    """1 - cosine of the angle between two vectors; null where the target has no length."""
    norm = lambda x, y: F.greatest(F.sqrt(x * x + y * y), F.lit(eps))
    return F.when(tx * tx + ty * ty > eps * eps, 1 - (px * tx + py * ty) / (norm(px, py) * norm(tx, ty)))


def distance_weight(depth: Column, most: float, least: float = 0.1) -> Column:
    """1 near, falling to ``least`` at ``most``."""
    return F.least(F.greatest(1 - (1 - least) * depth / most, F.lit(least)), F.lit(1.0))


def gradient_loss(image: DataFrame, key: list[str], row: str, col: str, pred: str, target: str, mask: str) -> DataFrame:
    """(key, loss): smooth L1 of the differences of neighbours along rows and columns, by the number of pairs with both ends in the mask."""
    out = []
    for along, across in ((row, col), (col, row)):
        w = Window.partitionBy(*key, along).orderBy(across)
        pair = image.select(*key, C(across).alias("_k"), *(C(c).alias(f"_{i}") for i, c in enumerate((pred, target, mask))), *(F.lead(c).over(w).alias(f"_n{i}") for i, c in enumerate((across, pred, target, mask))))
        e = (C("_n1") - C("_0")) - (C("_n2") - C("_1"))
        out.append(pair.where("_n0 = _k + 1").select(*key, smooth_l1(e).alias("e"), (C("_2") * C("_n3")).alias("m")))
    return out[0].union(out[1]).groupBy(*key).agg(masked_mean(C("e"), C("m")).alias("loss"))


def energy(cells: DataFrame, key: str, logit: str, soft: str, mask: str) -> DataFrame:
    """(key, loss): cross entropy of the softmax over the cells in view with the soft target, of which the share in view is made a distribution."""
    seen = cells.where(C(mask) > 0)
    w = Window.partitionBy(key)
    rows = seen.withColumn("_top", F.max(logit).over(w))
    got = rows.groupBy(key).agg(F.max("_top").alias("_t"), F.sum(F.exp(C(logit) - C("_top"))).alias("_z"), F.sum(soft).alias("_s"), F.sum(C(soft) * C(logit)).alias("_d"))
    return got.select(key, ((C("_s") * (C("_t") + F.log("_z")) - C("_d")) / F.greatest("_s", F.lit(1.0))).alias("loss"))


def waypoint_weights(df: DataFrame, x: str, y: str, valid: str, w: WindowSpec, least: float, decay: float, gain: float, turn_degrees: float) -> DataFrame:
    """Adds ``weight``: (least + (1 - least) exp(-path / decay)) (1 + gain clip(turn / turn_degrees)) of valid waypoints, else 0.

    The path begins at the origin. The turn at a waypoint is the angle between the segments before and after it; the
    last, and segments that aren't valid or have no length, have none.
    """
    lag = lambda c, d: F.coalesce(F.lag(c).over(w), F.lit(d))
    rows = df.withColumns({"_sx": C(x) - lag(x, 0.0), "_sy": C(y) - lag(y, 0.0), "_ok": (C(valid) > 0) & (lag(valid, 1) > 0)})
    rows = rows.withColumn("_len", F.sqrt(C("_sx") * C("_sx") + C("_sy") * C("_sy")))
    rows = rows.withColumn("_path", F.sum(F.when(C("_ok"), C("_len")).otherwise(0.0)).over(running(w)))
    lead = lambda c: F.lead(c).over(w)
    dot = (C("_sx") * lead("_sx") + C("_sy") * lead("_sy")) / (F.greatest("_len", F.lit(1e-6)) * F.greatest(lead("_len"), F.lit(1e-6)))
    has = C("_ok") & lead("_ok") & (C("_len") > 1e-6) & (lead("_len") > 1e-6)
    turn = F.when(has, F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))).otherwise(0.0)
    weight = (least + (1 - least) * F.exp(-C("_path") / decay)) * (1 + gain * F.least(turn / math.radians(turn_degrees), F.lit(1.0)))
    return rows.withColumn("weight", F.when(C(valid) > 0, weight).otherwise(0.0)).drop("_sx", "_sy", "_ok", "_len", "_path")


def match_modes(waypoints: DataFrame, key: str, mode: str, weight: str, displacement: Column) -> DataFrame:
    """(key, mode, cost): the mode of least weighted mean displacement, the first of equal ones (costs to 9 digits)."""
    cost = F.sum(displacement * C(weight)) / F.greatest(F.sum(weight), F.lit(1.0))
    costs = waypoints.groupBy(key, mode).agg(F.round(cost, 9).alias("cost"))
    return costs.groupBy(key).agg(F.min(F.struct("cost", mode)).alias("m")).select(key, f"m.{mode}", "m.cost")


def trajectory_losses(waypoints: DataFrame, key: str, mode: str, weight: str, per: Column, matched: DataFrame, unmatched: float) -> DataFrame:
    """(key, loss): weighted loss of all modes; the matched one counts 1, the others ``unmatched``."""
    share = F.when(C(mode) == C("_m"), 1.0).otherwise(unmatched)
    rows = waypoints.join(matched.select(C(key), C(mode).alias("_m")), key)
    by = rows.groupBy(key, mode).agg((F.sum(per * C(weight)) * F.first(share)).alias("n"), F.sum(weight).alias("w"), F.first(share).alias("s"))
    return by.groupBy(key).agg((F.sum("n") / F.greatest(F.max("w") * F.sum("s"), F.lit(1.0))).alias("loss"))


def matched_losses(waypoints: DataFrame, key: str, mode: str, weight: str, displacement: Column, per: Column, unmatched: float) -> DataFrame:
    """(key, mode, loss): the mode of ``match_modes`` and the loss of ``trajectory_losses`` from one pass of sums by mode."""
    by = waypoints.groupBy(key, mode).agg(F.round(F.sum(displacement * C(weight)) / F.greatest(F.sum(weight), F.lit(1.0)), 9).alias("c"), F.sum(per * C(weight)).alias("l"), F.sum(weight).alias("w"))
    all_ = by.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("c", C(mode).alias("g"), "l", "w"))).alias("_m"))
    best = C("_m")[0]["g"]
    share = lambda m: F.when(m["g"] == best, 1.0).otherwise(unmatched)
    total = lambda f: F.aggregate("_m", F.lit(0.0), lambda a, m: a + f(m))
    loss = total(lambda m: m["l"] * share(m)) / F.greatest(F.array_max(F.transform("_m", lambda m: m["w"])) * total(share), F.lit(1.0))
    return all_.select(key, best.alias(mode), loss.alias("loss"))


def worst_footprint(df: DataFrame, x: str, y: str, w: WindowSpec, length: Column, width: Column, loss: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """``df`` with the greatest loss(fx, fy) of each waypoint's ``footprint_points``, in its own row."""
    rows = _tangents(df, x, y, w)
    return rows.withColumn(name, F.greatest(*(loss(*_off(x, y, F.lit(i), F.lit(j), length, width)) for i in (-1, 0, 1) for j in (-1, 0, 1)))).drop("_tx", "_ty")


def footprint_points(df: DataFrame, x: str, y: str, w: WindowSpec, length: Column, width: Column) -> DataFrame:
    """Nine rows (fx, fy, i, j) a waypoint: a box along the trajectory's tangent, sampled at -1, 0 and 1 of its half sizes."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    rows = _tangents(df, x, y, w).withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
    fx, fy = _off(x, y, C("i"), C("j"), length, width)
    return rows.withColumns({"fx": fx, "fy": fy}).drop("_tx", "_ty")


def _off(x: str, y: str, i: Column, j: Column, length: Column, width: Column) -> tuple[Column, Column]:
    return C(x) + i * length * C("_tx") - j * width * C("_ty"), C(y) + i * length * C("_ty") + j * width * C("_tx")


def _tangents(df: DataFrame, x: str, y: str, w: WindowSpec) -> DataFrame:
    """Adds ``_tx`` and ``_ty``, the trajectory's direction at each waypoint.

    The tangent at the first waypoint is the waypoint itself, in between that of both neighbours, at the last that of the
    last step; without length it points ahead.
    """
    before, after = F.lag(F.struct(x, y)).over(w), F.lead(F.struct(x, y)).over(w)
    rows = df.withColumns({"_b": before, "_a": after})
    t = lambda c: F.when(C("_b").isNull(), C(c)).when(C("_a").isNull(), C(c) - C(f"_b.{c}")).otherwise(C(f"_a.{c}") - C(f"_b.{c}"))
    rows = rows.withColumns({"_tx": t(x), "_ty": t(y)}).withColumn("_n", F.sqrt(C("_tx") * C("_tx") + C("_ty") * C("_ty")))
    return rows.withColumns({"_tx": F.when(C("_n") > 1e-6, C("_tx") / C("_n")).otherwise(1.0), "_ty": F.when(C("_n") > 1e-6, C("_ty") / C("_n")).otherwise(0.0)}).drop("_b", "_a", "_n")


def outside(fx: Column, fy: Column, cx: Column, xs: tuple[float, float], ys: tuple[float, float]) -> Column:
    """Metres beyond the grid: behind it only the centre counts, ahead and aside the point."""
    over = lambda c: F.greatest(c, F.lit(0.0))
    return over(xs[0] - cx) + over(fx - xs[1]) + over(ys[0] - fy) + over(fy - ys[1])


def stop_crossing(dx: Column, dy: Column, direction_x: Column, direction_y: Column, margin: float) -> Column:
    """Metres beyond a stop point along its direction, less a margin before it; 0 before."""
    return F.greatest(dx * direction_x + dy * direction_y + margin, F.lit(0.0))


def bilinear(points: DataFrame, cells: DataFrame, key: list[str], row: Column, col: Column, rows: int, cols: int, value: str) -> DataFrame:
    """``points`` with ``sampled``: the grid's value at a fractional place between cell centres, held at the border.

    A point meets its key's grid once, as an array, and takes four of its cells; no point is made four and added up again.
    A cell that isn't there counts nothing, and points of which no cell is there go.
    """
    r, c = F.least(F.greatest(row - 0.5, F.lit(0.0)), F.lit(rows - 1.0)), F.least(F.greatest(col - 0.5, F.lit(0.0)), F.lit(cols - 1.0))
    each = cells.where(C("row").between(0, rows - 1) & C("col").between(0, cols - 1)).groupBy(*key, (C("row") * cols + C("col")).cast("int").alias("_p")).agg(F.sum(value).alias("_v"))
    grids = each.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_p", "_v"))).alias("_m")).select(*key, F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda p: F.try_element_at("_m", p)).alias("_g"))
    at = points.withColumns({"_r": r, "_c": c}).join(grids, key)
    share = lambda v, k: v - F.floor(v) if k else 1 - (v - F.floor(v))
    place = lambda i, j: (F.least(F.floor("_r") + i, F.lit(rows - 1)) * cols + F.least(F.floor("_c") + j, F.lit(cols - 1))).cast("int")
    parts = [share(C("_r"), i) * share(C("_c"), j) * F.get("_g", place(i, j)) for i in (0, 1) for j in (0, 1)]
    total = reduce(add, (F.coalesce(p, F.lit(0.0)) for p in parts))
    return at.select(*points.columns, F.when(F.coalesce(*parts).isNotNull(), total).alias("sampled")).where("sampled is not null")


def candidate_scores(candidates: DataFrame, key: str, mode: str, score: Column) -> DataFrame:
    """``candidates`` with ``score`` and ``rank``; the first mode wins of equal ones."""
    rows = candidates.withColumn("score", F.round(score, 9))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), mode)))


def target_speed(x: str, y: str, df: DataFrame, key: str, order: str, first: int, dt: float, least: float, most: float) -> DataFrame:
    """(key, speed): the median speed of the first ``first`` segments from the origin, within limits."""
    w = Window.partitionBy(key).orderBy(order)
    dx, dy = C(x) - F.coalesce(F.lag(x).over(w), F.lit(0.0)), C(y) - F.coalesce(F.lag(y).over(w), F.lit(0.0))
    rows = df.select(key, F.row_number().over(w).alias("_n"), (F.sqrt(dx * dx + dy * dy) / dt).alias("_v")).where(C("_n") <= first)
    return rows.groupBy(key).agg(F.least(F.greatest(F.percentile("_v", F.lit(0.5)), F.lit(least)), F.lit(most)).alias("speed"))
