"""Scalar column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def symlog(x: Column, scale: float = 1.0) -> Column:
    return F.signum(x) * F.log1p(F.abs(x)) * F.lit(scale)


def symexp(y: Column, scale: float = 1.0) -> Column:
    z = y / F.lit(scale)
    return F.signum(z) * F.expm1(F.abs(z))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def angle_difference(a: Column, b: Column) -> Column:
    """Degrees between two headings, wrapped to [0, 180]."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def bearing_bin(fraction: Column, bins: int = 256) -> Column:
    """Bin of a fraction of the field of view; values outside go to the first or last bin."""
    return F.least(F.greatest((fraction * bins).cast("int"), F.lit(0)), F.lit(bins - 1))


def depth_from_bgr(b: Column, g: Column, r: Column) -> Column:
    """Metres of a depth image's 24 bits."""
    return (r + g * 256.0 + b * 65536.0) / F.lit(float(2**24 - 1)) * 1000.0


def smooth_l1(e: Column) -> Column:
    return F.when(F.abs(e) < 1, 0.5 * e * e).otherwise(F.abs(e) - 0.5)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def direction(x: Column, y: Column, degrees: float = 10.0) -> Column:
    """left, straight or right of a waypoint ahead (y to the right); null unless x > 0. The limits count as straight."""
    a = F.degrees(F.atan2(y, x))
    return F.when(x > 0, F.when(F.abs(a) <= degrees, "straight").when(a < -degrees, "left").otherwise("right"))


def palette(tag: Column, colours: list[str], policy: str = "modulo") -> Column:
    """A tag's colour; tags beyond the table wrap round (modulo), become magenta (unknown) or take the last (clamp)."""
    table, n = F.array(*map(F.lit, colours)), len(colours)
    if policy == "modulo":
        return F.element_at(table, (F.pmod(tag, F.lit(n)) + 1).cast("int"))
    if policy == "clamp":
        return F.element_at(table, (F.least(F.greatest(tag, F.lit(0)), F.lit(n - 1)) + 1).cast("int"))
    return F.when((tag >= 0) & (tag < n), F.try_element_at(table, (tag + 1).cast("int"))).otherwise("magenta")


def waypoint_option(heading: Column, following: Column, threshold: float = 35.0) -> Column:
    """Straight, left or right, by the heading difference modulo 180."""
    d = F.pmod(following - heading, F.lit(180.0))
    return F.when((d < threshold) | (d > 180 - threshold), "straight").when(d > 90, "left").otherwise("right")


def red_stop(red: Column, in_view: Column, speed: Column, distance: Column, reaction: float = 1.0, decel: float = 4.0, margin: float = 2.0, still: float = 0.5) -> Column:
    """Whether a red light asks for a stop: the line is in view and the car stands or can still stop."""
    need = speed * reaction + speed * speed / (2 * decel) + margin
    return red & in_view & ((speed <= still) | (distance >= need))


PI = math.pi


def normalise_channel(value: Column, mean: float, std: float) -> Column:
    """A byte channel as a share of 255, less the mean, by the deviation."""
    return (value / 255.0 - mean) / std


def depth_share(depth: Column, most: float, log: bool = False, least: float = 1.0) -> Column:
    """Depth in [0, 1], linearly, or by logarithms between ``least`` and ``most``."""
    if not log:
        return clip(depth / most, 0.0, 1.0)
    return F.ln(clip(depth, least, most) / least) / math.log(most / least)


def voxel_key(cell: list[Column], low: list[int], size: list[int]) -> Column:
    """One number for a cell of a box that begins at ``low`` and has ``size`` cells an axis; the last axis runs fastest."""
    out = F.lit(0).cast("long")
    for c, a, n in zip(cell, low, size):
        out = out * n + (c - a)
    return out


def voxel_cell(key: Column, low: list[int], size: list[int]) -> list[Column]:
    out, rest = [], key
    for a, n in zip(reversed(low), reversed(size)):
        out.append(F.pmod(rest, F.lit(n)) + a)
        rest = F.floor(rest / n)
    return out[::-1]


def packed_key(frame: Column, actor: Column) -> Column:
    """frame * 2^32 + actor."""
    return frame.cast("long") * F.lit(1 << 32) + actor


def golden_hue(k: Column, saturation: float = 0.65, value: float = 0.95) -> tuple[Column, Column, Column]:
    """Red, green, blue in [0, 1] of the k-th hue; hues step by the golden ratio, so neighbours differ."""
    h = F.pmod(k * 0.6180339887498949, F.lit(1.0)) * 6
    sector, f = F.floor(h).cast("int"), h - F.floor(h)
    v, p, q, t = F.lit(value), F.lit(value * (1 - saturation)), value * (1 - saturation * f), value * (1 - saturation * (1 - f))
    pick = lambda *six: F.element_at(F.array(*six), sector % 6 + 1)
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def softmax(scores: Column) -> Column:
    """Of an array; an empty one gives an empty one."""
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(values: Column) -> Column:
    """Place (from 0) of the greatest value of an array, the first of equal ones."""
    return F.array_position(values, F.array_max(values)) - 1


def speed_limit(kmh: Column) -> Column:
    return kmh / 3.6


def within_radius(dx: Column, dy: Column, most: float) -> Column:
    return F.hypot(dx, dy) <= most


def is_within(dx: Column, dy: Column, heading: Column, most: float, low: float, high: float) -> Column:
    """Whether a target at (dx, dy) is near and its angle to the heading lies in the open interval; what is at the same place is."""
    norm = F.hypot(dx, dy)
    angle = F.degrees(F.acos(clip(F.try_divide(F.cos(F.radians(heading)) * dx + F.sin(F.radians(heading)) * dy, norm), -1.0, 1.0)))
    return (norm < 0.001) | F.coalesce((norm < most) & (angle > low) & (angle < high), F.lit(False))


def sectors(n: int, degrees: float) -> list[float]:
    """The middle angles of n sectors of a fan about straight ahead."""
    return [-degrees / 2 + degrees * (k + 0.5) / n for k in range(n)]


def growing_depths(first: float, step: float, growth: float, most: float) -> list[float]:
    """Depths from ``first`` on whose steps grow by ``growth`` until ``most`` is passed."""
    out = [first]
    while out[-1] + step <= most:
        out.append(out[-1] + step)
        step *= growth
    return out


def one_hot_direction(x: Column, y: Column, degrees: float = 10.0) -> list[Column]:
    """(straight, left, right) of a waypoint; all 0 without one ahead."""
    d = direction(x, y, degrees)
    return [F.coalesce((d == n).cast("int"), F.lit(0)) for n in ("straight", "left", "right")]


def label(value: Column, names: dict, unknown: int | str) -> Column:
    """The class of a name by a small map."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(table, value), F.lit(unknown))


def tag_name(tag: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(table, tag), F.concat(F.lit("Unknown-"), tag.cast("string")))


def hud_line(speed: Column, limit: Column, throttle: Column, state: Column) -> Column:
    """A line of text for a display, in km/h, with the light's state in capitals."""
    return F.format_string("%5.1f / %3.0f km/h  T %.2f  %s", speed * 3.6, limit * 3.6, throttle, F.upper(F.coalesce(state, F.lit("none"))))


def choose_preset(presets: list[str], seed: Column, enabled: bool = True) -> Column:
    """One of the presets by a hash of the seed; null where the choice is switched off."""
    if not enabled or not presets:
        return F.lit(None).cast("string")
    return F.element_at(F.array(*map(F.lit, presets)), (F.pmod(F.xxhash64(seed), F.lit(len(presets))) + 1).cast("int"))
