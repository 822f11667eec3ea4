"""Poses, oriented boxes, rays and segments as column expressions. Left-handed: x forward, y right, z up; degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
#: Corner signs: the lower face, then the upper one, in the same order.
CORNERS = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]


def rotation(roll: Column, pitch: Column, yaw: Column) -> list[Vec]:
    r, p, y = (F.radians(a) for a in (roll, pitch, yaw))
    cr, sr, cp, sp, cy, sy = F.cos(r), F.sin(r), F.cos(p), F.sin(p), F.cos(y), F.sin(y)
    return [
        (cp * cy, cy * sp * sr - sy * cr, -(cy * sp * cr) - sy * sr),
        (sy * cp, sy * sp * sr + cy * cr, cy * sr - sy * sp * cr),
        (sp, -(cp * sr), cp * cr),
    ]


def to_world(p: Vec, t: Vec, rot: list[Vec]) -> Vec:
    return tuple(rot[k][0] * p[0] + rot[k][1] * p[1] + rot[k][2] * p[2] + t[k] for k in range(3))


def to_local(p: Vec, t: Vec, rot: list[Vec]) -> Vec:
    """The inverse: the rotation's transpose, applied to p - t."""
    d = [p[k] - t[k] for k in range(3)]
    return tuple(rot[0][k] * d[0] + rot[1][k] * d[1] + rot[2][k] * d[2] for k in range(3))


def pinhole(p: Vec, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """(u, v, depth) of a camera-frame point; a depth near zero is held at 1e-6."""
    z = F.when(F.abs(p[0]) < 1e-6, F.lit(1e-6)).otherwise(p[0])
    return fx * p[1] / z + cx, fy * -p[2] / z + cy, p[0]


def slab(origin: Vec, ray: Vec, extent: Vec, eps: float = 1e-9) -> tuple[Column, Column, Column]:
    """(near, far, hit) of a ray and a box about the origin. A ray along a face hits only from between the faces."""
    lows, highs, inside = [], [], F.lit(True)
    for o, d, e in zip(origin, ray, extent):
        flat = F.abs(d) < eps
        a, b = F.try_divide(-e - o, d), F.try_divide(e - o, d)
        lows.append(F.when(flat, F.lit(float("-inf"))).otherwise(F.least(a, b)))
        highs.append(F.when(flat, F.lit(float("inf"))).otherwise(F.greatest(a, b)))
        inside = inside & (~flat | (F.abs(o) <= e))
    near, far = F.greatest(*lows), F.least(*highs)
    return near, far, inside & (far >= F.greatest(near, F.lit(0.0)))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, eps: float = 1e-12) -> tuple[Column, Column]:
    """(distance, share along the segment) of the nearest point."""
    dx, dy = bx - ax, by - ay
    u = F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / F.greatest(dx * dx + dy * dy, F.lit(eps)), F.lit(0.0)), F.lit(1.0))
    qx, qy = px - (ax + u * dx), py - (ay + u * dy)
    return F.sqrt(qx * qx + qy * qy), u


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether two segments meet; parallel ones don't."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = F.try_divide((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx), den)
    u = F.try_divide((cx - ax) * (by - ay) - (cy - ay) * (bx - ax), den)
    return F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False))


def box_corners_2d(x, y, ex, ey, yaw) -> list[tuple[Column, Column]]:
    c, s = F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    return [(x + c * (a * ex) - s * (b * ey), y + s * (a * ex) + c * (b * ey)) for a, b, z in CORNERS[:4]]


def box_distance(a: tuple, b: tuple) -> Column:
    """Signed distance of two boxes (x, y, half length, half width, yaw): of separate ones that of the nearest corner, of overlapping ones minus the least overlap of the four axes.

    Each box is seen in the other's frame, where its reach along an axis is the sum of its half sizes' shares.
    """
    ca, sa, turn = F.cos(F.radians(a[4])), F.sin(F.radians(a[4])), F.radians(b[4] - a[4])
    dx, dy, c, s = b[0] - a[0], b[1] - a[1], F.cos(turn), F.sin(turn)
    bx, by = dx * ca + dy * sa, dy * ca - dx * sa
    ax, ay = -(bx * c + by * s), bx * s - by * c
    ac, as_ = F.abs(c), F.abs(s)
    overlap = lambda at, own, other: F.least(own, at + other) - F.greatest(-own, at - other)
    least = F.least(
        overlap(bx, a[2], b[2] * ac + b[3] * as_), overlap(by, a[3], b[2] * as_ + b[3] * ac), overlap(ax, b[2], a[2] * ac + a[3] * as_), overlap(ay, b[3], a[2] * as_ + a[3] * ac),
    )
    gaps = []
    for i, j, _ in CORNERS[:4]:
        for px, py, ex, ey in ((bx + i * b[2] * c - j * b[3] * s, by + i * b[2] * s + j * b[3] * c, a[2], a[3]), (ax + i * a[2] * c + j * a[3] * s, ay - i * a[2] * s + j * a[3] * c, b[2], b[3])):
            gx, gy = F.greatest(F.abs(px) - ex, F.lit(0.0)), F.greatest(F.abs(py) - ey, F.lit(0.0))
            gaps.append(gx * gx + gy * gy)
    return F.when(least < 0, F.sqrt(F.least(*gaps))).otherwise(-least)


def to_ego(dx: Column, dy: Column, yaw: Column) -> tuple[Column, Column]:
    """A plane vector in the frame of a car of that heading."""
    c, s = F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    return c * dx + s * dy, c * dy - s * dx


def to_camera(p: Vec, ego_t: Vec, ego_rot: list[Vec], cam_t: Vec, cam_rot: list[Vec]) -> Vec:
    """A world point in a camera's frame, by the car's pose and the camera's pose on the car."""
    return to_local(to_local(p, ego_t, ego_rot), cam_t, cam_rot)


def planar_previous_to_current(before: tuple, now: tuple) -> dict[str, Column]:
    """m11, m12, m21, m22, tx, ty that take plane points of the frame (x, y, yaw) before to the one now."""
    turn = F.radians(before[2] - now[2])
    tx, ty = to_ego(before[0] - now[0], before[1] - now[1], now[2])
    return {"m11": F.cos(turn), "m12": -F.sin(turn), "m21": F.sin(turn), "m22": F.cos(turn), "tx": tx, "ty": ty}


def outside_box(local: Vec, extent: Vec) -> Column:
    """Whether a point, in the box's frame, is beyond it on some axis (strictly)."""
    return (F.abs(local[0]) > extent[0]) | (F.abs(local[1]) > extent[1]) | (F.abs(local[2]) > extent[2])


def in_range(p: Vec, low: tuple, high: tuple) -> Column:
    """Half open on each axis."""
    out = F.lit(True)
    for c, a, b in zip(p, low, high):
        out = out & (c >= a) & (c < b)
    return out


def in_ego_rectangle(dx: Column, dy: Column, yaw: Column, x: tuple[float, float], y: tuple[float, float]) -> Column:
    """Whether a plane offset lies in a rectangle of the car's frame, its edges too."""
    a, b = to_ego(dx, dy, yaw)
    return a.between(*x) & b.between(*y)


def bev_pixel(x: Column, y: Column, rows: int, cols: int, xs: tuple[float, float], ys: tuple[float, float]) -> tuple[Column, Column]:
    """(row, col), fractional; row 0 is farthest ahead."""
    return (1 - (x - xs[0]) / (xs[1] - xs[0])) * rows, (y - ys[0]) / (ys[1] - ys[0]) * cols


def in_view(x: Column, y: Column, fov: float) -> Column:
    """Whether a point's bearing is within the field of view; x is held at 1e-3 at least."""
    return (x > 0) & (F.abs(F.degrees(F.atan2(y, F.greatest(x, F.lit(1e-3))))) <= fov / 2)


def back_projection(u: Column, v: Column, depth: Column, fx, fy, cx, cy) -> Vec:
    """A pixel of known depth as a point (forward, right, up) of the camera."""
    return depth, (u - cx) * depth / fx, -(v - cy) * depth / fy


def depth_point_valid(x: Column, y: Column, depth: Column, most: float, fov: float, least: float = 0.1) -> Column:
    """least < depth < most, ahead, within the field of view."""
    return (depth > least) & (depth < most) & (x > 0) & (F.abs(F.degrees(F.atan2(y, x))) <= fov / 2)


def boxes_overlap(a: tuple, b: tuple) -> Column:
    """Whether two axis-parallel rectangles (x0, y0, x1, y1) meet, at an edge too."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def circle_reaches(cx: Column, cy: Column, radius: Column, x: Column, y: Column, reach: float) -> Column:
    """Whether something within ``radius`` of a centre can be nearer than ``reach``."""
    return F.hypot(cx - x, cy - y) - radius < reach


def stop_line(x: Column, y: Column, yaw: Column, width: Column) -> tuple[Column, Column, Column, Column]:
    """The ends of a line across a lane."""
    dx, dy = -F.sin(F.radians(yaw)) * width / 2, F.cos(F.radians(yaw)) * width / 2
    return x - dx, y - dy, x + dx, y + dy
