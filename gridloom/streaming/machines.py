"""Per-entity state machines. Each is one step over a state and a row's values, folded in batch or on a stream by the same code.

In batch the rows are sorted by key and order and pass through as Arrow batches, so a task holds one batch and one state,
never a whole group. A step returns the values of a row, or None for rows after a machine has ended.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Machine:
    """What a machine reads and gives: columns in, the state at the start, columns out (a DDL string)."""

    inputs: tuple[str, ...]
    init: dict
    step: Callable[..., tuple | None]
    outputs: str
    state: str


def _schema(df: DataFrame, key: str, order: list[str], machine: Machine) -> tuple[str, str, list[str]]:
    kept = [key, *order]
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return ddl, f"{ddl}, {machine.outputs}", kept


def fold(df: DataFrame, key: str, order: list[str], machine: Machine) -> DataFrame:
    """Run the machine over each key's rows in order; rows keep the key and the order columns."""
    _, schema, kept = _schema(df, key, order, machine)
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    rows = df.select(*kept, *machine.inputs).repartition(key).sortWithinPartitions(*kept)
    n, step, init = len(kept), machine.step, machine.init
    # an empty frame of the result tells the Arrow types, so that an empty batch has them too
    types = [f.dataType for f in df.sparkSession.createDataFrame([], schema).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(t) for t in types]
        last, state = object(), {}
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != last:
                    last, state = row[0], dict(init)
                made = step(state, *row[n:])
                if made is not None:
                    out.append((*row[:n], *made))
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, arrow)], names=names)

    return rows.mapInArrow(run, schema)


def fold_stream(df: DataFrame, key: str, order: list[str], machine: Machine, expire: str | None = None) -> DataFrame:
    """The same on a stream: each micro-batch's rows of a key in order; the state lasts between batches.

    With ``expire`` (milliseconds, as a string of an integer) a key that is silent for so long loses its state.
    """
    _, schema, kept = _schema(df, key, order, machine)
    names, n = list(machine.init), len(kept)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    out_names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = dict(zip(names, held.get)) if held.exists else dict(machine.init)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for row in rows[[*kept, *machine.inputs]].astype(object).itertuples(index=False, name=None):
            made = machine.step(state, *row[n:])
            if made is not None:
                out.append((*row[:n], *made))
        held.update(tuple(state[x] for x in names))
        if expire:
            held.setTimeoutDuration(int(expire))
        yield pd.DataFrame(out, columns=out_names)

    return df.groupBy(key).applyInPandasWithState(run, schema, machine.state, "append", timeout)


def recovery(clear: int = 3, window: int = 10, progress: float = 5.0, deviation: float = 30.0, most: int = 10_000, still: float = 0.5, stuck: int = 5) -> Machine:
    """The status of a drive: collision_unrecovered, success, off_route, max_frames or unjustified_stall end it; else recovering or running.

    A new collision (``total`` grew) arms the machine; its deadline and progress are those of the first one, and each
    new one begins the clear rows anew. It is recovered after ``clear`` clear rows, ``progress`` metres and on the route;
    at the deadline without that the drive ends. While armed, no other status does.
    """

    def step(s: dict, total: int, place: float, off: float, reached: bool, speed: float, justified: bool) -> tuple | None:
        if s["ended"]:
            return None
        s["tick"] += 1
        hit, s["total"] = total > s["total"], total
        status = "running"
        if hit:
            if not s["active"]:
                s["active"], s["deadline"], s["begun"] = True, s["tick"] + window, float(place)
            s["clear"] = 0
        elif s["active"]:
            s["clear"] += 1
        if s["active"]:
            status = "recovering"
            if s["clear"] >= clear and place - s["begun"] >= progress and off <= deviation:
                s["active"], status = False, "running"
            elif s["tick"] >= s["deadline"]:
                s["ended"] = True
                return ("collision_unrecovered", s["stuck"])
        if not s["active"]:
            s["stuck"] = s["stuck"] + 1 if speed < still and not justified else 0
            ends = "success" if reached else "off_route" if off > deviation else "max_frames" if s["tick"] >= most else "unjustified_stall" if s["stuck"] >= stuck else None
            if ends:
                s["ended"], status = True, ends
        else:
            s["stuck"] = 0
        return (status, s["stuck"])

    init = {"ended": False, "tick": 0, "total": 0, "active": False, "deadline": 0, "begun": 0.0, "clear": 0, "stuck": 0}
    return Machine(("total", "place", "off", "reached", "speed", "justified"), init, step, "status string, stuck int", "ended boolean, tick long, total long, active boolean, deadline long, begun double, clear long, stuck int")


def segmenter(capacity: int, keep: bool, align: int = 8) -> Machine:
    """Segments of a bounded size: a frame whose padded end doesn't fit closes the segment; it begins the next (``keep``) or is dropped.

    A frame larger than a whole segment fits nowhere: it is refused, and closes nothing.
    """

    def step(s: dict, size: int) -> tuple:
        size = -(-int(size) // align) * align
        if size > capacity:
            return (s["segment"], s["used"], False)
        stored = True
        if s["used"] + size > capacity:
            s["segment"] += 1
            s["used"] = 0
            stored = keep
        if stored:
            s["used"] += size
        return (s["segment"], s["used"], stored)

    return Machine(("size",), {"used": 0, "segment": 0}, step, "segment long, used long, stored boolean", "used long, segment long")


def pid(kp: float, ki: float, kd: float, limit: float, smooth: float, dt: float = 0.1, deadband: float = 0.3, throttle: float = 0.75, brake: float = 1.0) -> Machine:
    """Throttle, brake and steer of a speed controller.

    The integral is of error times ``dt``, within ``limit``; the error before the first is 0. A positive effort is
    throttle, a negative one brake, each up to its limit; a target in the deadband brakes a car that is faster than it.
    The steer is low-passed by ``smooth``.
    """

    def step(s: dict, target: float, speed: float, steer: float) -> tuple:
        e = float(target) - float(speed)
        s["sum"] = min(limit, max(-limit, s["sum"] + e * dt))
        effort = kp * e + ki * s["sum"] + kd * (e - s["last"]) / dt
        s["last"] = e
        if target <= deadband < speed:
            effort = min(effort, -brake)
        s["steer"] = smooth * s["steer"] + (1 - smooth) * min(1.0, max(-1.0, float(steer)))
        return (min(throttle, max(0.0, effort)), min(brake, max(0.0, -effort)), s["steer"])

    return Machine(("target", "speed", "steer"), {"sum": 0.0, "last": 0.0, "steer": 0.0}, step, "throttle double, brake double, steered double", "sum double, last double, steer double")


def navigator(route: list[tuple[float, float]], ahead: int, target: float = 10.0, done: float = 3.0) -> Machine:
    """Progress along a route: the nearest of the next ``ahead`` points, never backwards, the first of equal ones.

    Gives the index, the deviation from its point, the share of the route, the target ``target`` metres on in the car's
    frame, and whether the end is within ``done``.
    """
    arc = [0.0]
    for (ax, ay), (bx, by) in zip(route, route[1:]):
        arc.append(arc[-1] + math.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay)))

    def step(s: dict, x: float, y: float, yaw: float) -> tuple:
        i = s["index"]
        d2 = lambda k: (route[k][0] - x) * (route[k][0] - x) + (route[k][1] - y) * (route[k][1] - y)
        near = s["index"] = min(range(i, min(i + ahead, len(route))), key=lambda k: (d2(k), k))
        tx, ty = route[min(bisect_left(arc, arc[near] + target), len(route) - 1)]
        c, w = math.cos(math.radians(yaw)), math.sin(math.radians(yaw))
        return (near, math.sqrt(d2(near)), arc[near] / max(arc[-1], 2.220446049250313e-16), c * (tx - x) + w * (ty - y), c * (ty - y) - w * (tx - x), math.sqrt(d2(len(route) - 1)) <= done)

    return Machine(("x", "y", "yaw"), {"index": 0}, step, "index int, deviation double, completion double, target_x double, target_y double, reached boolean", "index int")


def waypoint_queue(route: list[tuple[float, float]], base: float = 3.0, per_speed: float = 0.5) -> Machine:
    """A queue of waypoints of which those nearer than base + per_speed * speed go, from the front; gives how many are gone and left."""

    def step(s: dict, x: float, y: float, speed: float) -> tuple:
        reach = base + per_speed * speed
        last = len(route) - 1
        # the last waypoint goes only when it is reached closely
        while s["gone"] <= last:
            px, py = route[s["gone"]]
            if math.sqrt((px - x) * (px - x) + (py - y) * (py - y)) < (1.0 if s["gone"] == last else reach):
                s["gone"] += 1
            else:
                break
        return (s["gone"], last + 1 - s["gone"])

    return Machine(("x", "y", "speed"), {"gone": 0}, step, "gone int, remaining int", "gone int")


def walker(radius: float) -> Machine:
    """A walker that takes the offered target when it has none or is strictly nearer to its own than ``radius``."""

    def step(s: dict, x: float, y: float, offer_x: float, offer_y: float) -> tuple:
        near = not s["has"] or math.sqrt((s["tx"] - x) * (s["tx"] - x) + (s["ty"] - y) * (s["ty"] - y)) < radius
        if near:
            s["has"], s["tx"], s["ty"] = True, float(offer_x), float(offer_y)
            s["turns"] += 1
        return (near, s["tx"], s["ty"], s["turns"])

    return Machine(("x", "y", "offer_x", "offer_y"), {"has": False, "tx": 0.0, "ty": 0.0, "turns": 0}, step, "retargeted boolean, target_x double, target_y double, turns int", "has boolean, tx double, ty double, turns int")


def drive(tries: int = 3) -> Machine:
    """The loop over a drive's segments: ``partial`` keeps a segment and goes on, ``done`` keeps it and ends.

    ``collision`` discards the current segment and ends, unless nothing is kept yet: then a new try begins, up to
    ``tries`` of them, after which the drive has failed.
    """

    def step(s: dict, status: str) -> tuple | None:
        if s["ended"]:
            return None
        result = "going"
        if status == "partial":
            s["kept"] += 1
        elif status == "done":
            s["kept"] += 1
            s["ended"], result = True, "finished"
        elif status == "collision":
            if s["kept"]:
                s["ended"], result = True, "cut"
            else:
                s["tried"] += 1
                s["ended"], result = s["tried"] >= tries, "failed" if s["tried"] >= tries else "retry"
        return (s["kept"], s["tried"], result)

    return Machine(("status",), {"ended": False, "kept": 0, "tried": 0}, step, "kept int, tried int, result string", "ended boolean, kept int, tried int")
