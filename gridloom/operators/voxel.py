"""Voxel aggregation. Spark adds up partial sums before the shuffle; ties of the majority go to the smallest tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.store import checkpointed


def cells(axes: dict[str, tuple[Column, float]]) -> list[Column]:
    """Cell numbers by axis: floor(x / size), also below zero."""
    return [F.floor(x / F.lit(size)).alias(name) for name, (x, size) in axes.items()]


def aggregate(points: DataFrame, axes: dict[str, tuple[Column, float]], tag: str) -> DataFrame:
    """Per cell: count, centroid and majority tag."""
    keys, xs = list(axes), [x for x, _ in axes.values()]
    rows = points.select(*cells(axes), F.col(tag).alias("tag"), *(x.cast("double").alias(f"x{k}") for k, x in enumerate(xs)))
    by_tag = rows.groupBy(*keys, "tag").agg(F.count("*").alias("_c"), *(F.sum(f"x{k}").alias(f"_s{k}") for k in range(len(xs))))
    return by_tag.groupBy(*keys).agg(
        F.sum("_c").alias("n_points"),
        *((F.sum(f"_s{k}") / F.sum("_c")).alias(f"c_{name}") for k, name in enumerate(keys)),
        F.min_by("tag", F.struct(-F.col("_c"), "tag")).alias("majority"),
    )


def statistics(points: DataFrame, axes: dict[str, tuple[Column, float]]) -> DataFrame:
    """Per cell: occupancy, and mean and population deviation of the offsets from the cell's centre (0 for one point)."""
    offsets = [(x - (F.floor(x / F.lit(size)) + 0.5) * size).alias(f"o{k}") for k, (x, size) in enumerate(axes.values())]
    rows = points.select(*cells(axes), *offsets)
    out = [F.coalesce(g, F.lit(0.0)).alias(f"{p}_{name}") for k, name in enumerate(axes) for p, g in (("mean", F.avg(f"o{k}")), ("std", F.stddev_pop(f"o{k}")))]
    return rows.groupBy(*axes).agg(F.count("*").alias("n_points"), *out)


def neighbours(df: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """Each row once for every cell within ``reach``: the cell in ``keys``, and the offset's order in ``offset_ord``."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    out = df.withColumn("offset_ord", F.lit(0))
    for k in keys:
        out = out.withColumn("_step", F.explode(steps)).withColumn(k, F.col(k) + F.col("_step")).withColumn("offset_ord", F.col("offset_ord") * (2 * reach + 1) + F.col("_step") + reach)
    return out.drop("_step")


def band(surface: DataFrame, keys: list[str], reach: int, most: int | None = None) -> DataFrame:
    """Distinct cells within ``reach`` of the surface's; more than ``most`` raise."""
    out = neighbours(surface.select(*keys), keys, reach).select(*keys).distinct()
    if most is None:
        return out
    # the band is made once, and its count comes with the writing
    out = checkpointed(out)
    if (n := out.count()) > most:
        raise ValueError(f"{n} cells; {most} at most")
    return out


def nearest_in_reach(queries: DataFrame, points: DataFrame, keys: list[str], position: dict[str, tuple[str, str]], reach: int, radius: float, value: str) -> DataFrame:
    """For each query cell the value and distance of the nearest point in cells within ``reach``; null beyond the radius.

    ``position`` maps an axis to the columns of the query and the point. Equal distances go to the first offset, then to the least value.
    """
    # points of one place are as near; only the least value counts
    points = points.groupBy(*keys, *(b for _, b in position.values())).agg(F.min(value).alias(value))
    asked = neighbours(queries.withColumns({f"_q{k}": F.col(k) for k in keys}), keys, reach)
    d = F.sqrt(sum(((F.col(f"q.{a}") - F.col(f"p.{b}")) ** 2 for a, b in position.values()), F.lit(0.0)))
    found = asked.alias("q").join(points.alias("p"), [F.col(f"q.{k}") == F.col(f"p.{k}") for k in keys], "left")
    best = found.select(*(F.col(f"q._q{k}").alias(k) for k in keys), F.struct(d.alias("d"), F.col("q.offset_ord").alias("o"), F.col(f"p.{value}").alias("v")).alias("m"))
    near = F.min(F.when(F.col("m.d") <= radius, F.col("m")))
    return best.groupBy(*keys).agg(near.alias("m")).select(*keys, F.col("m.v").alias(value), F.col("m.d").alias("distance"))
