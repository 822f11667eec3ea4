"""Bird's-eye grids: envelopes, risk, fields. Grids are small and bounded by their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bev_cells(spark: SparkSession, rows: int, cols: int, x: tuple[float, float], y: tuple[float, float]) -> DataFrame:
    """(row, col, x, y): cell centres; row 0 is farthest ahead."""
    dx, dy = (x[1] - x[0]) / rows, (y[1] - y[0]) / cols
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    return grid.withColumns({"x": F.lit(x[1]) - (F.col("row") + 0.5) * dx, "y": F.lit(y[0]) + (F.col("col") + 0.5) * dy})


def envelope(points: DataFrame, bin: Column, distance: Column, bins: int) -> DataFrame:
    """(bin, reach): the greatest distance in each bearing bin, 0 in empty ones."""
    seen = points.groupBy(bin.cast("long").alias("bin")).agg(F.max(distance).alias("reach"))
    return points.sparkSession.range(bins).withColumnRenamed("id", "bin").join(seen, "bin", "left").select("bin", F.coalesce("reach", F.lit(0.0)).alias("reach"))


def beyond(cells: DataFrame, bin: Column, distance: Column, reach: DataFrame) -> DataFrame:
    """Cells with ``risk``: farther away (strictly) than their bin's reach."""
    return cells.withColumn("bin", bin.cast("long")).join(reach, "bin", "left").withColumn("risk", distance > F.coalesce("reach", F.lit(0.0)))


def nearest_squared(cells: DataFrame, points: DataFrame) -> DataFrame:
    """``cells`` (row, col, x, y) with ``d2``: the squared distance to the nearest of the points (px, py), null without points.

    The cells are a raster of a size that its parameters bound, so they go to the points, of which there may be any
    number; each task keeps one minimum a cell, and only those are shuffled.
    """
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    near = points.select("px", "py").distinct().join(F.broadcast(cells)).groupBy("row", "col").agg(F.min(d2).alias("d2"))
    return cells.join(near, ["row", "col"], "left")


def gaussian_field(cells: DataFrame, points: DataFrame, sigma: float) -> DataFrame:
    """The greatest of the Gaussians about the points (px, py) at each cell, which is that of the nearest; 0 without points."""
    value = F.exp(-F.col("d2") / (2 * sigma * sigma))
    return nearest_squared(cells, points).select("row", "col", F.coalesce(value, F.lit(0.0)).alias("value"))


def distance_field(cells: DataFrame, points: DataFrame, none: float) -> DataFrame:
    """Distance to the nearest foreground point; ``none`` without any."""
    return nearest_squared(cells, points).select("row", "col", F.coalesce(F.sqrt("d2"), F.lit(none)).alias("distance"))
