"""Mesh topology over triangle tables (face, a, b, c)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_faces(faces: DataFrame) -> DataFrame:
    """Faces without repeated rows. They go to their tasks first: hardly any repeat, and to look for them in the order of the file takes memory for all that a task reads."""
    return faces.repartition(int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "face").distinct()


def edges(faces: DataFrame) -> DataFrame:
    """(u, v, n): undirected edges and the number of faces at each."""
    pair = lambda p, q: F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v"))
    each = faces.select(F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("e"))
    return each.groupBy("e.u", "e.v").agg(F.count("*").alias("n"))


def topology(faces: DataFrame) -> DataFrame:
    """Counts of boundary, regular and non-manifold edges, and whether the mesh is closed."""
    return edges(faces).agg(
        F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") == 2).alias("regular"), F.count_if(F.col("n") > 2).alias("non_manifold"), (F.count("*") == F.count_if(F.col("n") == 2)).alias("closed")
    )


def clean(faces: DataFrame) -> DataFrame:
    """Faces without a repeated corner, of the same corners only the first."""
    corners = F.array_sort(F.array("a", "b", "c"))
    return faces.where("a != b and b != c and a != c").groupBy(corners.alias("k")).agg(F.min_by(F.struct("face", "a", "b", "c"), "face").alias("m")).select("m.*")


def normals(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, nx, ny, nz): the normalised sum of the normals of the faces at each vertex (v, x, y, z)."""
    out = faces
    for k in "abc":
        out = out.join(vertices.select(F.col("v").alias(k), *(F.col(x).alias(f"{x}{k}") for x in "xyz")), k)
    u, w = [F.col(f"{x}b") - F.col(f"{x}a") for x in "xyz"], [F.col(f"{x}c") - F.col(f"{x}a") for x in "xyz"]
    cross = (u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0])
    each = out.select(F.explode(F.array("a", "b", "c")).alias("v"), *(c.alias(n) for c, n in zip(cross, ("x", "y", "z"))))
    sums = each.groupBy("v").agg(*(F.sum(n).alias(n) for n in "xyz"))
    size = F.greatest(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2), F.lit(1e-12))
    return sums.select("v", *((F.col(n) / size).alias(f"n{n}") for n in "xyz"))


def prune(faces: DataFrame, supported: DataFrame) -> DataFrame:
    """Faces whose three corners are all in ``supported`` (v)."""
    out = faces
    for k in "abc":
        # looked up by hash, so the faces aren't sorted anew for each corner
        out = out.join(supported.select(F.col("v").alias(k)).hint("shuffle_hash"), k, "left_semi")
    return out.select(*faces.columns)


def merged(faces: DataFrame, vertices: DataFrame, least_area: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) with vertices of the same place merged into the one of least number, and faces cleaned.

    Faces that repeat a corner or whose area is at most ``least_area`` go; of the same corners the first stays; vertices
    that no face has go too.
    """
    keep = vertices.groupBy("x", "y", "z").agg(F.min("v").alias("to"), F.collect_set("v").alias("vs"))
    names = keep.select(F.explode("vs").alias("v"), "to", "x", "y", "z")
    out = faces
    for k in "abc":
        out = out.join(names.select(F.col("v").alias(k), F.col("to").alias(f"_{k}"), *(F.col(x).alias(f"{x}{k}") for x in "xyz")), k)
    u, w = [F.col(f"{x}b") - F.col(f"{x}a") for x in "xyz"], [F.col(f"{x}c") - F.col(f"{x}a") for x in "xyz"]
    cross = (u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0])
    area = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2
    kept = clean(out.where(area > least_area).select("face", *(F.col(f"_{k}").alias(k) for k in "abc")))
    used = kept.select(F.explode(F.array("a", "b", "c")).alias("v")).distinct()
    return kept, keep.select(F.col("to").alias("v"), "x", "y", "z").join(used, "v", "left_semi")


def least_spread(points: DataFrame, key: str, xyz: list[str]) -> DataFrame:
    """(key, n, least): the smallest eigenvalue of the points' covariance (population), by the closed form of three by three.

    A flat or straight group has 0; one point has 0.
    """
    x, y, z = xyz
    cov = points.groupBy(key).agg(F.count("*").alias("n"), *(F.covar_pop(p, q).alias(n) for p, q, n in ((x, x, "a"), (y, y, "b"), (z, z, "c"), (x, y, "d"), (y, z, "e"), (x, z, "f"))))
    a, b, c, d, e, f = (F.col(n) for n in "abcdef")
    q = (a + b + c) / 3
    p = F.sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6)
    A, B, G = (a - q), (b - q), (c - q)
    det = A * (B * G - e * e) - d * (d * G - e * f) + f * (d * e - B * f)
    r = F.least(F.greatest(det / (2 * F.when(p > 0, p * p * p)), F.lit(-1.0)), F.lit(1.0))
    # the least root of the cosine form lies a third of a turn on
    least = q + 2 * p * F.cos(F.acos(r) / 3 + 2 * math.pi / 3)
    return cov.select(key, "n", F.greatest(F.when(p > 0, least).otherwise(q), F.lit(0.0)).alias("least"))
