"""Scene stores: discovery, frame indexes, manifests of finished work, and sinks."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def discover(spark: SparkSession, root: str, glob: str = "*", without: str | None = None) -> DataFrame:
    """(name, path, size, modified) of files below ``root`` in order of path; names that end with ``without`` are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    out = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return (out if without is None else out.where(~F.col("name").endswith(without))).select("name", "path", "size", "modified").orderBy("path")


def duplicates(names: DataFrame, name: str) -> DataFrame:
    """Names that occur more than once."""
    return names.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def frame_index(scenes: DataFrame, scene: str, frames: str) -> DataFrame:
    """(scene, frame): one row for each frame; scenes of no frames, or of an unknown number, have none."""
    return scenes.where(F.coalesce(F.col(frames), F.lit(0)) > 0).select(scene, F.explode(F.sequence(F.lit(0), (F.col(frames) - 1).cast("int"))).alias("frame"))


def fingerprint(df: DataFrame, columns: list[str], name: str = "fingerprint") -> DataFrame:
    """SHA-256 of the named columns as a JSON object, in that order; nulls are written."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the folder that spark.checkpoint.dir names; a folder of our own only in a local session that names none."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
    return df.checkpoint(eager=True)


def unfinished(work: DataFrame, manifest: DataFrame, key: str, fingerprint_col: str = "fingerprint") -> DataFrame:
    """Work whose key isn't in the manifest as done with the same fingerprint."""
    done = manifest.where("status = 'done'").select(key, fingerprint_col)
    return work.join(done, [key, fingerprint_col], "left_anti")


def list_scenes(root: str, prefix: str = "scene_") -> list[str]:
    """Scene folders below ``root`` in order of name; none where there is no such root."""
    base = Path(root)
    return sorted(str(p.resolve()) for p in base.iterdir() if p.is_dir() and p.name.startswith(prefix)) if base.is_dir() else []


def scenes_below(root: str, suffix: str, without: tuple[str, ...] = ()) -> list[str]:
    """Files and folders of the suffix at any depth, in order; an error without any, or where two have one name."""
    found = sorted(str(p.resolve()) for p in Path(root).rglob(f"*{suffix}") if not p.name.endswith(without)) if Path(root).is_dir() else []
    if not found:
        raise FileNotFoundError(f"nothing that ends with {suffix} below {root}")
    names = [Path(p).name for p in found]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"names that occur more than once: {', '.join(twice)}")
    return found


def resolve(spec: str | None, found: list[str], suffix: str) -> str:
    """One of the files: the first for no spec, a path that exists, a place by number, or a unique stem."""
    if not found:
        raise FileNotFoundError("there are no files")
    if not spec:
        return found[0]
    if Path(spec).exists():
        return str(Path(spec).resolve())
    if spec.isdigit():
        if int(spec) >= len(found):
            raise IndexError(f"{spec} of {len(found)} files")
        return found[int(spec)]
    stems = [p for p in found if Path(p).name in (spec, spec + suffix)]
    if len(stems) != 1:
        raise FileNotFoundError(f"{spec} names {len(stems)} files")
    return stems[0]


def write_scenes(df: DataFrame, path: str, key: str) -> None:
    """Rows by scene, and then the counts of each: a scene is there only when its count is."""
    df.write.mode("overwrite").partitionBy(key).parquet(f"{path}/rows")
    df.groupBy(key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/counts")


def frame_counts(spark: SparkSession, path: str, key: str, names: DataFrame) -> DataFrame:
    """(key, n) of the named scenes from the counts alone; 0 for one that isn't there or isn't finished."""
    try:
        counts = spark.read.parquet(f"{path}/counts")
    except AnalysisException:
        return names.select(key, F.lit(0).cast("long").alias("n"))
    return names.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def read_scenes(spark: SparkSession, path: str, key: str, modalities: list[str] | None = None, always: list[str] | None = None) -> DataFrame:
    """Rows with the key, the columns read always, and those modalities that are wanted and there (None: all)."""
    rows = spark.read.parquet(f"{path}/rows")
    if modalities is None:
        return rows
    wanted = [key, *(always or []), *modalities]
    return rows.select(*(c for c in dict.fromkeys(wanted) if c in rows.columns))


def available(rows: DataFrame, key: str, frame: str, modalities: list[str]) -> DataFrame:
    """(key, one flag a modality): whether the scene's first frame has it; a column that isn't there is not available."""
    have = [F.min_by(F.col(m).isNotNull(), frame).alias(m) if m in rows.columns else F.lit(False).alias(m) for m in modalities]
    return rows.groupBy(key).agg(*have)


def with_fallback(rows: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Rows of their own series; for keys without any, those of the legacy one."""
    return rows.unionByName(legacy.join(rows.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def identities(meta: DataFrame, key: str) -> DataFrame:
    """(key, map, controller, start_idx, end_idx) of scenes that are complete; the expert is the default controller.

    Scenes without a map or a route have none, nor has a model's segment that isn't the last of its drive.
    """
    rows = meta.withColumn("controller", F.coalesce("controller", F.lit("behavior_agent")))
    whole = (F.col("map") != "") & F.col("start_idx").isNotNull() & F.col("end_idx").isNotNull() & F.coalesce("complete", F.lit(True))
    return rows.where(whole & ((F.col("controller") != "model") | F.coalesce("terminal", F.lit(False)))).select(key, "map", "controller", "start_idx", "end_idx")


def append_timeline(spark: SparkSession, path: str, key: str, meta: DataFrame, steps: DataFrame) -> None:
    """Give scenes that are there a model's steps, and their metadata the new values (which win); others are an error.

    Both are written beside the rows, the merged metadata last.
    """
    old = spark.read.parquet(f"{path}/meta")
    if not meta.join(old, key, "left_anti").isEmpty():
        raise ValueError("a scene to extend isn't there")
    new = meta.select(F.col(key), *(F.col(c).alias(f"_n_{c}") for c in meta.columns if c != key))
    names = [c for c in dict.fromkeys([*old.columns, *meta.columns]) if c != key]
    value = lambda c: F.coalesce(*([F.col(f"_n_{c}")] if c in meta.columns else []), *([F.col(c)] if c in old.columns else [])).alias(c)
    merged = checkpointed(old.join(new, key, "left").select(key, *(value(c) for c in names)))
    steps.write.mode("overwrite").partitionBy(key).parquet(f"{path}/steps")
    merged.write.mode("overwrite").parquet(f"{path}/meta")


def compact(spark: SparkSession, path: str, out: str, files: int) -> None:
    """Rewrite a table in fewer files; an error, and nothing kept, unless both hold the same rows."""
    rows = spark.read.parquet(path)
    rows.coalesce(files).write.mode("overwrite").parquet(out)
    if not same_rows(rows, spark.read.parquet(out)):
        place = spark._jvm.org.apache.hadoop.fs.Path(out)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        raise ValueError("the rewritten table differs")


def coverage(expected: DataFrame, compatible: DataFrame) -> DataFrame:
    """One row: how many distinct expected keys ``k`` are compatible, how many there are, and the share (0 of none)."""
    both = expected.select("k").distinct().join(compatible.select("k").distinct().withColumn("_c", F.lit(1)), "k", "left")
    return both.agg(F.count("_c").alias("compatible"), F.count("*").alias("expected")).withColumn("coverage", F.coalesce(F.try_divide("compatible", "expected"), F.lit(0.0)))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_log(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("append").json(path)


def parse_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    return lines.select(F.from_json(column, schema).alias("m")).select("m.*")
