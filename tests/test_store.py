"""Scene stores on disk: commits, counts, modalities, resolving, appending, compacting."""

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.sources import store


def test_listing_and_resolving(tmp_path):
    assert store.list_scenes(str(tmp_path / "none")) == []
    for n in ("scene_2", "scene_10", "other"):
        (tmp_path / n).mkdir()
    assert [p.rsplit("/", 1)[1] for p in store.list_scenes(str(tmp_path))] == ["scene_10", "scene_2"]
    with pytest.raises(FileNotFoundError):
        store.scenes_below(str(tmp_path), ".pt")
    for n in ("scene_2/a.pt", "scene_10/b.pt", "scene_10/b.mesh.pt"):
        (tmp_path / n).write_text("")
    found = store.scenes_below(str(tmp_path), ".pt", (".mesh.pt",))
    assert [p.rsplit("/", 1)[1] for p in found] == ["b.pt", "a.pt"]
    assert store.resolve(None, found, ".pt") == found[0] and store.resolve("1", found, ".pt") == found[1] and store.resolve("a", found, ".pt") == found[1] and store.resolve(found[1], found, ".pt") == found[1]
    for bad, error in (("7", IndexError), ("zzz", FileNotFoundError)):
        with pytest.raises(error):
            store.resolve(bad, found, ".pt")
    (tmp_path / "other/a.pt").write_text("")
    with pytest.raises(ValueError):
        store.scenes_below(str(tmp_path), ".pt")


def test_scene_store(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 0, b"x", None), ("a", 1, None, 1.0), ("b", 0, None, 2.0)], "scene string, frame int, depth binary, lidar double")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "scene string")
    assert {tuple(r) for r in store.frame_counts(spark, path, "scene", names).collect()} == {("a", 0), ("b", 0), ("c", 0)}
    store.write_scenes(rows, path, "scene")
    assert {tuple(r) for r in store.frame_counts(spark, path, "scene", names).collect()} == {("a", 2), ("b", 1), ("c", 0)}
    back = store.read_scenes(spark, path, "scene")
    assert store.same_rows(back.select(*rows.columns), rows)
    assert store.read_scenes(spark, path, "scene", ["lidar", "flow"], ["frame"]).columns == ["scene", "frame", "lidar"]
    assert {tuple(r) for r in store.available(back, "scene", "frame", ["depth", "lidar", "flow"]).collect()} == {("a", True, False, False), ("b", False, True, False)}
    store.compact(spark, f"{path}/rows", str(tmp_path / "small"), 1)
    assert store.same_rows(spark.read.parquet(str(tmp_path / "small")).select(*rows.columns), rows)


def test_compaction_keeps_nothing_that_differs(spark, tmp_path, monkeypatch):
    spark.range(9).write.parquet(str(tmp_path / "a"))
    monkeypatch.setattr(store, "same_rows", lambda a, b: False)
    with pytest.raises(ValueError):
        store.compact(spark, str(tmp_path / "a"), str(tmp_path / "b"), 1)
    assert not (tmp_path / "b").exists()


def test_append_timeline(spark, tmp_path):
    spark.createDataFrame([("a", "t1", None), ("b", "t2", "x")], "scene string, map string, note string").write.parquet(str(tmp_path / "meta"))
    steps = spark.createDataFrame([("a", 0, 1.0)], "scene string, step int, cost double")
    store.append_timeline(spark, str(tmp_path), "scene", spark.createDataFrame([("a", "new", True)], "scene string, note string, terminal boolean"), steps)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "meta")).select("scene", "map", "note", "terminal").collect()} == {("a", "t1", "new", True), ("b", "t2", "x", None)}
    assert spark.read.parquet(str(tmp_path / "steps")).count() == 1
    with pytest.raises(ValueError):
        store.append_timeline(spark, str(tmp_path), "scene", spark.createDataFrame([("zz", "new")], "scene string, note string"), steps)


def test_logs_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("run", 1)], "status string, step int")
    store.write_log(df, str(tmp_path / "log"))
    store.write_log(df, str(tmp_path / "log"))
    lines = spark.read.text(str(tmp_path / "log")).union(spark.createDataFrame([("not json",)], "value string"))
    got = store.parse_lines(lines, "value", "status string, step int").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("run", 1), ("run", 1), (None, None)], key=str)


def test_names(spark):
    df = spark.createDataFrame([("a/epoch_3.pt",), ("a/epoch-12.pth",), ("a/last.pt",)], "p string")
    assert tuple(T.latest(df, "p").first()) == ("a/epoch-12.pth", 12) and T.latest(df.where("p like '%last%'"), "p").collect() == []
    names = spark.createDataFrame([("scene_000007",), ("scene_x",), ("odd",)], "n string")
    assert T.next_number(names, "n").first().next == 8 and T.next_number(names.limit(0), "n").first().next == 0
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.padded("s_", F.lit(1234567))) == "s_1234567" and one(T.map_name(F.lit("Town_Opt"))) == "Town"
    assert one(T.merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(9)))) == {"a": 1, "b": 9}
