"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from gridloom.plans import catalogue, costs, datasets, frames, losses, scenes, state  # noqa: F401 - they register their queries

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES:
        p = f"{SF}/{n}.parquet"
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(df.astype(object).where(df.notna(), None).itertuples(index=False, name=None), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_others_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_whole_polyline_queries_take_all_users(spark, duck):
    """Each customer whose user has a segment is matched, and each such user is somebody's."""
    got = {r.c_custkey for r in catalogue.QUERIES["polyline_match"](spark, SF).collect()}
    n = duck.execute("SELECT max(user_id) + 1 FROM events").fetchone()[0]
    tracks = {u for (u,) in duck.execute("SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 1").fetchall()}
    customers = {c for (c,) in duck.execute("SELECT c_custkey FROM customer").fetchall()}
    assert got == {c for c in customers if c % n in tracks}
    assert {c % n for c in got} == tracks & {c % n for c in customers} and any(u % 3 for u in tracks)


def test_asof_lerp_asks_over_the_whole_span(spark, tmp_path):
    """A user whose events span 45 days has 46 values."""
    ts = [pd.Timestamp("2024-01-01"), pd.Timestamp("2024-01-11"), pd.Timestamp("2024-02-15")]
    pd.DataFrame({"event_id": [1, 2, 3], "user_id": [7, 7, 7], "event_type": ["a"] * 3, "value": [0.0, 10.0, 45.0], "props": ["{}"] * 3, "ts": pd.Series(ts, dtype="datetime64[us]")}).to_parquet(tmp_path / "events.parquet")
    got = sorted((r.at_t, r.value) for r in catalogue.QUERIES["asof_lerp"](spark, str(tmp_path)).collect())
    assert [v for _, v in got] == [float(k) for k in range(46)]
