"""The catalogue's queries over all rows, against small tables worked out by hand."""

import datetime as dt

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from skygrain.operators import grids
from skygrain.plans import catalogue


def _put(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")


def test_every_station_is_observed(spark, tmp_path):
    _put(spark, tmp_path, "supplier", [(i,) for i in range(30)], "s_suppkey long")
    _put(spark, tmp_path, "embeddings", [(1, [i / 64 for i in range(64)])], "vec_id long, embedding array<float>")
    found = {r.station_id: r.aot for r in catalogue.raster_point_lookup(spark, str(tmp_path)).collect()}
    for i in range(30):
        r, c = ((21.2 - (21.3 - i % 13 * 0.043)) // 0.05, ((104.93 + i % 11 * 0.047) - 105.0) // 0.05)
        assert found[i] == ((r * 8 + c) / 64 if 0 <= r <= 7 and 0 <= c <= 7 else None), i
    gated = catalogue.station_observations(spark, str(tmp_path))
    assert gated.groupBy("station_id").agg(F.countDistinct("tag").alias("n")).filter("n = 6").count() == 30


def _many_stations(spark, tmp_path):
    """24001 stations, one without a key, and 60 granules of one file, one of them without a key."""
    _put(spark, tmp_path, "supplier", [(i * 7919,) for i in range(24_000)] + [(None,)], "s_suppkey long")
    spark.createDataFrame([(i or None, [(i * 64 + k) / 8192 for k in range(64)]) for i in range(60)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")


def _differences(found, spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    for t in ("supplier", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    con.execute(f"CREATE TABLE want AS {catalogue.ORACLES[name]}")
    con.execute(f"CREATE TABLE found AS SELECT {', '.join(found.columns)} FROM '{tmp_path}/out-{name}/*.parquet'")
    return con.execute("SELECT (SELECT count(*) FROM (FROM want EXCEPT ALL FROM found)) + (SELECT count(*) FROM (FROM found EXCEPT ALL FROM want))").fetchone()[0]


def test_lookups_of_many_stations_take_little_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grids, "TASK_ROWS", 500_000, raising=False)
    _many_stations(spark, tmp_path)
    found = catalogue.raster_point_lookup(spark, str(tmp_path))
    found.write.parquet(f"{tmp_path}/out-raster_point_lookup")
    size = sum(f.stat().st_size for f in (tmp_path / "out-raster_point_lookup").glob("*.parquet"))
    assert size < 2.5 * 24_001 * 60, size
    assert _differences(found, spark, tmp_path, "raster_point_lookup") == 0


def test_observations_of_many_stations_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grids, "TASK_ROWS", 500_000, raising=False)
    _many_stations(spark, tmp_path)
    found = catalogue.station_observations(spark, str(tmp_path))
    found.write.parquet(f"{tmp_path}/out-station_observations")
    rows = [pq.read_metadata(f).num_rows for f in (tmp_path / "out-station_observations").glob("*.parquet")]
    assert sum(rows) == 24_001 * 60 * 6
    assert max(rows) < sum(rows) / 4, rows
    assert _differences(found, spark, tmp_path, "station_observations") == 0


def test_observations_of_many_stations_are_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(grids, "TASK_ROWS", 4_000_000, raising=False)
    _many_stations(spark, tmp_path)
    found = catalogue.station_observations(spark, str(tmp_path))
    assert "cast(granule_id" not in found._jdf.queryExecution().optimizedPlan().toString()  # else parsed for every row
    found.write.parquet(f"{tmp_path}/out-station_observations")
    size = sum(f.stat().st_size for f in (tmp_path / "out-station_observations").glob("*.parquet"))
    assert size < 0.5 * 24_001 * 60 * 6, size
    assert _differences(found, spark, tmp_path, "station_observations") == 0


def test_gaps_of_all_arrivals(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    hours = [*range(0, 10), *range(20, 30), *range(60, 70)]  # gaps of 10 and 30 hours; the subset would have more
    events = [(start + dt.timedelta(hours=h, minutes=h % 60), "error" if h % 3 else "view", h) for h in hours]
    _put(spark, tmp_path, "events", events, "ts timestamp_ntz, event_type string, user_id long")
    days = [d for d in range(20) if d != 12]
    _put(spark, tmp_path, "orders", [(start + dt.timedelta(days=d), d) for d in days], "o_orderdate timestamp_ntz, o_custkey long")
    found = catalogue.hour_gap_scan(spark, str(tmp_path)).orderBy("gap_start").collect()
    assert [(r.gap_start, r.n) for r in found] == [(start + dt.timedelta(hours=10), 10), (start + dt.timedelta(hours=30), 30)]
    assert catalogue.resume_cursor(spark, str(tmp_path)).first().resume_at == start + dt.timedelta(hours=30)
    assert catalogue.first_gap_prefix(spark, str(tmp_path)).count() == 12


def test_pivot_has_every_day(spark, tmp_path):
    start = dt.datetime(2024, 1, 5)
    _put(spark, tmp_path, "events", [(d % 2, start + dt.timedelta(days=d), float(d)) for d in range(30)], "user_id long, ts timestamp_ntz, value double")
    wide = catalogue.station_time_pivot(spark, str(tmp_path))
    assert wide.columns == ["user_id", *[f"AOT_{start + dt.timedelta(days=d):%Y%m%d}" for d in range(30)]]
    assert sum(v is not None for r in wide.collect() for v in r[1:]) == 30
