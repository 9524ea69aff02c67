"""Semantic, differential and streaming tests of the observation engine."""

import math
import os

import pytest
from pyspark.sql import functions as F

from skygrain.functions import names
from skygrain.operators import gaps, grids, listing, recency, timeseries
from skygrain.plans import catalogue
from skygrain.sources import archive

SF = "/root/testdata/sf0.001"


def test_catalogue_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    norm = lambda rows: sorted(repr([float(f"{v:.9g}") if isinstance(v, float) else v for v in r]) for r in rows)
    for name, sql in catalogue.ORACLES.items():
        df = catalogue.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        want = con.sql(sql)
        assert cols == sorted(want.columns), name
        assert norm(tuple(r[c] for c in cols) for r in df.collect()) == norm(want.select(*[f'"{c}"' for c in cols]).fetchall()), name


def _granule(spark):
    nan = float("nan")
    unc = [0.2] * 16
    unc[0], unc[10], unc[15] = 0.7, nan, 1.1
    row = ("g", None, 4, 4, 105.0, 21.2, 0.05, 0.05, [0.1 * i for i in range(16)], unc)
    return spark.createDataFrame([row], "granule_id string, ts timestamp, height int, width int, x0 double, y0 double, dx double, dy double, aot array<float>, unc array<float>")


STATIONS = [(0, 21.18, 105.02), (1, 21.09, 105.12), (2, 21.03, 105.17), (3, 21.27, 105.02), (4, 21.18, 105.32)]


def _gated(spark, granules):
    stations = spark.createDataFrame(STATIONS, "station_id int, latitude double, longitude double")
    rows = grids.fan_out(grids.sample(granules, stations)).collect()
    return {(r.station_id, r.tag): r.aot for r in rows}


def test_lookup_and_gate(spark):
    got = _gated(spark, _granule(spark))
    assert [got[0, t] for t in ("05", "07", "08", "1", "12", "15")] == [None, None, 0.0, 0.0, 0.0, 0.0]
    assert all(got[s, t] is None for s in (1, 3, 4) for t in ("05", "07", "08", "1", "12", "15"))
    assert [got[2, t] for t in ("05", "1")] == [None, None] and math.isclose(got[2, "12"], 1.5, rel_tol=1e-6)


def test_sample_is_the_same_in_any_blocks(spark):
    stations = spark.createDataFrame([*STATIONS, (5, -40.0, 10.0)], "station_id int, latitude double, longitude double")
    show = lambda df: sorted(map(repr, df.collect()))
    one, many, shuffled = (show(grids.sample(_granule(spark), stations, n, b)) for n, b in ((6, 10_000), (6, 2), (3_000_000, 1_000_000)))
    assert one == many == shuffled and len(one) == 6
    assert grids.sample(_granule(spark), stations.limit(0)).count() == 0


def test_outline_of_many_edges(spark):
    ring = [(105.1 + 0.09 * math.cos(2 * math.pi * k / 300), 21.1 + 0.09 * math.sin(2 * math.pi * k / 300)) for k in range(300)]
    edges = grids.rings_to_edges([ring])
    small = grids.rings_to_edges([ring[::10]])  # the same cells are inside
    many, few = (grids.pixels(grids.mask(_granule(spark), e)).orderBy("row", "col").collect() for e in (edges, small))
    assert len(edges) == 300 and [r.aot for r in many] == [r.aot for r in few]
    assert [r.aot is None for r in many[:2]] == [True, False]


def test_mask_modes(spark):
    edges = grids.rings_to_edges([[(105.0, 21.2), (105.2, 21.2), (105.0, 21.0)]])
    zero, null = (_gated(spark, grids.clip(_granule(spark), edges, m)) for m in ("zero", "null"))
    assert null[0, "08"] == 0.0 and null[2, "12"] is None
    assert zero[1, "05"] == 0.0 and zero[2, "05"] == 0.0


def test_names(spark):
    rows = [("a.nc",), ("a.NC",), ("3B-HHR-GIS.x.zip",), ("3b-hhr.zip.md5",), ("3B-DAY.zip",), ("M.h27v06.061.hdf",), ("M.h29v06.hdf",), ("M.h27v06.hdf.xml",)]
    df = spark.createDataFrame(rows, "n string")
    pick = lambda c: [r.n for r in df.filter(c).collect()]
    assert pick(names.is_grid(F.col("n"))) == ["a.nc"]
    assert pick(names.is_half_hourly(F.col("n"))) == ["3B-HHR-GIS.x.zip", "3b-hhr.zip.md5"]
    assert pick(names.is_tile(F.col("n"))) == ["M.h27v06.061.hdf"]
    urls = spark.createDataFrame([("https://a",), ("  # d",), ("",), ("# c",)], "value string")
    assert [r.url for r in listing.url_lines(urls).collect()] == ["https://a", "# d"]


def test_anti_joins(spark):
    remote = spark.createDataFrame([("X.nc",), ("Y.nc",), ("Z.nc",)], "name string")
    local = spark.createDataFrame([("aod_vietnam_X.tif", 1), ("Y.nc", 1)], "name string, length long")
    assert sorted(r.name for r in listing.missing_by_stem(remote, local).collect()) == ["Y.nc", "Z.nc"]
    files = spark.createDataFrame([("X.nc", 0), ("Y.nc", 9)], "name string, length long")
    assert sorted(r.name for r in listing.missing_by_name(remote, files, nonempty=True).collect()) == ["X.nc", "Z.nc"]
    assert [r.name for r in listing.missing_by_name(remote, files).collect()] == ["Z.nc"]


def test_gap_scan(spark):
    hours = [0, 1, 4, *range(30, 41)]
    line = gaps.spine(spark.createDataFrame([(h,) for h in hours], "h int").select(F.expr("timestamp_ntz '2024-01-01' + make_interval(0,0,0,0,h)").alias("ts")), "ts")
    assert [r.n for r in gaps.gaps(line).orderBy("gap_start").collect()] == [2, 25]
    assert gaps.resume_at(line, 24).first().resume_at.hour == 5
    assert gaps.before_first_gap(line, 24).count() == 3 and gaps.before_first_gap(line, 26).count() == len(hours)


def test_fifo(spark):
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate([1, 2, 1, 3, 1, 2])], "k string, s long, x long")
    assert recency.fifo_set(rows, "k", "s", "x", 2).first().held == [1, 2]
    seen = recency.SeenSet(2)
    assert [seen.add(x) for x in "abacab"] == [True, True, False, True, True, True]


def test_upsert_keeps_last(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "station_id int, ts string, aot double").withColumn("threshold", F.lit(0.5))
    new = spark.createDataFrame([(1, "a", 9.0)], "station_id int, ts string, aot double").withColumn("threshold", F.lit(0.5))
    assert sorted((r.station_id, r.aot) for r in timeseries.latest(old, new).collect()) == [(1, 9.0), (2, 2.0)]


def test_archive_source_and_fetch(spark, tmp_path):
    for day, files in (("2025/06/30", ["3B-HHR.a.zip"]), ("2025/07/01", ["3B-HHR.b.zip", "x.tif"])):
        (tmp_path / day).mkdir(parents=True)
        for f in files:
            (tmp_path / day / f).write_bytes(f.encode())
    archive.register(spark)
    options = {"root": str(tmp_path), "layout": "daily", "start": "2025-06-30 00:00:00", "end": "2025-07-04 00:00:00"}
    listed = spark.read.format("skygrain_archive").options(**options).load()
    assert listed.count() == 3
    july = listed.filter(F.col("part_ts") >= F.lit("2025-07-01").cast("timestamp"))
    got = archive.fetch(july.filter(names.is_half_hourly(F.col("name")))).collect()
    assert [(r.name, r.status, bytes(r.content)) for r in got] == [("3B-HHR.b.zip", "new", b"3B-HHR.b.zip")]
    stream = spark.readStream.format("skygrain_archive").options(**options).load()
    from skygrain.streaming.poll import run_once

    assert sorted(r.name for r in run_once(stream, spark).collect()) == sorted(r.name for r in listed.collect())


def test_sources_and_wide_tables(spark, tmp_path):
    import struct

    from skygrain.sources import decode

    ring = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i1i", 5, 0, 0, 2, 2, 1, 4, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = struct.pack(">i", 9994) + bytes(96) + struct.pack(">2i", 1, len(body) // 2) + body
    assert decode.shapefile_edges(shp) == grids.rings_to_edges([ring])
    assert decode.polygon_edges(spark, '{"type": "Polygon", "coordinates": [[[0,0],[0,2],[2,2],[0,0]]]}') == grids.rings_to_edges([ring])
    obs = spark.sql("SELECT 1 AS station_id, timestamp '2024-01-15 06:00:00' AS ts, float(0.5) AS threshold, 0.25D AS aot")
    stations = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, "b", 1.0, 2.0)], "station_id int, station_name string, latitude double, longitude double")
    decode.write_csv(timeseries.wide(obs, stations, 0.5, ["20240115_0600", "20240115_1200"]), f"{tmp_path}/wide")
    assert [tuple(r) for r in decode.read_wide(spark, f"{tmp_path}/wide", 0.5).collect()] == [tuple(r) for r in obs.collect()]
    lines = spark.createDataFrame([("size, name",), ("12, a.hdf",), (", b.hdf",)], "value string")
    assert [tuple(r) for r in listing.parse_csv_listing(lines, header="size, name").collect()] == [("a.hdf", 12), ("b.hdf", None)]
    text = spark.createDataFrame([('{"content": [{"name": "a", "size": 3}]}',), ("{}",)], "value string")
    assert [tuple(r) for r in listing.parse_json_listing(text).collect()] == [("a", 3)]
    (tmp_path / "held").mkdir()
    (tmp_path / "held" / "x.tif").write_bytes(b"123")
    assert [tuple(r) for r in listing.inventory(spark, f"{tmp_path}/held", "*.tif").collect()] == [("x.tif", 3)]
    assert listing.inventory(spark, f"{tmp_path}/none").count() == 0


def test_http_listing_and_fetch(tmp_path):
    import http.server
    import threading

    from skygrain.sources import transport

    (tmp_path / "d.csv").write_text("name, last_modified, size\na.hdf, x, 5\n")
    (tmp_path / "e.json").write_text('{"content": [{"name": "b.hdf", "size": 7}]}')
    handler = lambda *a: http.server.SimpleHTTPRequestHandler(*a, directory=str(tmp_path))
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        link = transport.connect("http", host=f"127.0.0.1:{server.server_port}", token="t")
        assert link.list("/d") == [("a.hdf", 5)] and link.list("/e") == [("b.hdf", 7)]
        assert link.fetch("/d.csv").startswith(b"name")
        with pytest.raises(transport.Missing):
            link.fetch("/none")
        server.shutdown()
    waits = []
    with pytest.raises(OSError):
        transport.attempt(lambda: (_ for _ in ()).throw(OSError("x")), 3, 1.0, True, waits.append)
    assert waits == [1.0, 2.0]


def test_archive_to_observations(spark, tmp_path):
    """Listing, fetch, decoding, clipping, sampling, gating and the table's update by stream, in two polls; the ledger tells where to resume."""
    import json

    from skygrain.sources import decode
    from skygrain.streaming import poll

    for day in ("2025/06/30", "2025/07/01"):
        (tmp_path / "archive" / day).mkdir(parents=True)
        grid = {"height": 4, "width": 4, "longitude": [105.0, 105.05, 105.1, 105.15], "latitude": [21.2, 21.15, 21.1, 21.05], "aot": [0.1 * i for i in range(16)], "unc": [0.2] * 16}
        (tmp_path / "archive" / day / "g.json").write_text(json.dumps(grid))
    archive.register(spark)
    at = {"root": f"{tmp_path}/archive", "layout": "daily", "start": "2025-06-30 00:00:00", "end": "2025-07-02 00:00:00"}
    got = archive.fetch(spark.read.format("skygrain_archive").options(**at).load(), throttle=0.01, batch_bytes=10).cache()
    assert sorted(r.status for r in got.collect()) == ["new", "new"]
    grids_ = decode.decode(got.withColumn("name", F.concat(F.date_format("part_ts", "yyyyMMdd"), F.lit(".json"))), decoders={".json": json.loads})
    granules = grids.georeference(grids.north_up(grids_)).withColumn("ts", F.to_timestamp(F.substring("granule_id", 1, 8), "yyyyMMdd"))
    grids.write_granules(granules, f"{tmp_path}/granules")
    stations = spark.createDataFrame(STATIONS, "station_id int, latitude double, longitude double")
    edges = grids.rings_to_edges([[(104.0, 22.0), (106.0, 22.0), (106.0, 20.0), (104.0, 20.0)]])
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/granules").schema).parquet(f"{tmp_path}/granules")
    for _ in range(2):  # the second poll finds a granule of a day again
        poll.start_observations(stream(), stations, edges, f"{tmp_path}/obs", f"{tmp_path}/check", available_now=True).awaitTermination()
        grids.write_granules(granules.filter("granule_id = '20250701.json'").withColumn("aot", F.transform("aot", lambda v: (v + 1).cast("float"))), f"{tmp_path}/granules")
    table = spark.read.parquet(f"{tmp_path}/obs").filter("station_id = 0 AND threshold = 0.5").orderBy("ts").collect()
    assert [round(r.aot, 6) for r in table] == [0.0, 1.0]
    assert spark.read.parquet(f"{tmp_path}/obs").count() == 2 * len(STATIONS) * 6
    ledger = got.select(F.lit("precipitation").alias("product"), "part_ts", "status").unionByName(spark.sql("SELECT 'precipitation' AS product, timestamp '2025-07-04 00:00:00' AS part_ts, 'existing' AS status"))
    assert str(poll.resume_from(ledger, "precipitation", "2025-07-09 00:00:00")) == "2025-07-02 00:00:00"
    assert str(poll.resume_from(ledger, "aerosol", "2025-07-09 00:00:00")) == "2025-07-09 00:00:00"


def test_streams_run(spark):
    assert catalogue.late_drop_stream(spark, SF).count() > 0
    batch = recency.SeenSet(20)
    rows = [r for r in spark.read.parquet(f"{SF}/events.parquet").filter("event_type = 'view'").orderBy("event_id").collect()]
    want = [r.event_id for r in rows if batch.add(r.user_id)]
    assert sorted(r.seq for r in catalogue.fifo_seen_stream(spark, SF).filter("key = 'view'").collect()) == want
