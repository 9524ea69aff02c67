"""Queries over the driver's tables, one for each operator of the inventory, with their SQL for DuckDB.

The tables hold no rasters: an embedding of 64 floats stands for a band of 8 x 8 cells, suppliers and
customers for stations, events for hourly arrivals, documents and labels for remote and local files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, raster
from ..operators import gaps, grids, listing, recency, timeseries

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, source FROM documents d WHERE regexp_matches(source, '(?i)SRC1.*') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def new_files_anti_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    wanted = docs.select("doc_id", "source").filter(F.rlike("source", F.lit("(?i)SRC1.*")))
    return listing.missing_by_name(wanted, labels, "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality > 0)")
def existing_nonempty_anti_join(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return listing.missing_by_name(docs.select("doc_id", "source"), labels, "doc_id", nonempty=True, size="quality")


@query("""SELECT page_id, regexp_replace(regexp_replace(base, '^aod_vietnam_', ''), '\\.tif$', '') AS stem, base, replace(base, '.', '') AS no_dots
FROM (SELECT page_id, 'aod_vietnam_' || string_split(string_split(url, '?')[1], '/')[-1] || '.tif' AS base FROM pages)""")
def stem_normalise(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = F.get(F.split("url", r"\?"), F.lit(0))
    base = F.concat(F.lit(names.LOCAL_PREFIX), names.basename(path), F.lit(names.LOCAL_SUFFIX))
    return pages.select("page_id", names.local_stem(base).alias("stem"), base.alias("base"), F.replace(base, F.lit("."), F.lit("")).alias("no_dots"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget' AND (contains(p_name, 'red') OR contains(p_name, 'small') OR contains(p_name, 'blue'))")
def tile_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.filter(names.is_tile(F.col("p_name"), ("red", "small", "blue"), suffix="widget"))


@query(r"""SELECT doc_id, pos, regexp_replace(raw, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS url
FROM (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
WHERE regexp_replace(raw, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') <> '' AND NOT starts_with(raw, '#')""")
def url_list_clean(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return lines.filter(names.is_url_line(F.col("raw"))).select("doc_id", F.col("pos").cast("long").alias("pos"), names.strip(F.col("raw")).alias("url"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def listing_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


@query("""SELECT event_id, k AS time_key, try_strptime(k, '%Y%m%d_%H%M') AS ts FROM (
SELECT event_id, split_part(n, '_', 5) || '_' || split_part(n, '_', 6) AS k FROM (
SELECT event_id, 'aod_vietnam_P_Q_' || strftime(ts, '%Y%m%d_%H%M') || '_' || event_type || '.tif' AS n FROM events))""")
def filename_timestamp(spark, sf_dir):
    name = F.concat(F.lit("aod_vietnam_P_Q_"), F.date_format("ts", "yyyyMMdd_HHmm"), F.lit("_"), F.col("event_type"), F.lit(".tif"))
    key = names.time_key(name)
    return table(spark, sf_dir, "events").select("event_id", key.alias("time_key"), names.key_time(key).cast("timestamp_ntz").alias("ts"))


@query("SELECT event_id, strftime(ts, '%Y%m/%d/%H') AS hourly, strftime(ts, '%Y/%m/%d') AS daily, strftime(ts, '%Y/%j') AS day_of_year FROM events")
def partition_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *[names.partition_path(F.col("ts"), k).alias(k) for k in names.LAYOUTS])


@query("""SELECT c_nationkey, floor(min(lon) / 0.05::DOUBLE) * 0.05::DOUBLE AS west, ceil(max(lat) / 0.05::DOUBLE) * 0.05::DOUBLE AS north
FROM (SELECT c_nationkey, 100 + c_acctbal / 1000::DOUBLE AS lon, 25 - c_acctbal / 2000::DOUBLE AS lat FROM customer) GROUP BY c_nationkey""")
def grid_snap(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select("c_nationkey", (100 + F.col("c_acctbal") / 1000).alias("lon"), (25 - F.col("c_acctbal") / 2000).alias("lat"))
    ends = points.groupBy("c_nationkey").agg(F.min("lon").alias("lon"), F.max("lat").alias("lat"))
    return ends.select("c_nationkey", raster.snap_west(F.col("lon")).alias("west"), raster.snap_north(F.col("lat")).alias("north"))


def _granules(spark, sf_dir) -> DataFrame:
    """Bands of 8 x 8 cells at (105.0, 21.2); the second band is the first one's magnitude, ten times."""
    e = table(spark, sf_dir, "embeddings")
    at = [F.lit(v).alias(k) for k, v in (("x0", 105.0), ("y0", 21.2), ("dx", 0.05), ("dy", 0.05))]
    return e.select(F.col("vec_id").cast("string").alias("granule_id"), "vec_id", F.lit(None).cast("timestamp").alias("ts"), F.lit(8).alias("height"), F.lit(8).alias("width"), *at, F.col("embedding").alias("aot"), F.transform("embedding", lambda v: (F.abs(v) * F.lit(10.0).cast("float")).cast("float")).alias("unc"))


def _stations(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    lat, lon = 21.3 - F.pmod("s_suppkey", F.lit(13)) * F.lit(0.043), 104.93 + F.pmod("s_suppkey", F.lit(11)) * F.lit(0.047)
    return s.select(F.col("s_suppkey").cast("int").alias("station_id"), lat.alias("latitude"), lon.alias("longitude"))


_POINTS = """g AS (SELECT vec_id, embedding FROM embeddings),
s AS (SELECT s_suppkey AS station_id, 21.3::DOUBLE - (s_suppkey % 13) * 0.043::DOUBLE AS lat, 104.93::DOUBLE + (s_suppkey % 11) * 0.047::DOUBLE AS lon FROM supplier),
p AS (SELECT *, CAST(floor((21.2::DOUBLE - lat) / 0.05::DOUBLE) AS BIGINT) AS r, CAST(floor((lon - 105.0::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS c FROM s),
v AS (SELECT station_id, vec_id, r, c, CASE WHEN r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 THEN embedding[r * 8 + c + 1] END AS aot,
      CASE WHEN r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 THEN CAST(abs(embedding[r * 8 + c + 1]) * 10::FLOAT AS FLOAT) END AS unc FROM p, g)"""
_GATE = "SELECT station_id, vec_id, tag, CASE WHEN aot IS NULL OR isnan(aot) OR isnan(unc) OR unc >= thr THEN NULL ELSE CAST(aot AS DOUBLE) END AS aot FROM v, (VALUES (0.5::FLOAT, '05'), (0.7::FLOAT, '07'), (0.8::FLOAT, '08'), (1.0::FLOAT, '1'), (1.2::FLOAT, '12'), (1.5::FLOAT, '15')) t(thr, tag)"


@query(f"WITH {_POINTS} SELECT station_id, vec_id, r AS row, c AS col, CAST(aot AS DOUBLE) AS aot FROM v")
def raster_point_lookup(spark, sf_dir):
    found = grids.sample(_granules(spark, sf_dir), _stations(spark, sf_dir), granules_rows=table(spark, sf_dir, "embeddings").count())
    return found.select("station_id", F.col("granule_id").cast("long").alias("vec_id"), "row", "col", F.col("aot").cast("double").alias("aot"))


@query(f"WITH {_POINTS} {_GATE}")
def station_observations(spark, sf_dir):
    """The flagship: each station's cell in every granule, gated at six thresholds."""
    found = grids.observe(_granules(spark, sf_dir), _stations(spark, sf_dir), granules_rows=table(spark, sf_dir, "embeddings").count(), keep=("vec_id",), strip=200)
    return found.select("station_id", F.col("vec_id").cast("long").alias("vec_id"), "tag", "aot")


@query("""SELECT vec_id, i - 1 AS i, tag, CASE WHEN isnan(a) OR isnan(u) OR u >= thr THEN NULL ELSE CAST(a AS DOUBLE) END AS aot
FROM (SELECT vec_id, i, embedding[i] AS a, CAST(abs(embedding[i]) * 10::FLOAT AS FLOAT) AS u FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
(VALUES (0.5::FLOAT, '05'), (0.7::FLOAT, '07'), (0.8::FLOAT, '08'), (1.0::FLOAT, '1'), (1.2::FLOAT, '12'), (1.5::FLOAT, '15')) t(thr, tag)""")
def quality_gate_fanout(spark, sf_dir):
    cells = _granules(spark, sf_dir).select("vec_id", F.posexplode(F.arrays_zip("aot", "unc")).alias("i", "cell")).withColumn("_t", F.explode(raster.thresholds()))
    return cells.select("vec_id", F.col("i").cast("long").alias("i"), F.col("_t.tag").alias("tag"), raster.gate(F.col("cell.aot"), F.col("cell.unc"), F.col("_t.threshold")).alias("aot"))


_RINGS = [[(1.0, -500.0), (22.0, 1500.0), (15.5, 9000.0), (3.25, 7000.5)], [(8.0, 2500.0), (12.0, 3000.0), (10.0, 6000.0)]]
_EDGES = grids.rings_to_edges(_RINGS)
_EDGE_ROWS = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in _EDGES)


@query(f"""WITH e(x1, y1, x2, y2) AS (VALUES {_EDGE_ROWS}),
h AS (SELECT c_custkey, count(CASE WHEN (y1 > c_acctbal) <> (y2 > c_acctbal) THEN CASE WHEN c_nationkey < (x2 - x1) * (c_acctbal - y1) / (y2 - y1) + x1 THEN 1 END END) % 2 = 1 AS inside FROM customer, e GROUP BY c_custkey)
SELECT c.c_custkey, inside, CASE WHEN inside THEN c_acctbal END AS masked, CASE WHEN inside THEN c_acctbal ELSE 0 END AS zeroed FROM customer c JOIN h USING (c_custkey)""")
def polygon_mask(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    inside = raster.inside(F.col("c_nationkey").cast("double"), F.col("c_acctbal"), _EDGES)
    return c.select("c_custkey", inside.alias("inside"), F.when(inside, F.col("c_acctbal")).alias("masked"), F.when(inside, F.col("c_acctbal")).otherwise(F.lit(0.0)).alias("zeroed"))


@query("SELECT vec_id, i // 8 - 2 AS row, i % 8 - 3 AS col, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings) WHERE i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 3 AND 6")
def crop_window(spark, sf_dir):
    cropped = grids.crop(_granules(spark, sf_dir), 105.0 + 3.01 * 0.05, 21.2 - 5.99 * 0.05, 105.0 + 6.99 * 0.05, 21.2 - 2.01 * 0.05)
    return grids.pixels(cropped, "vec_id").select("vec_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("aot").cast("double").alias("v"))


@query("SELECT vec_id, i // 8 AS row, i % 8 AS col, CAST(embedding[i + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)")
def pixel_explode(spark, sf_dir):
    return grids.pixels(_granules(spark, sf_dir), "vec_id").select("vec_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("aot").cast("double").alias("v"))


@query("SELECT n_name AS station_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS station_id FROM nation")
def station_surrogate_key(spark, sf_dir):
    keyed = timeseries.with_station_id(table(spark, sf_dir, "nation"), "n_nationkey")
    return keyed.select(F.col("n_name").alias("station_name"), F.col("station_id").cast("long").alias("station_id"))


@query("SELECT c_custkey AS station_id, c_name AS station_name, total FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def wide_merge_left(spark, sf_dir):
    new = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("total"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station_id"), F.col("c_name").alias("station_name"))
    return old.join(new, F.col("station_id") == F.col("o_custkey"), "left").select("station_id", "station_name", "total")


# The days that the tables' events span; the query itself finds them.
_DAYS = [f"202401{d:02d}" for d in range(1, 31)]


@query("SELECT user_id, " + ", ".join(f"max(value) FILTER (WHERE strftime(ts, '%Y%m%d') = '{d}') AS AOT_{d}" for d in _DAYS) + " FROM events GROUP BY user_id")
def station_time_pivot(spark, sf_dir):
    """A column for each day from the first to the last event; a span of time, whatever the rows."""
    events = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyyMMdd").alias("day"), "value")
    days = [r["day"] for r in events.filter("day IS NOT NULL").select("day").distinct().orderBy("day").collect()]
    wide = events.groupBy("user_id").pivot("day", days).agg(F.max("value"))
    return wide.select("user_id", *[F.col(d).alias(f"AOT_{d}") for d in days])


def _arrivals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts")


_SPINE = """p AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events),
s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM (SELECT min(h) AS lo, max(h) AS hi FROM p)),
m AS (SELECT h, h - to_hours(row_number() OVER (ORDER BY h)) AS island FROM s WHERE h NOT IN (SELECT h FROM p)),
g AS (SELECT min(h) AS gap_start, max(h) AS gap_end, count(*) AS n FROM m GROUP BY island)"""


@query(f"WITH {_SPINE} SELECT CAST(gap_start AS TIMESTAMP) AS gap_start, CAST(gap_end AS TIMESTAMP) AS gap_end, n FROM g WHERE n >= 6")
def hour_gap_scan(spark, sf_dir):
    return gaps.gaps(gaps.spine(_arrivals(spark, sf_dir), "ts"), 6)


@query("""WITH p AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS d FROM orders),
s AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM (SELECT min(d) AS lo, max(d) AS hi FROM p)),
f AS (SELECT min(d) AS cut FROM s WHERE d NOT IN (SELECT d FROM p))
SELECT CAST(d AS TIMESTAMP) AS part FROM p, f WHERE cut IS NULL OR d < cut""")
def first_gap_prefix(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return gaps.before_first_gap(gaps.spine(orders, "o_orderdate", "DAY"))


@query(f"WITH {_SPINE} SELECT CAST(coalesce((SELECT min(gap_start) FROM g WHERE n >= 24), (SELECT date_trunc('hour', max(ts)) FROM events) - INTERVAL 2 HOUR) AS TIMESTAMP) AS resume_at")
def resume_cursor(spark, sf_dir):
    as_of = table(spark, sf_dir, "events").agg(F.date_trunc("HOUR", F.max("ts")).alias("t")).first()["t"]
    end = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 2 HOURS")
    return gaps.resume_at(gaps.spine(_arrivals(spark, sf_dir), "ts"), 24, end)


@query("SELECT event_id, ts FROM events, (SELECT date_trunc('hour', max(ts)) AS h FROM events) WHERE ts >= h - INTERVAL 2 HOUR AND ts < h")
def realtime_two_hours(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    hour = F.lit(events.agg(F.date_trunc("HOUR", F.max("ts")).alias("t")).first()["t"]).cast("timestamp_ntz")
    return events.filter((F.col("ts") >= hour - F.expr("INTERVAL 2 HOURS")) & (F.col("ts") < hour))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS part, count(*) AS files FROM events, (SELECT max(ts) AS m FROM events) WHERE ts >= TIMESTAMP '2024-01-05' AND ts < m - INTERVAL 2 HOUR GROUP BY 1")
def backfill_range(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts")
    end = F.lit(events.agg(F.max("ts").alias("t")).first()["t"]).cast("timestamp_ntz") - F.expr("INTERVAL 2 HOURS")
    held = events.filter((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < end))
    return held.groupBy(F.date_trunc("HOUR", "ts").alias("part")).agg(F.count(F.lit(1)).alias("files"))


_STATUS = {"view": "new", "click": "existing", "purchase": "new", "signup": "missing", "error": "error"}


@query("""SELECT user_id AS product, CAST(date_trunc('day', ts) AS TIMESTAMP) AS part_ts, count(*) FILTER (WHERE event_type IN ('view', 'click', 'purchase')) AS held,
count(*) FILTER (WHERE event_type = 'signup') AS missing, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1, 2""")
def files_per_day(spark, sf_dir):
    status = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("event_type")]
    ledger = table(spark, sf_dir, "events").select(F.col("user_id").alias("product"), F.date_trunc("DAY", "ts").alias("part_ts"), status.alias("status"))
    return listing.per_part(ledger)


@query("SELECT user_id, event_id, row_number() OVER w AS running, CAST(floor((row_number() OVER w - 1) / 50) AS BIGINT) AS session FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def session_recycle(spark, sf_dir):
    return recency.running_sessions(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 50)


@query("""WITH x AS (SELECT event_type, list(user_id ORDER BY event_id) AS xs FROM events GROUP BY event_type)
SELECT event_type, list_aggregate(list_transform(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc WHEN len(acc) >= 20 THEN list_concat(acc[2:], x) ELSE list_concat(acc, x) END, []::BIGINT[]), lambda v: CAST(v AS VARCHAR)), 'string_agg', ',') AS held FROM x""")
def fifo_seen_set(spark, sf_dir):
    held = recency.fifo_set(table(spark, sf_dir, "events"), "event_type", "event_id", "user_id", 20)
    return held.select("event_type", F.array_join(F.transform("held", lambda v: v.cast("string")), ",").alias("held"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def tail_n(spark, sf_dir):
    return recency.tail(table(spark, sf_dir, "events").select("event_id", "ts", "event_type"), "event_id", 100)


@query("SELECT event_id, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') || ' | ' || strftime(ts, '%Y-%m-%d %H:%M') || ' | ' || strftime(ts, '%Y%m/%d/%H') || ' | ' || 'no files' AS line FROM events WHERE event_type = 'error'")
def missing_log(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("event_type = 'error'")
    line = names.missing_line(F.col("ts") + F.expr("INTERVAL 1 HOUR"), F.col("ts"), names.partition_path(F.col("ts"), "hourly"), F.lit("no files"))
    return events.select("event_id", line.alias("line"))


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS elevation FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7'")
def station_region_project(spark, sf_dir):
    region = table(spark, sf_dir, "nation").filter("n_name = 'NATION_7'")
    joined = table(spark, sf_dir, "supplier").join(region, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return joined.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("elevation"))


@query("""WITH o AS (SELECT user_id AS station_id, date_trunc('hour', ts) AS ts, 0.5 AS threshold, max(value) AS aot FROM events WHERE event_type <> 'click' GROUP BY 1, 2),
n AS (SELECT user_id AS station_id, date_trunc('hour', ts) AS ts, 0.5 AS threshold, max(value) AS aot FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT station_id, CAST(ts AS TIMESTAMP) AS ts, aot FROM n UNION ALL SELECT station_id, CAST(ts AS TIMESTAMP), aot FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.station_id = o.station_id AND n.ts = o.ts)""")
def observation_upsert(spark, sf_dir):
    def of(part):
        rows = table(spark, sf_dir, "events").filter(part)
        return rows.groupBy(F.col("user_id").alias("station_id"), F.date_trunc("HOUR", "ts").alias("ts")).agg(F.max("value").alias("aot")).withColumn("threshold", F.lit(0.5))

    return timeseries.latest(of("event_type <> 'click'"), of("event_type = 'click'")).select("station_id", "ts", "aot")


@query("""SELECT concat('X', doc_id, '.nc') AS name FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def stem_anti_join(spark, sf_dir):
    remote = table(spark, sf_dir, "documents").select(F.concat(F.lit("X"), F.col("doc_id").cast("string"), F.lit(names.GRID_SUFFIX)).alias("name"))
    local = table(spark, sf_dir, "labels").select(F.concat(F.lit(names.LOCAL_PREFIX + "X"), F.col("doc_id").cast("string"), F.lit(names.LOCAL_SUFFIX)).alias("name"))
    return listing.missing_by_stem(remote, local)


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def compacted_log(spark, sf_dir):
    """A log longer than 500 lines and larger than 1000 bytes keeps its last 500 lines."""
    return recency.compact_log(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type", 500, 1000)


_SHAPE = grids.rings_to_edges([[(105.01, 21.19), (105.33, 21.13), (105.07, 20.83)]])
_SHAPE_ROWS = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in _SHAPE)


@query(f"""WITH e(x1, y1, x2, y2) AS (VALUES {_SHAPE_ROWS}),
k AS (SELECT i, 105.0::DOUBLE + (i % 8 + 0.5::DOUBLE) * 0.05::DOUBLE AS x, 21.2::DOUBLE - (i // 8 + 0.5::DOUBLE) * 0.05::DOUBLE AS y FROM (SELECT unnest(range(0, 64)) AS i)),
h AS (SELECT i, count(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 END) % 2 = 1 AS inside FROM k, e GROUP BY i)
SELECT vec_id, i // 8 AS row, i % 8 AS col, CASE WHEN inside THEN CAST(embedding[i + 1] AS DOUBLE) END AS v FROM embeddings, h""")
def granule_mask(spark, sf_dir):
    masked = grids.mask(_granules(spark, sf_dir), _SHAPE)
    return grids.pixels(masked, "vec_id").select("vec_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("aot").cast("double").alias("v"))


_HOURS = [f"20240115_{h:02d}00" for h in (0, 6, 12, 18)]


@query("SELECT c_custkey AS station_id, c_name AS station_name, c_acctbal AS latitude, CAST(c_nationkey AS DOUBLE) AS longitude, " + ", ".join(f"max(value) FILTER (WHERE strftime(date_trunc('hour', ts), '%Y%m%d_%H%M') = '{t}') AS AOT_{t}" for t in _HOURS) + " FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY ALL")
def wide_presentation(spark, sf_dir):
    """The wide table of the four times of a day that a file of it has."""
    obs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("station_id"), F.date_trunc("HOUR", "ts").alias("ts")).agg(F.max("value").alias("aot")).withColumn("threshold", F.lit(0.5).cast("float"))
    stations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station_id"), F.col("c_name").alias("station_name"), F.col("c_acctbal").alias("latitude"), F.col("c_nationkey").cast("double").alias("longitude"))
    return timeseries.wide(obs, stations, 0.5, _HOURS)


@query("""SELECT DISTINCT event_type AS product, user_id AS name FROM events WHERE event_type <> 'error'
OR ts > (SELECT date_trunc('milliseconds', max(ts)) FROM events WHERE event_type <> 'error') - INTERVAL 2 HOUR""")
def late_drop_stream(spark, sf_dir):
    from ..streaming.poll import late_dropped

    return late_dropped(spark, sf_dir)


@query("SELECT conv_id, turn, 'group' AS kind, 'turn' AS name, NULL::INTEGER AS n FROM conversations UNION ALL SELECT conv_id, turn, 'dataset', 'turn/text', 1 FROM conversations")
def hdf_tree_udtf(spark, sf_dir):
    from ..sources.tree import nested_tree

    return nested_tree(table(spark, sf_dir, "conversations"))


@query()
def fifo_seen_stream(spark, sf_dir):
    from ..streaming.seen import seen_stream

    return seen_stream(spark, sf_dir)
