"""Archive polling as Structured Streaming: backfill and live mode are the same query."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gaps, grids, timeseries
from ..sources.config import ARCHIVES

# The archives' polling intervals.
TRIGGERS = {"aerosol": "10 minutes", "precipitation": "6 hours", "surface_temperature": "24 hours"}
LATE = "2 hours"


def once(files: DataFrame, product: str = "product", name: str = "name", ts: str = "ts", late: str = LATE) -> DataFrame:
    """Each file of a product once; files that come later than ``late`` behind the newest hour are dropped, and counted by the watermark's metrics."""
    return files.withWatermark(ts, late).dropDuplicatesWithinWatermark([product, name])


def start_ingest(listing: DataFrame, fetch, path: str, checkpoint: str, product: str = "aerosol", available_now: bool = False):
    """Start a query that fetches new files and appends what ``fetch`` (DataFrame to DataFrame) makes of them to the ledger at ``path``.

    With ``available_now`` it ends once it has caught up: a backfill. The checkpoint holds the cursor.
    A batch that is run again overwrites its own part of the ledger.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        fetch(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    writer = once(listing).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGERS[product])).start()


def start_observations(granules: DataFrame, stations: DataFrame, edges: list[tuple], path: str, checkpoint: str, available_now: bool = False):
    """Granule stream to the observation table: clip, sample, gate, and overwrite the days that a batch touches."""
    rows = stations.count()

    def write(batch: DataFrame, epoch: int) -> None:
        obs = grids.fan_out(grids.sample(grids.clip(batch, edges), stations, rows)).drop("tag")
        spark = batch.sparkSession
        try:
            days = [r["day"] for r in obs.select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct().collect()]
            old = spark.read.parquet(path).filter(F.col("day").isin(days)).drop("day")
            merged = f"{work_dir(spark)}/merged"  # written apart first, since the days read are overwritten
            timeseries.latest(old, obs).write.parquet(merged)
            obs = spark.read.parquet(merged)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        timeseries.write_observations(obs, path)

    writer = granules.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=TRIGGERS["aerosol"])).start()


def work_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    if named:
        import uuid

        return f"{named.rstrip('/')}/streams-{uuid.uuid4().hex}"
    return "file://" + tempfile.mkdtemp(prefix="skygrain-stream-")


def run_once(stream: DataFrame, spark: SparkSession, base: str | None = None) -> DataFrame:
    """All that a stream has now, written to the shared folder and read back; with the same ``base`` again, what has come since is added."""
    base = base or work_dir(spark)
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def late_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as arrivals in two polls, errors last: each (type, user) once, without errors that come two hours or more behind the newest other event."""
    base = work_dir(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("product"), F.col("user_id").alias("name"))
    for poll, part in (("first", "product <> 'error'"), ("second", "product = 'error'")):
        events.filter(part).write.mode("overwrite").parquet(f"{base}/in/{poll}")
        arrivals = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{base}/in")
        found = run_once(once(arrivals), spark, base)
    return found.select("product", "name")


def resume_from(ledger: DataFrame, product: str, otherwise):
    """Where a backfill of an archive takes up again: the first part of the first gap as long as the archive's ``max_missing``, or ``otherwise`` (a time).

    ``ledger`` has product, part_ts and status; parts with a file that is held count as present.
    """
    known = ARCHIVES[product]
    held = ledger.filter((F.col("product") == product) & F.col("status").isin("new", "existing")).select(F.col("part_ts").cast("timestamp_ntz").alias("part_ts"))
    line = gaps.spine(held, "part_ts", "HOUR" if known["layout"] == "hourly" else "DAY")
    return gaps.resume_at(line, known["max_missing"], F.lit(otherwise).cast("timestamp_ntz")).first()["resume_at"]
