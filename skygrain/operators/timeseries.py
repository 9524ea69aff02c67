"""The long observation table, its updates and its wide presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(old: DataFrame, new: DataFrame, keys=("station_id", "ts", "threshold")) -> DataFrame:
    """One row a key: the new row where there is one. Reprocessing a granule changes values and adds nothing."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))
    return both.withColumn("_rn", first).filter("_rn = 1").drop("_rn", "_new")


def write_observations(obs: DataFrame, path: str) -> None:
    """Overwrite only the days that ``obs`` holds."""
    obs.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def wide(obs: DataFrame, stations: DataFrame, threshold: float, times: list[str], prefix: str = "AOT_") -> DataFrame:
    """One row a station, one column a time key (yyyyMMdd_HHmm): the columns are given, so no pass is spent on finding them."""
    keyed = obs.filter(F.col("threshold") == F.lit(threshold).cast("float")).withColumn("_key", F.date_format("ts", "yyyyMMdd_HHmm"))
    table = keyed.groupBy("station_id").pivot("_key", times).agg(F.first("aot", ignorenulls=True))
    named = table.select("station_id", *[F.col(t).alias(prefix + t) for t in times])
    return stations.select("station_id", "station_name", "latitude", "longitude").join(named, "station_id", "left")


def with_station_id(stations: DataFrame, order: str) -> DataFrame:
    """Number stations from 0 by an explicit order, unless they are numbered. A station list is a small dimension."""
    if "station_id" in stations.columns:
        return stations
    return stations.withColumn("station_id", (F.row_number().over(Window.orderBy(order)) - 1).cast("int"))
