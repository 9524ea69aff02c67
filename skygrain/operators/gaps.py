"""Gaps in a sequence of parts, and where to resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spine(present: DataFrame, ts: str, unit: str = "HOUR", low=None, high=None) -> DataFrame:
    """Every part from the first to the last present one, with ``present``. One row a part of time, whatever the rows."""
    parts = present.select(F.date_trunc(unit, F.col(ts)).alias("part")).distinct()
    ends = parts.agg(F.coalesce(F.lit(low).cast("timestamp_ntz"), F.min("part")).alias("lo"), F.coalesce(F.lit(high).cast("timestamp_ntz"), F.max("part")).alias("hi"))
    full = ends.filter("lo IS NOT NULL").select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL 1 {unit}"))).alias("part"))
    return full.join(parts.select(F.col("part").alias("_p")), F.col("part") == F.col("_p"), "left").select("part", F.col("_p").isNotNull().alias("present"))


def gaps(line: DataFrame, least: int = 1) -> DataFrame:
    """gap_start, gap_end, n of each run of ``least`` or more absent parts.

    Parts are numbered over the spine, whose length is a span of time and does not grow with rows.
    """
    w = Window.orderBy("part")
    numbered = line.withColumn("_run", F.sum(F.col("present").cast("int")).over(w))
    return numbered.filter("NOT present").groupBy("_run").agg(F.min("part").alias("gap_start"), F.max("part").alias("gap_end"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("_run")


def resume_at(line: DataFrame, least: int = 24, otherwise=None) -> DataFrame:
    """One row: the first part of the first gap of ``least`` parts, or ``otherwise`` (a column)."""
    first = gaps(line, least).agg(F.min("gap_start").alias("_gap"))
    return first.select(F.coalesce("_gap", F.lit(None) if otherwise is None else otherwise).alias("resume_at"))


def before_first_gap(line: DataFrame, tolerated: int = 1) -> DataFrame:
    """The present parts before the first gap of ``tolerated`` parts."""
    cut = gaps(line, tolerated).agg(F.min("gap_start").alias("_cut"))
    return line.filter("present").join(F.broadcast(cut), F.col("_cut").isNull() | (F.col("part") < F.col("_cut"))).select("part")
