"""The bounded first-in-first-out set as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.recency import SeenSet
from .poll import run_once


def new_items(stream: DataFrame, key: str, seq: str, item: str, size: int = 5000) -> DataFrame:
    """(key, seq, item) of items that are new to their key's set; a repeat keeps its place, a full set drops its oldest.

    The order is by ``seq`` within a micro-batch and by batch between them.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # The order of a micro-batch is that of seq, so its numbers are sorted whole; texts of a key's batch are held once.
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
        seen = SeenSet(size)
        seen.held = dict.fromkeys(state.get[0]) if state.exists else {}
        for i in range(0, len(rows), 10_000):
            part = rows.iloc[i : i + 10_000]
            out = part[[seen.add(x) for x in part["item"]]].copy()
            out["key"] = name[0]
            yield out[["key", "seq", "item"]]
        state.update((list(seen.held),))

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(item).cast("string").alias("item"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, seq long, item string", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def seen_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return run_once(new_items(rows, "event_type", "event_id", "user_id", 20), spark)
