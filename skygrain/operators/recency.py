"""Bounded first-in-first-out set of seen items."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fifo_fold(items: Column, size: int, kind: str = "bigint") -> Column:
    """The set after all items of an ordered array: repeats are ignored and keep their place; a full set drops its oldest."""

    def step(held, x):
        full = F.concat(F.slice(held, 2, size), F.array(x))
        return F.when(F.array_contains(held, x), held).when(F.size(held) >= size, full).otherwise(F.concat(held, F.array(x)))

    return F.aggregate(items, F.expr(f"cast(array() as array<{kind}>)"), step)


def fifo_set(rows: DataFrame, key: str, seq: str, item: str, size: int, kind: str = "bigint") -> DataFrame:
    """The set of each key. The order is total within a key, so keys are the unit of work: shard the stream by product.

    Rows are sorted externally by key and sequence and folded as they come, so that a task holds one
    set and never a key's rows. A null key is a key; a null item is an item; no rows give no sets.
    """
    name = rows.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, None
        out = lambda: pa.RecordBatch.from_arrays([last, pa.array([list(seen.held)], types[1])], ["key", "held"])
        types = (None, None)
        for batch in batches:
            types = (batch.schema[0].type, pa.list_(batch.schema[2].type))
            keys, items = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, (k, x) in enumerate(zip(keys, items)):
                if seen is None or k != last[0].as_py():
                    if seen is not None:
                        yield out()
                    last, seen = batch.column(0).slice(i, 1), SeenSet(size)
                seen.add(x)
        if seen is not None:
            yield out()

    ordered = rows.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(item).cast(kind).alias("item")).repartition("key").sortWithinPartitions("key", "seq", "item")
    return ordered.mapInArrow(fold, f"key {name}, held array<{kind}>").withColumnRenamed("key", key)


class SeenSet:
    """The same set on the driver, for planning of a single listing; loads its log without writing it again."""

    def __init__(self, size: int = 5000, log: list[str] = ()):
        self.size, self.held = size, {}
        for line in log:
            if line.strip():
                self.add(line.strip())

    def add(self, item) -> bool:
        """True if the item is new."""
        if item in self.held:
            return False
        if len(self.held) >= self.size:
            del self.held[next(iter(self.held))]
        self.held[item] = None
        return True

    def __contains__(self, item) -> bool:
        return item in self.held


def tail(rows: DataFrame, seq: str, n: int) -> DataFrame:
    """The last ``n`` rows by sequence; each task keeps its own last ``n`` first."""
    return rows.orderBy(F.desc(seq)).limit(n)


def compact_log(log: DataFrame, seq: str, line: str, max_lines: int = 100_000, max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """The last ``max_lines`` lines, but only if the log is both longer than that and larger than ``max_bytes``."""
    size = log.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(line) + 1).alias("b")).first()
    return tail(log, seq, max_lines) if size["n"] > max_lines and (size["b"] or 0) > max_bytes else log


def running_sessions(rows: DataFrame, key: str, seq: str, every: int = 50) -> DataFrame:
    """Number of the connection that serves each row when one is renewed after ``every`` rows of a key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    return rows.withColumn("running", n.cast("long")).withColumn("session", F.floor((n - 1) / F.lit(every)).cast("long"))
