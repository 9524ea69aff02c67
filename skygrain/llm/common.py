"""Helpers shared by the corpus operators: tables, shared storage, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The ASCII white space that the operators delete, trim or split on.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by Spark's reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the session was started elsewhere."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *filter(None, paths)])


def release_memory() -> None:
    """Give what earlier stages left in a reused worker back to the machine."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none (tests in local mode) a folder of this machine is used.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="skygrain-"))
        named = _own_dir[0]
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skygrain/{name}-{uuid.uuid4().hex}"


class Cut:
    """A table written to shared storage: lineage ends there and lost executors cost nothing but a reread."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back."""
    return Cut(df, name).df


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: So many rows of one id (16 MB) are broadcast at most.
BROADCAST_IDS = 2_000_000


def broadcast_ids(rows: DataFrame, width: int = 1) -> DataFrame:
    """``rows`` of ``width`` longs marked for a broadcast if they are counted to be few; else left to be joined by shuffle and sort."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS // width else rows


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def least_hash_sample(ids: DataFrame, label: str, counts: dict, most: int) -> DataFrame:
    """At most ``most`` rows of each label, by least hash of ``_id``; ``counts`` has the rows of each label.

    A threshold on the hash first leaves about ``most`` rows a label where they are read, so ranking
    them shuffles little however many rows a label has.
    """
    span = 1 << 40
    kept = [(value, int(span * min(1.0, (1.2 * most + 50) / max(1, n)))) for value, n in counts.items()]
    if not kept:
        return ids.filter("false")
    # One row a label; the caller bounds the labels.
    shares = ids.sparkSession.createDataFrame(kept, ids.select(F.col(label).alias("_value"), F.lit(0).cast("long").alias("_share")).schema)
    few = ids.withColumn("_h", F.pmod(F.xxhash64("_id"), F.lit(span))).join(F.broadcast(shares), (F.col(label) == F.col("_value")) & (F.col("_h") < F.col("_share")))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", "_id"))
    return few.withColumn("_rn", rank).filter(F.col("_rn") <= most).drop("_h", "_rn", "_value", "_share")
