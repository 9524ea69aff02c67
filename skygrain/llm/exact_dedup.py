"""Exact duplicates by content sort, in DataFrame operations only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, cut, shuffle_partitions

_KEY = "struct<p:string,h:bigint,l:int,d:bigint>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.length(text).alias("_len"), F.regexp_replace(text, SPACE_CLASS + "+", "").alias("_norm"))
    # Order inside a run of equals: longest original first, then smallest id.
    return rows.withColumn("_key", F.struct(F.substring("_norm", 1, 16).alias("p"), F.xxhash64("_norm").alias("h"), (-F.col("_len")).alias("l"), F.col("_id").alias("d")))


def _splitters(docs: DataFrame, id_col: str, text_col: str, parts: int, per_part: int, seed: int) -> list[dict]:
    """At most ``parts - 1`` keys that cut the sampled keys into equal shares; the sample holds about ``parts * per_part`` short keys."""
    total = docs.count()
    if parts < 2 or not total:
        return []
    share = min(1.0, parts * per_part / total)
    sample = _keyed(docs.sample(fraction=share, seed=seed) if share < 1 else docs, id_col, text_col)
    keys = [r["_key"].asDict() for r in sample.select("_key").orderBy("_key").collect()]
    picked = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    return [k for i, k in enumerate(picked) if not i or k != picked[i - 1]]


def _range_of(key: F.Column, splitters: F.Column, n: int) -> F.Column:
    """How many splitters are at or below ``key``, by binary search."""

    def step(a, _):
        mid = ((a["lo"] + a["hi"]) / 2).cast("int")
        above = F.get(splitters, mid) <= key
        return F.when(a["lo"] >= a["hi"], a).otherwise(F.struct(F.when(above, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(above, a["hi"]).otherwise(mid).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, step, lambda a: a["lo"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, sample_per_partition: int = 60, seed: int = 7) -> DataFrame:
    """Group texts that are equal once ASCII white space is deleted.

    Sampled splitters over (content, length, id) range-partition the rows, so that a group of copies
    larger than a share is split between neighbouring ranges by length and id. Each range is sorted
    externally by content; the window operator compares each row's whole content with its neighbour's.
    Only groups that a splitter cuts are merged afterwards, from one row per range.

    Returns, per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. The row
    with the most code points in its original text stays, then the smallest id. Null text counts as
    empty; a null id sorts first. Of rows repeated with id and text, one is kept. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    parts = partitions or shuffle_partitions(spark)
    splitters = _splitters(docs, id_col, text_col, parts, sample_per_partition, seed)
    keyed = _keyed(docs, id_col, text_col)
    if splitters:
        bounds = F.from_json(F.lit(json.dumps(splitters)), f"array<{_KEY}>")
        # A splitter of the same content lies next to the row's place among the splitters, on either side.
        beside = lambda k: (F.get(bounds, k)["p"] == F.col("_key.p")) & (F.get(bounds, k)["h"] == F.col("_key.h"))
        near = lambda k: F.coalesce(F.when(k > 0, beside(k - 1)), F.lit(False)) | F.coalesce(beside(k), F.lit(False))
        found = F.get(F.transform(F.array(_range_of(F.col("_key"), bounds, len(splitters))), lambda k: F.struct(k.alias("part"), near(k).alias("split"))), F.lit(0))
    else:
        found = F.struct(F.lit(0).alias("part"), F.lit(False).alias("split"))
    dealt = keyed.select("_id", "_len", "_norm", found.alias("_at")).select("_id", "_len", "_norm", F.col("_at.part").alias("_part"), F.col("_at.split").alias("_split")).repartitionById(parts, F.col("_part"))
    run = Window.partitionBy("_part", "_norm")
    order = run.orderBy(F.desc("_len"), F.col("_id").asc_nulls_first())
    found = dealt.select(
        "_id", "_len", "_part", "_split",
        F.row_number().over(order).alias("_rn"),
        F.first("_id").over(order).alias("_keep"),
        F.count(F.lit(1)).over(run).alias("_n"),
        F.sha2("_norm", 256).alias("_sha"),
    )
    small = cut(found, "exact-runs")
    # One row per range of a group that a splitter cuts: at most two for each splitter, so the broadcast is bounded by the partitions.
    best = F.min(F.struct((-F.col("_len")).alias("l"), F.col("_id").alias("d"), F.col("_part").alias("part")))
    merged = small.filter("_split AND _rn = 1").groupBy(F.col("_sha").alias("_msha")).agg(best.alias("_best"), F.sum("_n").alias("_total"))
    joined = small.join(F.broadcast(merged), (F.col("_split")) & (F.col("_sha") == F.col("_msha")), "left")
    whole = F.col("_total").isNotNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(whole, F.col("_best.d")).otherwise(F.col("_keep")).alias("keep_id"),
        F.when(whole, F.col("_total")).otherwise(F.col("_n")).alias("group_size"),
        ((F.col("_rn") == 1) & (~whole | (F.col("_best.part") == F.col("_part")))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha AS text_sha256
FROM n WINDOW w AS (PARTITION BY sha ORDER BY len DESC, doc_id)
"""
