"""Boilerplate lines by their frequency within a site, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

_EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


#: Boilerplate lines of all hosts are broadcast up to so many bytes; beyond it pages and lines are shuffled by host, a hot host's pages in parts.
BROADCAST_BYTES = 64 << 20


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(text: Column) -> Column:
    """The distinct trimmed lines of a text, without the empty one."""
    return F.array_remove(F.array_distinct(F.transform(_lines(text), lambda x: F.regexp_replace(x, _EDGES, ""))), "")


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 3, distinct: bool = False) -> DataFrame:
    """(host, line, n_pages, host_pages) of each line on more than ``ratio`` of its host's pages and on ``min_pages`` at least.

    Counts run in two steps so that texts are never shuffled: a first pass counts 64-bit line hashes
    by host and keeps the frequent ones, a superset of the frequent lines; a second pass counts the
    whole lines behind those hashes, few for each host since their page counts sum to no more than
    the host's lines. Both are counted partially before the shuffle, so a hot host or line costs one
    row a task.

    With ``distinct``, a host's pages of the same lines count as one page, in lines and totals alike,
    so that copies of a document do not make its own lines boilerplate.
    """
    pages = docs.select(F.col(host_col).alias("_host"), _keys(F.col(text_col)).alias("_keys")).withColumn("_page", F.xxhash64("_keys"))
    hashes = pages.select("_host", "_page", F.transform("_keys", lambda x: F.xxhash64(x)).alias("_hashes"))
    if distinct:
        hashes = cut(hashes.groupBy("_host", "_page").agg(F.first("_hashes").alias("_hashes")), "line-pages")
    totals = cut(hashes.groupBy(F.col("_host").alias("_thost")).agg(F.count(F.lit(1)).alias("host_pages")), "line-hosts")

    def frequent(counted: DataFrame) -> DataFrame:
        return counted.filter(F.col("n_pages") >= min_pages).join(totals, F.col("_host").eqNullSafe(F.col("_thost"))).filter(F.col("n_pages") > F.lit(ratio) * F.col("host_pages")).drop("_thost")

    hashed = hashes.select("_host", F.explode("_hashes").alias("_hash"))
    hot = cut(frequent(hashed.groupBy("_host", "_hash").agg(F.count(F.lit(1)).alias("n_pages"))).select(F.col("_host").alias("_hhost"), F.col("_hash").alias("_hhash")), "line-hashes")
    lines = pages.select("_host", "_page", F.explode("_keys").alias("line")).withColumn("_hash", F.xxhash64("line"))
    lines = lines.join(hot, F.col("_host").eqNullSafe(F.col("_hhost")) & (F.col("_hash") == F.col("_hhash")), "left_semi")
    lines = lines.select("_host", "line", "_page").distinct() if distinct else lines
    return frequent(lines.groupBy("_host", "line").agg(F.count(F.lit(1)).alias("n_pages"))).withColumnRenamed("_host", "host")


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 3, distinct: bool = False) -> DataFrame:
    """Drop boilerplate lines from every text; other columns stay, ``n_lines`` and ``n_dropped`` are added.

    Lines end at ``\\n`` and are compared without ASCII white space at their ends; blank lines are
    never dropped. ``distinct`` counts pages of the same lines once a host. A line repeated within a
    page counts once there. Rows with a null host form one host; null ids and repeated rows stay and
    count as pages. Null and empty text become empty text of one blank line. An empty table gives an
    empty result; columns named as the added ones are replaced, all others stay whatever their names.
    """
    found = cut(boilerplate_lines(docs, host_col, text_col, ratio, min_pages, distinct), "line-found")
    host, bad, kept, hit = (free_name(docs, x) for x in ("host_of_lines", "bad_lines", "kept_lines", "hit_lines"))
    # A host has fewer than (its lines a page) / ratio such lines.
    line = F.struct(F.xxhash64("line").alias("hash"), "line")
    lists = cut(found.groupBy(F.col("host").alias(host)).agg(F.collect_list(line).alias(bad)), "line-bad")
    few = (found.agg(F.sum(F.octet_length("line") + 32).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES
    joined = docs.join(F.broadcast(lists) if few else lists, F.col(host_col).eqNullSafe(F.col(host)), "left")
    lines = _lines(F.col(text_col))
    trimmed = lambda x: F.regexp_replace(x, _EDGES, "")
    # Hashes first, by a hash set of each page: only lines whose hash is a boilerplate line's are compared with the lines behind it.
    hits = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(trimmed(x))), F.col(f"{bad}.hash"))
    found_lines = F.transform(F.array(hits), lambda own: F.filter(F.col(bad), lambda x: F.array_contains(own, x["hash"]))["line"])  # an array of one, so that the hits are found once a page
    joined = joined.withColumn(hit, F.when(F.col(bad).isNotNull(), F.get(found_lines, F.lit(0))))
    good = F.when(F.coalesce(F.size(hit), F.lit(0)) <= 0, lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(hit), trimmed(x))))
    n = F.size(lines).cast("long")
    out = joined.withColumn(kept, good)
    return out.withColumns({"n_lines": n, "n_dropped": n - F.size(kept), text_col: F.array_join(kept, "\n")}).drop(kept, bad, host, hit)


def oracle_sql(ratio: float = 0.05, min_pages: int = 3) -> str:
    edges = _EDGES
    return rf"""
WITH l AS (
  SELECT doc_id, source, i, string_split(coalesce(text, ''), chr(10))[i] AS raw
  FROM (SELECT *, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT *, regexp_replace(raw, '{edges}', '', 'g') AS line FROM l),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
f AS (
  SELECT k.source, k.line FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
  WHERE k.line <> '' GROUP BY k.source, k.line, t.pages
  HAVING count(DISTINCT doc_id) >= {min_pages} AND count(DISTINCT doc_id) > {ratio}::DOUBLE * t.pages)
SELECT k.doc_id, count(*) AS n_lines, count(f.line) AS n_dropped,
       coalesce(string_agg(k.raw, chr(10) ORDER BY k.i) FILTER (WHERE f.line IS NULL), '') AS text
FROM k LEFT JOIN f ON k.source IS NOT DISTINCT FROM f.source AND k.line = f.line
GROUP BY k.doc_id
"""
