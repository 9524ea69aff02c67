"""Planning of fetches: what an archive lists and the inventory does not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names


def parse_csv_listing(lines: DataFrame, value: str = "value", header: str = "name, last_modified, size") -> DataFrame:
    """name, size from the lines of a listing whose columns ``header`` names, in any order; spaces after commas and the header line itself are ignored."""
    names_ = [c.strip() for c in header.split(",")]
    row = F.from_csv(F.col(value), F.lit(", ".join(f"`{c}` string" for c in names_)), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"})
    size = F.try_to_number(F.col("r.size"), F.lit("9" * 18)).cast("long") if "size" in names_ else F.lit(None).cast("long")
    return lines.select(row.alias("r")).select("r.name", size.alias("size")).filter("name IS NOT NULL AND name <> 'name'")


def parse_json_listing(texts: DataFrame, value: str = "value") -> DataFrame:
    """name, size of each entry of ``content``; none if the field is missing."""
    parsed = F.from_json(F.col(value), "struct<content:array<struct<name:string,size:bigint>>>")
    return texts.select(F.inline(F.coalesce(parsed["content"], F.expr("cast(array() as array<struct<name:string,size:bigint>>)"))))


def url_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.filter(names.is_url_line(F.col(value))).select(names.strip(F.col(value)).alias("url"))


def missing_by_stem(remote: DataFrame, local: DataFrame, name: str = "name") -> DataFrame:
    """Remote grids whose stem no local file has. A local grid file does not match itself and is fetched again."""
    held = local.select(names.local_stem(F.col(name)).alias("_stem")).distinct()
    return remote.filter(names.is_grid(F.col(name))).join(held, names.remote_stem(F.col(name)) == F.col("_stem"), "left_anti")


def missing_by_name(remote: DataFrame, local: DataFrame, name: str = "name", nonempty: bool = False, size: str = "length") -> DataFrame:
    """Remote rows whose name is not held; with ``nonempty``, held files of no bytes do not count."""
    held = local.filter(F.col(size) > 0) if nonempty else local
    return remote.join(held.select(F.col(name).alias("_held")).distinct(), F.col(name) == F.col("_held"), "left_anti")


def inventory(spark, path: str, pattern: str = "*") -> DataFrame:
    """name, length of the files below a path; file contents are not read. A missing folder is empty."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "name string, length long")
    return files.select(names.basename(F.col("path")).alias("name"), "length")


def per_part(ledger: DataFrame) -> DataFrame:
    """Files held, missing and failed by product and part; files that were there already count as held."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return ledger.groupBy("product", "part_ts").agg(is_("new", "existing").alias("held"), is_("missing").alias("missing"), is_("error", "timeout").alias("failed"))
