"""Column functions on file names, paths and listing lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and tiles of the archives.
LOCAL_PREFIX, LOCAL_SUFFIX, GRID_SUFFIX = "aod_vietnam_", ".tif", ".nc"
HALF_HOURLY = r"(?i).*HHR.*\.zip"
TILES = ("h27v06", "h27v07", "h28v06", "h28v07", "h28v08")


def remove_prefix(c: Column, prefix: str) -> Column:
    """Once, and only if the text starts with it."""
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)


def remove_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def remote_stem(name: Column) -> Column:
    return remove_suffix(name, GRID_SUFFIX)


def local_stem(name: Column) -> Column:
    return remove_suffix(remove_prefix(name, LOCAL_PREFIX), LOCAL_SUFFIX)


def is_grid(name: Column) -> Column:
    return name.endswith(GRID_SUFFIX)


def is_half_hourly(name: Column) -> Column:
    """A search without an end anchor: names with more behind ``.zip`` pass too."""
    return F.rlike(name, F.lit(HALF_HOURLY))


def is_tile(name: Column, tiles: tuple[str, ...] = TILES, suffix: str = ".hdf") -> Column:
    """The suffix, and any of the tile ids anywhere in the name."""
    any_tile = F.lit(False)
    for t in tiles:
        any_tile = any_tile | F.contains(name, F.lit(t))
    return name.endswith(suffix) & any_tile


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_url_line(raw: Column) -> Column:
    """Not blank, and the raw line does not begin with a hash: an indented hash is kept."""
    return (strip(raw) != "") & ~raw.startswith("#")


def time_key(name: Column) -> Column:
    """Fields 5 and 6 between underscores: date and time."""
    return F.concat_ws("_", F.split_part(name, F.lit("_"), F.lit(5)), F.split_part(name, F.lit("_"), F.lit(6)))


def key_time(key: Column) -> Column:
    """Null where the key is no time."""
    return F.try_to_timestamp(key, F.lit("yyyyMMdd_HHmm"))


LAYOUTS = {"hourly": "yyyyMM/dd/HH", "daily": "yyyy/MM/dd", "day_of_year": "yyyy/DDD"}


def partition_path(ts: Column, layout: str) -> Column:
    return F.date_format(ts, LAYOUTS[layout])


def missing_line(logged_at: Column, ts: Column, path: Column, reason: Column) -> Column:
    return F.concat_ws(" | ", F.date_format(logged_at, "yyyy-MM-dd HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd HH:mm"), path, reason)
