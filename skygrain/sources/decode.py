"""Grid files to granules. The format libraries are imported on the executors, only when such a file is read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = "granule_id string, product string, crs string, height int, width int, longitude array<double>, latitude array<double>, aot array<float>, unc array<float>"


def decode_netcdf(content: bytes) -> dict:
    """AOT, AOT_uncertainty, longitude and latitude of a NetCDF grid; fill values become NaN."""
    try:
        import netCDF4
        import numpy as np
    except ImportError as e:
        raise RuntimeError("netCDF4 is needed to read NetCDF files") from e
    with netCDF4.Dataset("memory", memory=content) as d:
        band = lambda n: np.ma.filled(d.variables[n][:].astype("f4"), np.nan)
        aot, unc = band("AOT"), band("AOT_uncertainty")
        axis = lambda n: np.asarray(d.variables[n][:], dtype="f8").ravel().tolist()
        return {"height": aot.shape[0], "width": aot.shape[1], "longitude": axis("longitude"), "latitude": axis("latitude"), "aot": aot.ravel().tolist(), "unc": unc.ravel().tolist()}


def decode_geotiff(content: bytes) -> dict:
    """Both bands of a north-up raster; the axes are those of the cells' outer edges."""
    try:
        import rasterio
    except ImportError as e:
        raise RuntimeError("rasterio is needed to read GeoTIFF files") from e
    with rasterio.MemoryFile(content) as m, m.open() as d:
        a, t = d.read(), d.transform
        return {"height": d.height, "width": d.width, "longitude": [t.c + i * t.a for i in range(d.width)], "latitude": [t.f + i * t.e for i in range(d.height)], "aot": a[0].ravel().tolist(), "unc": a[1].ravel().tolist()}


DECODERS = {".nc": decode_netcdf, ".tif": decode_geotiff}


def decode(files: DataFrame, product: str = "aerosol", decoders: dict | None = None) -> DataFrame:
    """GRID rows of files (name, content) with a known suffix; names without time keys keep a null time later on."""
    known = decoders or DECODERS

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                suffix = next((s for s in known if name.endswith(s)), None)
                if suffix and content is not None:  # a grid at a time, since grids are large
                    yield pd.DataFrame([{"granule_id": name, "product": product, "crs": "EPSG:4326"} | known[suffix](bytes(content))], columns=[c.split()[0] for c in GRID.split(", ")])

    return files.select("name", "content").mapInPandas(rows, GRID)


def read_stations(spark, path: str) -> DataFrame:
    from ..schemas import STATION

    return spark.read.option("header", True).schema(STATION).csv(path).withColumnRenamed("name", "station_name")


def read_wide(spark, path: str, threshold: float, prefix: str = "AOT_") -> DataFrame:
    """A wide station table (CSV with a header, a column a time key) as long rows: station_id, ts, threshold, aot; empty fields are no rows."""
    table = spark.read.option("header", True).csv(path)
    times = [c for c in table.columns if c.startswith(prefix)]
    if not times:
        return table.select(F.col("station_id").cast("int").alias("station_id"), F.lit(None).cast("timestamp").alias("ts"), F.lit(threshold).cast("float").alias("threshold"), F.lit(None).cast("double").alias("aot")).filter("false")
    long = table.unpivot(["station_id"], times, "key", "aot").filter("aot IS NOT NULL")
    at = F.try_to_timestamp(F.substring("key", len(prefix) + 1, 64), F.lit("yyyyMMdd_HHmm"))
    return long.select(F.col("station_id").cast("int").alias("station_id"), at.alias("ts"), F.lit(threshold).cast("float").alias("threshold"), F.col("aot").cast("double").alias("aot"))


def shapefile_edges(content: bytes) -> list[tuple[float, float, float, float]]:
    """Edges of all rings of the polygons of a shapefile's bytes (.shp: ESRI's published layout, shape types 5, 15 and 25)."""
    import struct

    from ..operators.grids import rings_to_edges

    if len(content) < 100 or struct.unpack_from(">i", content)[0] != 9994:
        raise ValueError("no shapefile")
    rings, at = [], 100
    while at + 8 <= len(content):
        words = struct.unpack_from(">i", content, at + 4)[0]
        body = at + 8
        if struct.unpack_from("<i", content, body)[0] in (5, 15, 25):
            parts, points = struct.unpack_from("<ii", content, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", content, body + 44), points]
            xy = struct.unpack_from(f"<{2 * points}d", content, body + 44 + 4 * parts)
            rings += [[(xy[2 * k], xy[2 * k + 1]) for k in range(lo, hi)] for lo, hi in zip(starts, starts[1:])]
        at = body + 2 * words
    return rings_to_edges(rings)


def write_csv(df: DataFrame, path: str) -> None:
    """A small presentation table as one CSV file with a header; nulls are empty fields."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def polygon_edges(spark, geojson: str) -> list[tuple[float, float, float, float]]:
    """Edges of all rings of the polygons of a GeoJSON text, joined as one shape."""
    import json

    from ..operators.grids import rings_to_edges

    def rings(g):
        if g["type"] == "FeatureCollection":
            return [r for f in g["features"] for r in rings(f)]
        if g["type"] == "Feature":
            return rings(g["geometry"])
        if g["type"] == "MultiPolygon":
            return [r for p in g["coordinates"] for r in p]
        return g["coordinates"] if g["type"] == "Polygon" else []

    return rings_to_edges([[(float(x), float(y)) for x, y, *_ in r] for r in rings(json.loads(geojson))])
