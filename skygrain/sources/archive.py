"""Archives as Spark data sources, and the fetch stage.

``spark.read.format("skygrain_archive")`` lists a date-partitioned archive, one input partition a part
of time; the options ``start`` and ``end`` choose the parts before anything is listed. (Filters are
not pushed down: Spark keeps one reader for a DataFrame, and a filter pushed into it by one query
would narrow the next query on the same DataFrame.) ``spark.readStream`` of it
is the poll: the offset is the next part, and a part that fails is not passed.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import LEDGER, LISTING
from .config import ARCHIVES
from .transport import Missing, attempt, connect

_STEP = {"hourly": timedelta(hours=1), "daily": timedelta(days=1), "day_of_year": timedelta(days=1)}
_FORMAT = {"hourly": "%Y%m/%d/%H", "daily": "%Y/%m/%d", "day_of_year": "%Y/%j"}
_KEYS = ("host", "user", "password", "token", "timeout")


def part_path(root: str, layout: str, ts: datetime, tail: str = "") -> str:
    return "/".join(x for x in (root.rstrip("/"), ts.strftime(_FORMAT[layout]), tail) if x)


class _Part(InputPartition):
    def __init__(self, ts: datetime):
        self.ts = ts


def _settings(options) -> dict:
    given = {k.lower(): v for k, v in options.items()}
    known = ARCHIVES.get(given.get("product", ""), {})
    s = {k: given.get(k, v) for k, v in ({"scheme": "file", "host": "", "root": "", "layout": "daily", "tail": "", "start": "", "retries": 3, "pause": 1.0, "backoff": False, "timeout": 60} | known).items()}
    s |= {"product": given.get("product", "file"), "user": given.get("user", ""), "password": given.get("password", ""), "token": given.get("token", ""), "end": given.get("end", ""), "lag": int(given.get("lag_parts", 0))}
    if not s["root"] or s["scheme"] != "file" and not s["host"]:
        raise ValueError("an archive needs root, and host unless it is a folder")
    s["retries"], s["pause"], s["timeout"] = int(s["retries"]), float(s["pause"]), float(s["timeout"])
    return s


def list_part(s: dict, ts: datetime) -> list[tuple]:
    """LISTING rows of one part; none if the part is missing."""
    at = part_path(s["root"], s["layout"], ts, s["tail"])

    def names():
        link = connect(s["scheme"], **{k: s[k] for k in _KEYS})
        try:
            return link.list(at)
        finally:
            link.close()

    try:
        found = attempt(names, s["retries"], s["pause"], str(s["backoff"]).lower() == "true")
    except Missing:
        return []
    return [(s["product"], ts, name, size, f"{at}/{name}") for name, size in found]


class _Reader(DataSourceReader):
    def __init__(self, s: dict):
        self.s, self.low = s, datetime.fromisoformat(s["start"])
        self.high = datetime.fromisoformat(s["end"]) if s["end"] else datetime.utcnow()

    def partitions(self):
        step, start = _STEP[self.s["layout"]], datetime.fromisoformat(self.s["start"])
        first = start + step * max(0, -(-(self.low - start) // step))
        out = []
        while first < self.high:
            out.append(_Part(first))
            first += step
        return out

    def read(self, partition):
        yield from list_part(self.s, partition.ts)


class _Stream(DataSourceStreamReader):
    """Parts from ``start`` to ``end`` (or now, less ``lag_parts``), in order."""

    def __init__(self, s: dict):
        self.s, self.step = s, _STEP[s["layout"]]

    def initialOffset(self):
        return {"next": self.s["start"]}

    def latestOffset(self):
        end = datetime.fromisoformat(self.s["end"]) if self.s["end"] else datetime.utcnow()
        start = datetime.fromisoformat(self.s["start"])
        return {"next": str(start + self.step * max(0, (end - start) // self.step - self.s["lag"]))}

    def partitions(self, start, end):
        ts, high, out = datetime.fromisoformat(start["next"]), datetime.fromisoformat(end["next"]), []
        while ts < high:
            out.append(_Part(ts))
            ts += self.step
        return out

    def read(self, partition):
        return iter(list_part(self.s, partition.ts))

    def commit(self, end):
        pass


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "skygrain_archive"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return _Reader(_settings(self.options))

    def streamReader(self, schema):
        return _Stream(_settings(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def fetch(listing: DataFrame, scheme: str = "file", per_task: int = 50, retries: int = 3, pause: float = 1.0, backoff: bool = False, throttle: float = 0.0, renew_after: float = 1800.0, batch_bytes: int = 32 << 20, **access) -> DataFrame:
    """LEDGER rows and ``content`` of each listed file. Errors become rows with a status; nothing is half written.

    Files are dealt evenly; a task keeps one connection and renews it after ``per_task`` files, ``renew_after``
    seconds or an error. ``throttle`` seconds lie between two files of a task. Contents are handed on once
    ``batch_bytes`` are held.
    """
    columns = ["product", "part_ts", "name", "status", "bytes", "at", "reason", "content"]

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        link, used, opened, first = None, 0, 0.0, True
        for batch in batches:
            out, held = [], 0
            for r in batch.itertuples(index=False):
                content, status, reason = None, "new", None
                if throttle and not first:
                    time.sleep(throttle)
                first = False
                try:
                    if link is None or used >= per_task or time.monotonic() - opened >= renew_after:
                        if link is not None:
                            link.close()
                        link, used, opened = connect(scheme, **access), 0, time.monotonic()
                    content = attempt(lambda url=r.url: link.fetch(url), retries, pause, backoff)
                    used += 1
                    if not content:
                        status, reason = "error", "empty"
                except Missing as e:
                    status, reason = "missing", str(e)
                except TimeoutError as e:
                    status, reason, link = "timeout", str(e), None
                except Exception as e:
                    status, reason, link = "error", f"{type(e).__name__}: {e}", None
                out.append((r.product, r.part_ts, r.name, status, len(content or b""), pd.Timestamp.utcnow().tz_localize(None), reason, content))
                held += len(content or b"")
                if held >= batch_bytes:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=columns)
        if link is not None:
            link.close()

    return listing.repartition(F.col("url")).mapInPandas(get, LEDGER + ", content binary")


def fetch_urls(urls: DataFrame, **access) -> DataFrame:
    """Fetch a cleaned URL list: one row a URL, with errors as statuses."""
    named = urls.select(F.lit("urls").alias("product"), F.lit(None).cast("timestamp").alias("part_ts"), F.element_at(F.split("url", "/"), -1).alias("name"), F.lit(None).cast("long").alias("size"), "url")
    return fetch(named, scheme=access.pop("scheme", "https"), host="", **access)
