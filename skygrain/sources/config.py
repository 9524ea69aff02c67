"""Credentials and endpoints from the environment; nothing secret has a default, and nothing is stored."""

from __future__ import annotations

import os
from dataclasses import dataclass

# Where the archives are and how they are laid out. Nothing here is contacted unless a caller asks for it.
ARCHIVES = {
    "aerosol": {"scheme": "ftp", "host": "ftp.ptree.jaxa.jp", "root": "/pub/himawari/L2/ARP/031", "layout": "hourly", "tail": "", "start": "2023-12-04 00:00:00", "max_missing": 24, "retries": 3, "pause": 5.0, "backoff": False, "timeout": 30},
    "precipitation": {"scheme": "ftps", "host": "", "root": "/gpmdata", "layout": "daily", "tail": "gis", "start": "2025-06-30 00:00:00", "max_missing": 1, "retries": 3, "pause": 1.0, "backoff": True, "timeout": 60},
    "surface_temperature": {"scheme": "https", "host": "ladsweb.modaps.eosdis.nasa.gov", "root": "/archive/allData/61/MOD11A1", "layout": "day_of_year", "tail": "", "start": "2025-11-07 00:00:00", "max_missing": 1, "retries": 3, "pause": 0.5, "backoff": False, "timeout": 60},
}


@dataclass(frozen=True)
class Access:
    host: str = ""
    user: str = ""
    password: str = ""
    token: str = ""

    @classmethod
    def of(cls, prefix: str) -> Access:
        get = lambda k: os.environ.get(f"{prefix}_{k}", "")
        return cls(get("HOST"), get("USER"), get("PASSWORD"), get("TOKEN"))

    def complete(self, *names: str) -> bool:
        return all(getattr(self, n) for n in names)
