"""Listing and fetching over file, ftp, ftps and https; used inside tasks, one connection a task."""

from __future__ import annotations

import csv
import io
import json
import os
import ssl
import time
import urllib.error
import urllib.parse
import urllib.request


class Missing(Exception):
    """The part does not exist (yet)."""


class FileTransport:
    """A folder in shared storage or a mirror, for tests and for archives on a mount."""

    def __init__(self, **_):
        pass

    def list(self, path: str) -> list[tuple[str, int | None]]:
        if not os.path.isdir(path):
            raise Missing(path)
        return [(n, os.path.getsize(os.path.join(path, n))) for n in sorted(os.listdir(path))]

    def fetch(self, path: str) -> bytes:
        with open(path, "rb") as f:
            return f.read()

    def close(self) -> None:
        pass


class FtpTransport:
    def __init__(self, host: str, user: str = "", password: str = "", timeout: float = 30, secure: bool = False, **_):
        import ftplib

        self.lib = ftplib
        if secure:
            context = ssl.create_default_context()
            context.minimum_version = ssl.TLSVersion.TLSv1_2
            self.ftp = ftplib.FTP_TLS(context=context, timeout=timeout)
        else:
            self.ftp = ftplib.FTP(timeout=timeout)
        self.ftp.connect(host, 21)
        self.ftp.login(user, password)
        if secure:
            self.ftp.prot_p()

    def list(self, path: str) -> list[tuple[str, int | None]]:
        try:
            self.ftp.cwd("/")
            self.ftp.cwd(path)
            return [(n, None) for n in self.ftp.nlst()]
        except self.lib.error_perm as e:
            if "550" in str(e):
                raise Missing(path) from e
            raise

    def fetch(self, path: str) -> bytes:
        out = io.BytesIO()
        self.ftp.retrbinary(f"RETR {path}", out.write)
        return out.getvalue()

    def close(self) -> None:
        try:
            self.ftp.quit()
        except Exception:
            self.ftp.close()


class HttpsTransport:
    """Listings are ``<part>.csv``, or ``<part>.json`` where that is refused."""

    def __init__(self, host: str, token: str = "", timeout: float = 60, scheme: str = "https", **_):
        self.base, self.timeout = f"{scheme}://{host}", timeout
        self.headers = {"Authorization": f"Bearer {token}"} if token else {}
        self.context = ssl.create_default_context()
        self.context.minimum_version = ssl.TLSVersion.TLSv1_2

    def _get(self, path: str) -> bytes:
        url = path if "://" in path else self.base + urllib.parse.quote(path)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout, context=self.context) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise Missing(path) from e
            raise

    def list(self, path: str) -> list[tuple[str, int | None]]:
        try:
            rows = csv.DictReader(io.StringIO(self._get(path + ".csv").decode()), skipinitialspace=True)
            return [(r["name"], int(r["size"]) if r.get("size") else None) for r in rows]
        except (Missing, KeyError, ValueError, urllib.error.HTTPError):
            return [(r["name"], r.get("size")) for r in json.loads(self._get(path + ".json")).get("content", [])]

    fetch = _get

    def close(self) -> None:
        pass


def connect(scheme: str, **options):
    if scheme == "file":
        return FileTransport(**options)
    if scheme in ("ftp", "ftps"):
        return FtpTransport(secure=scheme == "ftps", **options)
    if scheme in ("http", "https"):
        return HttpsTransport(scheme=scheme, **options)
    raise ValueError(f"no transport for {scheme}")


def attempt(f, retries: int = 3, pause: float = 1.0, backoff: bool = False, sleep=time.sleep):
    """``f()``, again after errors; a missing part is no error. The last error is raised."""
    for k in range(retries):
        try:
            return f()
        except Missing:
            raise
        except Exception:
            if k == retries - 1:
                raise
            sleep(pause * 2**k if backoff else pause)
