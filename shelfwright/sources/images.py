"""Images of covers on the driver: fetched at a bounded rate, checked, and kept under the hash of their content."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import host_allowed
from .responses import Throttle

# Hosts that covers may come from, pages that are named as where a request comes from, and the least size.
HOSTS = [
    "https://ndlsearch.ndl.go.jp/thumbnail/",
    "https://thumbnail.image.rakuten.co.jp/",
    "https://image.rakuten.co.jp/",
    "https://books.rakuten.co.jp/",
    "https://shop.r10s.jp/",
    "https://books.google.com/books/content",
    "https://books.google.co.jp/books/content",
    "https://cover.openbd.jp/",
]
REFERERS = {
    "https://ndlsearch.ndl.go.jp/": "https://ndlsearch.ndl.go.jp/",
    "https://cover.openbd.jp/": "https://openbd.jp/",
    "https://books.google.com/": "https://books.google.com/",
    "https://books.google.co.jp/": "https://books.google.com/",
}
OTHER_REFERER = "https://books.rakuten.co.jp/"
LEAST_BYTES = 2000
EXTENSIONS = {"png": ".png", "webp": ".webp"}


def referer(url: Column) -> Column:
    out = F.lit(OTHER_REFERER)
    for start, page in REFERERS.items():
        out = F.when(F.startswith(url, F.lit(start)), page).otherwise(out)
    return out


def allowed(url: Column) -> Column:
    return host_allowed(url, HOSTS)


def cover_url(id_: Column, file: Column) -> Column:
    """Where a cover is shown; the start of its content's hash makes a new image a new address."""
    version = F.substring(F.regexp_replace(F.coalesce(file, F.lit("")), r"\.[^.]*$", ""), 1, 12)
    return F.concat(F.lit("/api/covers/"), id_.cast("string"), F.when(version != "", F.concat(F.lit("?v="), version)).otherwise(""))


def _put(folder: str, name: str, content: bytes) -> str:
    """Written once, under a temporary name first, so that a reader sees all of it or nothing."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        temp = f"{path}.{os.getpid()}.part"
        with open(temp, "wb") as f:
            f.write(content)
        os.replace(temp, path)
    return name


class Images:
    """``fetch`` (url, headers) gives (status, bytes, content type); thumbnails are kept by the hash of their address."""

    def __init__(self, folder: str, fetch: Callable[[str, dict[str, str]], tuple[int, bytes, str | None]], throttle: Throttle | None = None, placeholders: Collection[str] = ()):
        self.folder, self.fetch, self.throttle, self.placeholders = folder, fetch, throttle or Throttle(), set(placeholders)

    def _get(self, provider: str, url: str, seconds: float | None = None) -> tuple[int, bytes, str | None]:
        self.throttle.wait(provider, seconds)
        page = next((p for start, p in REFERERS.items() if url.startswith(start)), OTHER_REFERER)
        return self.fetch(url, {"Referer": page})

    def keep(self, provider: str, url: str) -> str | None:
        """The file name of a cover that is worth keeping, else None."""
        if not any(map(url.startswith, HOSTS)):
            return None
        status, content, kind = self._get(provider, url)
        digest = hashlib.sha256(content).hexdigest()[:32]
        if status != 200 or len(content) < LEAST_BYTES or digest in self.placeholders:
            return None
        ext = next((e for k, e in EXTENSIONS.items() if k in (kind or "")), ".jpg")
        return _put(os.path.join(self.folder, "covers"), digest + ext, content)

    def thumbnail(self, provider: str, url: str, seconds: float = 0.3) -> bytes | None:
        """What a page shows of a candidate; asked for once."""
        folder, name = os.path.join(self.folder, "thumbs"), hashlib.sha256(url.encode()).hexdigest()
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            if not any(map(url.startswith, HOSTS)):
                return None
            status, content, _ = self._get(provider, url, seconds)
            if status != 200:
                return None
            _put(folder, name, content)
        with open(path, "rb") as f:
            return f.read()


def probes(asked: DataFrame, covers: DataFrame) -> DataFrame:
    """asked (series_id, slot) with has_cover, pinned, and has_volume_cover: whether any volume of the series has one."""
    own = covers.select("series_id", "slot", F.coalesce("pinned", F.lit(False)).alias("pinned"), F.lit(True).alias("has_cover"))
    of_volumes = covers.where(F.startswith("slot", F.lit("v:"))).select("series_id").distinct().withColumn("has_volume_cover", F.lit(True))
    d = asked.join(own, ["series_id", "slot"], "left").join(of_volumes, "series_id", "left")
    return d.na.fill(False, ["pinned", "has_cover", "has_volume_cover"])
