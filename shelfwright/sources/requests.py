"""Requests to the providers, and which of the records that come back answers one.

A request has two addresses: the one under which its answer is kept, with its parameters in order and without keys, and the
one that is fetched. Endpoints, parameter names and bounds are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import series_key, split_google, split_rakuten
from ..operators.joins import authors_compatible, folded_author
from ..operators.keyed import first_per_key

NDL = "https://ndlsearch.ndl.go.jp/api/opensearch"
RAKUTEN = "https://openapi.rakuten.co.jp/services/api/BooksBook/Search/20170404"
GOOGLE = "https://www.googleapis.com/books/v1/volumes"
OPENBD = "https://api.openbd.jp/v1/get"
MOST = {"ndl": 500, "rakuten": 30, "google": 40}
#: Statuses of answers that are not kept: they should pass as soon as a key, a quota or a server is mended.
NEVER_KEPT = (400, 401, 403, 429, 500, 502, 503, 504)


class Request(NamedTuple):
    provider: str
    kept: str
    fetched: str


def _isbn(text: str | None) -> str | None:
    bare = "".join(c for c in (text or "").upper() if c in "0123456789X")
    return bare if len(bare) in (10, 13) else None


def _request(provider: str, endpoint: str, params: dict[str, str], secret: dict[str, str] | None = None) -> Request:
    kept = f"{endpoint}?{urlencode(sorted(params.items()))}"
    return Request(provider, kept, kept + "".join(f"&{urlencode({k: v})}" for k, v in (secret or {}).items() if v))


def _bounded(provider: str, n: int | None) -> str:
    return str(max(1, min(MOST[provider] if n is None else n, MOST[provider])))


def _some(**values: str | None) -> dict[str, str]:
    known = {k: v for k, v in values.items() if v}
    if not known:
        raise ValueError("an ISBN, a title or an author is needed")
    return known


def ndl(title: str | None = None, creator: str | None = None, isbn: str | None = None, most: int | None = None) -> Request:
    return _request("ndl", NDL, {"mediatype": "books", "cnt": _bounded("ndl", most)} | _some(title=title, creator=creator, isbn=_isbn(isbn)))


def rakuten(secret: dict[str, str], title: str | None = None, author: str | None = None, isbn: str | None = None, most: int | None = None) -> Request:
    return _request("rakuten", RAKUTEN, {"format": "json", "hits": _bounded("rakuten", most)} | _some(isbn=_isbn(isbn), title=title, author=author), secret)


def google(secret: dict[str, str], title: str | None = None, author: str | None = None, isbn: str | None = None, most: int | None = None, country: str = "JP") -> Request:
    """By ISBN alone if there is one, else by quoted fields."""
    quoted = lambda field, v: f'{field}:"{q}"' if (q := "".join(" " if c in '"”“' else c for c in v or "").strip()) else None
    terms = _some(isbn=f"isbn:{i}") if (i := _isbn(isbn)) else _some(title=quoted("intitle", title), author=quoted("inauthor", author))
    return _request("google", GOOGLE, {"q": " ".join(terms.values()), "maxResults": _bounded("google", most), "printType": "books", "country": country}, secret)


def openbd(isbn: str) -> Request:
    return _request("openbd", OPENBD, _some(isbn=_isbn(isbn)))


def first_fitting(ask: Callable[[str | None], list[dict]], creators: list[str], title: str | None, enough: int = 2) -> tuple[list[dict], str | None]:
    """The records of the spelling of an author that gives most usable ones (with ISBN and volume), and that spelling.

    Spellings are asked for in turn until one gives ``enough``; if none gives any and there is a title, it is asked for alone.
    """
    usable = lambda found: sum(bool(r.get("isbn")) and r.get("volume") is not None for r in found)
    best: tuple[list[dict], str | None] = ([], None)
    for n, c in enumerate(creators):
        found = ask(c)
        if not n or usable(found) > usable(best[0]):
            best = (found, c)
        if usable(found) >= enough:
            return best
    alone = ask(None) if title and not usable(best[0]) else []
    return (alone, None) if alone else best


def by_isbn(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """wanted (id, isbn) with the record of that ISBN: a large image first, then any image, then the first; none gives no row."""
    large = F.col("large") if "large" in records.columns else F.lit(False)
    image = F.col("image_url").isNotNull()
    d = wanted.select("id", "isbn").join(records, "isbn")
    return first_per_key(d, ["id"], [F.desc(image & F.coalesce(large, F.lit(False))), F.desc(image), F.col("ordinal")])


def _read_once(df: DataFrame, text: str, **read: Callable[[Column], Column]) -> DataFrame:
    """Adds what Python reads from a text. Each distinct text is read once, by as many tasks as a shuffle has, however few the input's."""
    one = df.select(F.col(text).alias("_text")).where("_text is not null").distinct()
    return df.join(one.select("_text", *(f(F.col("_text")).alias(name) for name, f in read.items())), F.col(text) == F.col("_text")).drop("_text")


def by_title(wanted: DataFrame, records: DataFrame, provider: str) -> DataFrame:
    """wanted (id, title, author, volume) with the first record that has an image, the volume, the same key, and no other author."""
    split = {"rakuten": split_rakuten, "google": split_google}[provider]
    r = _read_once(records.where("image_url is not null").drop("volume"), "title", _s=split)
    r = _read_once(r.select("*", F.col("_s.base").alias("_base"), F.col("_s.volume").alias("volume")).drop("_s"), "_base", _key=series_key).drop("_base").withColumnRenamed("author", "_author")
    r = first_per_key(r.where("_key <> ''").withColumn("_who", folded_author(F.col("_author"))), ["_key", "volume", "_who"], [F.col("ordinal")])
    w = _read_once(wanted, "title", _key=series_key).select("id", folded_author(F.col("author")).alias("_want"), "volume", "_key").where("_key <> ''")
    # authors meet once for each key and volume, however many works and records have them
    asked = w.select("_key", "volume", "_want").distinct()
    d = asked.join(r, ["_key", "volume"]).where(authors_compatible(F.col("_want"), F.col("_who")))
    best = first_per_key(d, ["_key", "volume", "_want"], [F.col("ordinal")])
    d = w.join(best, ["_key", "volume", "_want"])
    return first_per_key(d, ["id"], [F.col("ordinal")]).withColumnRenamed("_author", "author").drop("_key", "_want", "_who")
