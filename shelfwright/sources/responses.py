"""Cached responses: latest per key, good ones outliving errors, and a driver-side connector that asks at a bounded rate."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Collection
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cache_key
from ..operators.keyed import stale_if_error

#: Days a good response is fresh, and the minutes an error is.
GOOD_DAYS, ERROR_MINUTES = 90, 60


class ProviderStop(RuntimeError):
    """Ends a run: keys, quotas and rates that more requests would not mend."""


class AuthStop(ProviderStop):
    pass


class QuotaStop(ProviderStop):
    pass


def good(status: Column) -> Column:
    return status.between(200, 299)


def keyed(log: DataFrame) -> DataFrame:
    return log.withColumn("key", cache_key(F.col("provider"), F.col("url")))


def current(log: DataFrame, tie: str = "id") -> DataFrame:
    """One row per key: the latest good response, else the latest; ``stale`` if later ones failed."""
    return stale_if_error(log, ["key"], good(F.col("status")), "fetched_at", tie)


def fresh(log: DataFrame, now: Column) -> DataFrame:
    """Of the current rows those that need no request yet."""
    return current(log).where(F.col("expires_at") > now)


def expiry(status: Column, at: Column) -> Column:
    minutes = F.when(good(status), F.lit(GOOD_DAYS * 24 * 60)).otherwise(F.lit(ERROR_MINUTES))
    return at + F.make_dt_interval(mins=minutes)


def in_force(log: DataFrame, tie: str = "id") -> DataFrame:
    """The log with ``until``: a response answers from when it was fetched until it expires or the next of its key is kept."""
    following = F.lead("fetched_at").over(Window.partitionBy("key").orderBy("fetched_at", tie))
    return log.withColumn("until", F.least("expires_at", following))


def with_hits(log: DataFrame, asked: DataFrame, tie: str = "id") -> DataFrame:
    """The log with ``hits``: how many requests (key, at) each response answered.

    Requests of one key and time are one row before they meet the responses, and they meet by key and day, so that neither a
    key that is asked for all the time nor a long time of one response is a task of its own. ``tie`` is unique.
    """
    days = F.explode(F.sequence(F.to_date("fetched_at"), F.to_date("until"), F.expr("interval 1 day")))
    force = in_force(log, tie).where("fetched_at < until").select(tie, "key", "fetched_at", "until", days.alias("_day"))
    few = asked.groupBy("key", "at").agg(F.count("*").alias("_n")).withColumn("_day", F.to_date("at"))
    met = few.join(force, ["key", "_day"]).where((F.col("at") >= F.col("fetched_at")) & (F.col("at") < F.col("until")))
    hits = met.groupBy(tie).agg(F.sum("_n").alias("hits"))
    return log.join(hits, tie, "left").withColumn("hits", F.coalesce("hits", F.lit(0))).select(*log.columns, "hits")


class Throttle:
    """Least seconds between two requests to one provider. It lives on the driver: executors never ask."""

    def __init__(self, seconds: float = 1.2, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep, self.last = seconds, clock, sleep, {}

    def wait(self, provider: str, seconds: float | None = None) -> None:
        due = self.last.get(provider, float("-inf")) + (self.seconds if seconds is None else seconds)
        if (rest := due - self.clock()) > 0:
            self.sleep(rest)
        self.last[provider] = self.clock()


class Cache:
    """A connector over a small in-memory index of responses; ``log`` is what to append to the table."""

    def __init__(self, fetch: Callable[[str], tuple[int, str]], throttle: Throttle | None = None, rows: list[dict] = (), clock: Callable[[], datetime] = datetime.now):
        self.fetch, self.throttle, self.clock = fetch, throttle or Throttle(), clock
        self.best = {(r["provider"], r["url"]): r for r in rows}
        self.log: list[dict] = []
        self.hits: Counter = Counter()  # answers from here, by (provider, url): what to add to the table's counts

    def get(self, provider: str, url: str, fetched: str | None = None, never: Collection[int] = ()) -> dict:
        """A fresh row; else what is fetched now; else, on failure, the old good one marked stale. Failures of other kinds are raised.

        ``url`` is the address under which the answer is kept, ``fetched`` the one to ask, which may hold a key. Answers
        whose status is in ``never`` are not kept.
        """
        known, now = self.best.get((provider, url)), self.clock()
        if known and known["expires_at"] > now:
            self.hits[provider, url] += 1
            return known | {"stale": False}
        self.throttle.wait(provider)
        try:
            status, body = self.fetch(fetched or url)
        except ProviderStop:
            raise
        except OSError:
            if known:
                return known | {"stale": True}
            raise
        ok = 200 <= status < 300
        row = {"provider": provider, "url": url, "status": status, "body": body, "fetched_at": now, "expires_at": now + (timedelta(days=GOOD_DAYS) if ok else timedelta(minutes=ERROR_MINUTES))}
        if status not in never:
            self.log.append(row)
        if not ok and known and 200 <= known["status"] < 300:
            return known | {"stale": True}
        if status not in never:
            self.best[provider, url] = row
        return row | {"stale": False}
