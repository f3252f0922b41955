"""Paged providers as a Python data source.

`spark.read.format("paged")` calls a fetch function, named as module:function, with (options, at);
it returns the response's text and a number, which means, by the option `paging`:

* numbered (the default): `at` is a page from 1, the number that of pages
* offset: `at` is an offset, the number how many items there are; the option `limit` is the step.
  Where the provider doesn't tell (null), pages are walked until one is empty (a null text)
* cursor: `at` is what the page before returned, null at first; null ends

Numbered and offset pages are planned from the first response and read in parallel; a lost
partition is fetched again. Cursors and walks are sequential by nature and are one partition.
`maxpages` ends any of them. With `calls` and `seconds` the pages are dealt over `lanes` partitions
(as many as calls at most) that each wait for their share of the limit, so it holds over all
workers; a task that runs twice is counted once. Bounds pass through as options, so the provider
filters.
"""

from __future__ import annotations

import importlib
import random
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Statuses worth another try, tries, first wait in seconds and the longest.
RETRY_STATUS, TRIES, BACKOFF, LONGEST = (429, 500, 502, 503, 504), 4, 0.5, 60.0


class ProviderError(Exception):
    """A response that is an error; `status` as in HTTP, `retry_after` the seconds it asks for."""

    def __init__(self, status: int, message: str = "", retry_after: float | None = None) -> None:
        super().__init__(f"{status} {message}".strip())
        self.status, self.retry_after = status, retry_after


class NotFound(ProviderError):
    pass


def checked(status: int, message: str = "") -> None:
    """404 is NotFound, other failures ProviderError."""
    if status == 404:
        raise NotFound(status, message)
    if status >= 400:
        raise ProviderError(status, message)


def retrying(call: Callable[[], object], sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: 0.0) -> object:
    """Calls again while the failure is worth it, after a wait that doubles and grows by a part
    that jitter draws (0 to 1), or after what the provider asks for if that is longer."""
    for attempt in range(TRIES):
        try:
            return call()
        except ProviderError as e:
            if e.status not in RETRY_STATUS or attempt == TRIES - 1:
                raise
            sleep(min(LONGEST, max(BACKOFF * 2**attempt * (1 + jitter()), e.retry_after or 0.0)))
    raise AssertionError


class RateLimit:
    """At most `calls` in `seconds`, by waiting."""

    def __init__(self, calls: int, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.calls, self.seconds, self.clock, self.sleep, self.times = calls, seconds, clock, sleep, []

    def wait(self) -> None:
        now = self.clock()
        self.times = [t for t in self.times if now - t < self.seconds]
        if len(self.times) >= self.calls:
            self.sleep(self.seconds - (now - self.times[0]))
            self.times.pop(0)
        self.times.append(self.clock())


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.paging = options, options.get("paging", "numbered")
        if self.paging not in ("numbered", "offset", "cursor"):
            raise ValueError(f"no such paging: {self.paging}")
        self.step = int(options["limit"]) if self.paging == "offset" else 1
        self.most = int(options.get("maxpages") or 0)
        self.calls, self.seconds = float(options.get("calls") or 0), float(options.get("seconds") or 1)

    def _fetcher(self, limit: RateLimit | None = None) -> Callable[[object], tuple]:
        module, _, name = self.options["fetch"].partition(":")
        fn = getattr(importlib.import_module(module), name)

        def once(at: object) -> tuple:
            if limit is not None:
                limit.wait()
            return fn(self.options, at)

        return lambda at: retrying(lambda: once(at), jitter=random.random)

    def partitions(self) -> list[InputPartition]:
        """Partitions are (the places to fetch or null for a walk, how many there are)."""
        n = None
        if self.paging != "cursor":
            n = self._fetcher()(1 if self.paging == "numbered" else 0)[1]
        if n is None:
            return [InputPartition((None, 1))]
        places = list(range(1, max(1, n) + 1) if self.paging == "numbered" else range(0, max(1, n), self.step))
        places = places[: self.most or None]
        widest = max(1, int(self.calls)) if self.calls else len(places)
        lanes = min(len(places), widest, int(self.options.get("lanes") or widest))
        return [InputPartition((places[i::lanes], lanes)) for i in range(lanes)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        places, lanes = partition.value
        fetch = self._fetcher(RateLimit(1, self.seconds * lanes / self.calls) if self.calls else None)
        for at in places or ():
            yield (at if self.paging == "numbered" else at // self.step + 1), fetch(at)[0]
        if places is None:
            yield from self._walk(fetch)

    def _walk(self, fetch: Callable[[object], tuple]) -> Iterator[tuple]:
        page, at = 1, None if self.paging == "cursor" else 0
        while not self.most or page <= self.most:
            text, after = fetch(at)
            if text is None:
                return
            yield page, text
            if self.paging == "cursor" and after is None:
                return
            page, at = page + 1, after if self.paging == "cursor" else at + self.step


class PagedSource(DataSource):
    """Columns page (from 1) and body. Options: those above, and whatever the fetch function takes."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def search_query(title: Column, artist: Column) -> Column:
    """recording:"t" AND artist:"a"; null for a blank title."""
    quoted = lambda field, c: F.concat(F.lit(f'{field}:"'), c, F.lit('"'))
    return F.when(F.btrim(title) != "", F.concat_ws(" AND ", quoted("recording", title), F.when(artist != "", quoted("artist", artist))))
