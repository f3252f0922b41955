"""Paged providers as a stream that goes on where it stopped.

`spark.readStream.format("paged_stream")` calls the same fetch functions as the batch source, and
`newest`, a function named as module:function, with the options; it tells how far the provider has
come, and must not go back. Offsets are places of the provider, kept by Spark with the query's
checkpoint, and a batch is what lies between two of them, so a batch that is run again fetches the
same. By `paging`:

* numbered: places are seconds. A batch is a window, given to the fetch function as the options
  `from` (the second after the last one read) and `to`; its pages are read in parallel. Only the
  first page is asked for with `from`, which later ones don't need, as pages go backwards from
  `to`; what lies before the window is told by the column `after` and left to `within`
* offset: places are counts of items, which are only ever added; `limit` is the step
* cursor: places are cursors; a batch walks from one to the other

`from` is where a new stream begins (0, or null for cursors). `calls` and `seconds` limit the calls
as they do for the batch source.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from mergewell.sources.paged import RateLimit, _Reader


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options, self.paging = options, options.get("paging", "numbered")
        module, _, name = options["newest"].partition(":")
        self.newest = getattr(importlib.import_module(module), name)

    def _batch_reader(self, **bounds: object) -> _Reader:
        """The batch source's reader, whose fetch function also gets the bounds."""
        return _Reader({**self.options, **{k: str(v) for k, v in bounds.items() if v is not None}})

    def initialOffset(self) -> dict:
        start = self.options.get("from")
        return {"at": start if self.paging == "cursor" else int(start or 0)}

    def latestOffset(self) -> dict:
        newest = self.newest(self.options)
        return {"at": newest if self.paging == "cursor" else max(int(newest), self.initialOffset()["at"])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Partitions are (start, end, places or null for a walk, how many partitions there are)."""
        a, b = start["at"], end["at"]
        if a == b:
            return [InputPartition((a, b, [], 1))]
        if self.paging == "cursor":
            return [InputPartition((a, b, None, 1))]
        if self.paging == "numbered":
            pages = self._batch_reader(**{"from": a + 1, "to": b})._fetcher()(1)[1]
            places = list(range(1, max(1, pages) + 1))
        else:
            places = list(range(a, b, int(self.options["limit"])))
        widest = max(1, int(float(self.options["calls"]))) if self.options.get("calls") else len(places)
        lanes = min(len(places), widest, int(self.options.get("lanes") or widest))
        return [InputPartition((a, b, places[i::lanes], lanes)) for i in range(lanes)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b, places, lanes = partition.value
        reader = self._batch_reader(to=b)
        limit = RateLimit(1, reader.seconds * lanes / reader.calls) if reader.calls else None
        if places is None:
            fetch, at, page = reader._fetcher(limit), a, 1
            while at != b:
                body, at = fetch(at)
                if body is None:
                    return
                yield page, body, None
                if at is None:
                    return
                page += 1
            return
        for at in places:
            if self.paging == "numbered":
                own = self._batch_reader(**{"from": a + 1, "to": b}) if at == 1 else reader
                yield at, own._fetcher(limit)(at)[0], a
            else:  # the last page of a batch ends with the batch
                own = self._batch_reader(to=b, limit=min(int(self.options["limit"]), b - at))
                yield (at - a) // int(self.options["limit"]) + 1, own._fetcher(limit)(at)[0], a

    def commit(self, end: dict) -> None:
        """Nothing to give back: what was read stays readable."""


class PagedStream(DataSource):
    """Columns page (of the batch, from 1), body and after (the place before the batch)."""

    @classmethod
    def name(cls) -> str:
        return "paged_stream"

    def schema(self) -> str:
        return "page int, body string, after long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedStream)


def within(rows: DataFrame, at: str = "played_at", after: str = "after") -> DataFrame:
    """Rows of numbered pages that lie in their window."""
    return rows.where(F.unix_seconds(F.col(at)) > F.col(after))
