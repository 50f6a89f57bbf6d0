"""Custom sources on the Python data source API.

A source is a function of the user, ``fetch(lo, hi, options)``, that yields Arrow record batches with
the rows whose slice column (an integer) lies in ``[lo, hi)``.  Slices are planned as partitions, so
fetching is spread over the executors, and a lost task fetches its own slice again.  Comparisons of
the slice column in a query narrow the slices before anything is fetched.  The same function serves
batch reads, the newest rows and streams, whose offsets are values of the slice column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

Fetch = Callable[[int, int, dict[str, str]], Iterable[pa.RecordBatch]]
Latest = Callable[[dict[str, str]], int]

SLICE_ROWS = 100_000
BATCH_ROWS = 10_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Slice(ds.InputPartition):
    """Rows with the slice column in ``[lo, hi)``."""

    def __init__(self, lo: int, hi: int) -> None:
        super().__init__((lo, hi))


def slices(lo: int, hi: int, options: dict[str, str]) -> list[Slice]:
    """``[lo, hi)`` in slices of ``sliceRows``; an empty range has none."""
    width = int(options.get("sliceRows", SLICE_ROWS))
    return [Slice(a, min(a + width, hi)) for a in range(lo, hi, width)]


def _read(fetch: Fetch, options: dict[str, str], partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
    """The rows of a slice in batches of at most ``batchRows``, whatever the function yields."""
    rows = int(options.get("batchRows", BATCH_ROWS))
    for batch in fetch(*partition.value, options):
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


class _Reader(ds.DataSourceReader):
    def __init__(self, fetch: Fetch, column: str, lo: int, hi: int, options: dict[str, str]) -> None:
        self.fetch, self.column, self.lo, self.hi, self.options = fetch, column, lo, hi, options

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != (self.column,) or not self._narrowed(f):
                yield f

    def _narrowed(self, f: ds.Filter) -> bool:
        """Narrow the range by a filter; False where a range cannot express it."""
        if isinstance(f, ds.IsNotNull):  # the slice column is never null
            return True
        value = getattr(f, "value", None)
        if not isinstance(value, int):
            return False
        if isinstance(f, (ds.GreaterThanOrEqual, ds.EqualTo)):
            self.lo = max(self.lo, value)
        if isinstance(f, (ds.LessThanOrEqual, ds.EqualTo)):
            self.hi = min(self.hi, value + 1)
        if isinstance(f, ds.GreaterThan):
            self.lo = max(self.lo, value + 1)
        if isinstance(f, ds.LessThan):
            self.hi = min(self.hi, value)
        return isinstance(f, (ds.GreaterThanOrEqual, ds.EqualTo, ds.LessThanOrEqual, ds.GreaterThan, ds.LessThan))

    def partitions(self) -> Sequence[ds.InputPartition]:
        # a read without partitions would be one of a whole table, so an empty range is one empty slice
        return slices(self.lo, self.hi, self.options) or [Slice(self.lo, self.lo)]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        lo, hi = partition.value
        if lo < hi:
            yield from _read(self.fetch, self.options, partition)


class _StreamReader(ds.DataSourceStreamReader):
    def __init__(self, fetch: Fetch, lo: int, latest: Latest, options: dict[str, str]) -> None:
        self.fetch, self.lo, self.latest, self.options = fetch, lo, latest, options

    def initialOffset(self) -> dict:
        return {"next": self.lo}

    def latestOffset(self) -> dict:
        return {"next": max(self.lo, self.latest(self.options))}

    def partitions(self, start: dict, end: dict) -> Sequence[ds.InputPartition]:
        return slices(start["next"], end["next"], self.options)

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _read(self.fetch, self.options, partition)


def register_source(spark: SparkSession, format_name: str, ddl: str, fetch: Fetch, column: str, latest: Latest | None = None) -> None:
    """Register ``format_name`` for ``spark.read`` and ``spark.readStream``, sliced by ``column``.

    Options: ``start`` (default 0), ``end`` (default: what ``latest(options)`` answers on the driver, the
    first value that is not there yet), ``last`` (only that many newest values), ``sliceRows``, ``batchRows``.
    Turns on Spark's filter pushdown for Python sources, which the reader needs.
    """
    spark.conf.set(PUSHDOWN, "true")

    def newest(options: dict[str, str]) -> int:
        if "end" in options:
            return int(options["end"])
        if latest is None:
            raise ValueError(f"{format_name} needs the option 'end' or a function for its newest value")
        return latest(options)

    class Source(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return ddl

        def reader(self, schema: Any) -> ds.DataSourceReader:
            options = self.options  # names in any case
            hi, lo = newest(options), int(options.get("start", "0"))
            if "last" in options:
                lo = max(lo, hi - int(options["last"]))
            return _Reader(fetch, column, lo, hi, options)

        def streamReader(self, schema: Any) -> ds.DataSourceStreamReader:
            options = self.options  # names in any case
            return _StreamReader(fetch, int(options.get("start", "0")), newest, options)

    spark.dataSource.register(Source)
