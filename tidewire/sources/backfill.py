"""Paged backfill: a Python data source that reads a Parquet table page by page, as a batch or as a stream that goes on where it stopped.

    spark.dataSource.register(Paged)
    spark.read.format("paged").options(path=..., key="event_id", size=500, at="ts", since=..., until=...).load()

A page is a range of `size` numbers of `key`, counted from the least one. With `most`, only the highest `most` numbers are read: the hard cap of a
backfill. `since` and `until` are a window over `at`, both ends in; rows without date stay, rows without number go. Each page is a Spark partition: the
row groups that its range touches are read in Arrow batches, with the columns of the schema alone, and others are skipped by their statistics. The
stream's offset is the next number to read: with a checkpoint no page is lost or read twice, and rows that are added under higher numbers come next.
Paths are those that pyarrow opens (files, hdfs://, s3://, gs://); what only Spark can open is read by spark.read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_NEXT = "next"


@dataclass
class Page(InputPartition):
    """Numbers from `low` up to, not including, `high`."""

    low: int
    high: int


class _Table:
    """The table behind a source: its bounds, its pages and their rows."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.key, self.schema = options["path"], options["key"], schema
        self.size, self.most = int(options.get("size", 500)), int(options["most"]) if "most" in options else None
        self.at, self.since, self.until = options.get("at"), options.get("since"), options.get("until")
        if self.size < 1 or (self.most is not None and self.most < 0):
            raise ValueError("size is 1 or more, most is 0 or more")
        if (self.since or self.until) and not self.at:
            raise ValueError("since and until need the column `at`")

    def open(self):
        return _dataset(self.path)

    def bounds(self) -> tuple[int, int]:
        """The least number that is read, and one more than the highest, from the statistics of the row groups; (0, 0) for an empty table."""
        low = high = None
        for part in self.open().get_fragments():
            column = part.physical_schema.get_field_index(self.key)
            for g in range(part.metadata.num_row_groups):
                stats = part.metadata.row_group(g).column(column).statistics
                if stats is None or not stats.has_min_max:
                    if stats is not None and stats.null_count == part.metadata.row_group(g).num_rows:
                        continue
                    raise ValueError(f"{self.path}: a row group has no bounds of {self.key}")
                low = stats.min if low is None else min(low, stats.min)
                high = stats.max if high is None else max(high, stats.max)
        if low is None:
            return 0, 0
        return (low if self.most is None else max(low, high + 1 - self.most)), high + 1

    def pages(self, low: int, high: int) -> list[Page]:
        return [Page(x, min(x + self.size, high)) for x in range(low, high, self.size)]

    def rows(self, page: Page) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        key, at = ds.field(self.key), ds.field(self.at) if self.at else None
        test = (key >= page.low) & (key < page.high)
        data = self.open()
        if self.since or self.until:
            kind = data.schema.field(self.at).type
            inside = ds.scalar(True)
            for bound, keep in ((self.since, lambda t: at >= t), (self.until, lambda t: at <= t)):
                if bound:
                    inside = inside & keep(_moment(bound, kind))
            test = test & (at.is_null() | inside)
        arrow = to_arrow_schema(self.schema)
        for batch in data.to_batches(columns=arrow.names, filter=test):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=True)], schema=arrow)


def _dataset(path: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    return ds.dataset(inner, format="parquet", filesystem=system)


def _moment(text: str, kind: pa.DataType) -> pa.Scalar:
    import datetime as dt

    return pa.scalar(dt.datetime.fromisoformat(text), pa.timestamp("us")).cast(pa.timestamp(kind.unit)).cast(kind)


class _Batch(DataSourceReader):
    def __init__(self, table: _Table):
        self.table = table

    def partitions(self) -> list[Page]:
        # a table without rows has one empty page
        return self.table.pages(*self.table.bounds()) or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self.table.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, table: _Table):
        self.table = table

    def initialOffset(self) -> dict:
        return {_NEXT: self.table.bounds()[0]}

    def latestOffset(self) -> dict:
        return {_NEXT: self.table.bounds()[1]}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.table.pages(start[_NEXT], end[_NEXT])

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self.table.rows(partition)


class Paged(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_dataset(self.options["path"]).schema, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(_Table(dict(self.options), schema))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_Table(dict(self.options), schema))
