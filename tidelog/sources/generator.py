"""A data source of made-up mutations, as a table or a stream: spark.read.format("tidelog_load").option("rows", n)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "vb long, seqno long, cid long, key string, value string, cas long, rev long, deleted boolean"


class Span(InputPartition):
    """Seqnos (start, stop] of one partition."""

    def __init__(self, vb: int, start: int, stop: int):
        self.vb, self.start, self.stop = vb, start, stop


def rows_of(span: Span, keys: int) -> Iterator[pa.RecordBatch]:
    for low in range(span.start, span.stop, 10_000):
        n = list(range(low + 1, min(low + 10_000, span.stop) + 1))
        key = [f"k{span.vb}-{i % keys}" for i in n]
        yield pa.RecordBatch.from_pydict(
            {"vb": [span.vb] * len(n), "seqno": n, "cid": [8 + i % 4 for i in n], "key": key, "value": [f'{{"n":{i}}}' for i in n], "cas": [i << 16 for i in n], "rev": [1 + i // keys for i in n], "deleted": [i % 10 == 9 for i in n]}
        )


class _Load:
    def __init__(self, options: dict):
        self.rows, self.parts, self.keys = int(options.get("rows", 1000)), int(options.get("partitions", 4)), int(options.get("keys", 100))
        self.step = int(options.get("step", max(1, self.rows // 4)))

    def share(self, vb: int) -> int:
        """Rows of a partition: the rest of the division goes to the first ones."""
        return self.rows // self.parts + (vb < self.rows % self.parts)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return rows_of(partition, self.keys)


class LoadReader(_Load, DataSourceReader):
    def partitions(self) -> list[Span]:
        return [Span(vb, 0, self.share(vb)) for vb in range(self.parts)]


class LoadStream(_Load, DataSourceStreamReader):
    """Offsets are one high seqno per partition; a batch moves each on by at most `step`."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.high = 0

    def initialOffset(self) -> dict:
        return {str(vb): 0 for vb in range(self.parts)}

    def latestOffset(self) -> dict:
        self.high = min(self.high + self.step, self.share(0))
        return {str(vb): min(self.high, self.share(vb)) for vb in range(self.parts)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.high = max(self.high, *(int(x) for x in end.values()))
        return [Span(int(vb), int(start[vb]), int(end[vb])) for vb in end if int(end[vb]) > int(start[vb])]


class LoadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog_load"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LoadReader:
        return LoadReader(self.options)

    def streamReader(self, schema) -> LoadStream:
        return LoadStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LoadSource)
