"""A folder of Parquet files, in the order of their names, as a stream with a bound of rows a batch."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of a batch and of a task.
BATCH_ROWS, TASK_ROWS = 100_000, 10_000


def _micros(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Times as Spark has them, whatever their unit in the file."""
    arrays = [x.cast(pa.timestamp("us", "UTC"), safe=False) if pa.types.is_timestamp(x.type) else x for x in batch.columns]
    return pa.RecordBatch.from_arrays(arrays, batch.schema.names)


class RowLog(DataSource):
    """Options: path (a folder that all executors share, by a URI), rows (of a batch), task_rows, and
    cursor, a folder of the query's own. The schema must be given.

    Rows are in the order of the files' names and of their places in the files; files that are added must
    have later names than those there are, and none may change. An offset is a number of rows.
    Where a batch ends is also noted in the cursor's folder: a source that starts again only needs
    it to bound its first batch, which the engine may have planned already; it loses or repeats no row without it.
    """

    @classmethod
    def name(cls) -> str:
        return "row_log"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return RowLogReader(self.options, schema)


class Rows(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class RowLogReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.folder, self.cursor, self.columns = options["path"].rstrip("/"), options["cursor"].rstrip("/"), schema.names
        self.batch, self.task = int(options.get("rows", BATCH_ROWS)), int(options.get("task_rows", TASK_ROWS))
        self.lengths: dict[str, int] = {}
        self.told: int | None = None

    def _files(self) -> list[tuple[str, int]]:
        """path and rows of the files; only new ones are opened, for their number of rows."""
        store, root = pafs.FileSystem.from_uri(self.folder)
        found = sorted(f.path for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.path.endswith(".parquet"))
        for path in found:
            if path not in self.lengths:
                with store.open_input_file(path) as file:
                    self.lengths[path] = pq.ParquetFile(file).metadata.num_rows
        return [(path, self.lengths[path]) for path in found]

    def _last(self) -> int:
        store, root = pafs.FileSystem.from_uri(self.cursor)
        if store.get_file_info(f"{root}/cursor.json").type == pafs.FileType.NotFound:
            return 0
        with store.open_input_stream(f"{root}/cursor.json") as file:
            return json.loads(file.read())["row"]

    def _note(self, row: int) -> None:
        store, root = pafs.FileSystem.from_uri(self.cursor)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/cursor.new") as file:
            file.write(json.dumps({"row": row}).encode())
        store.move(f"{root}/cursor.new", f"{root}/cursor.json")

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        if self.told is None:
            self.told = self._last()
        end = min(self.told + self.batch, sum(n for _, n in self._files()))
        if end != self.told:
            self._note(end)
            self.told = end
        return {"row": max(end, self.told)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out, at = [], 0
        for path, n in self._files():
            first, last = max(0, start["row"] - at), min(n, end["row"] - at)
            out += [Rows(path, row, min(self.task, last - row)) for row in range(first, last, self.task)]
            at += n
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.folder)
        with store.open_input_file(partition.path) as file:
            source, at, end = pq.ParquetFile(file), 0, partition.first + partition.count
            # Row groups that lie outside aren't read.
            for group in range(source.num_row_groups):
                n = source.metadata.row_group(group).num_rows
                if at < end and at + n > partition.first:
                    place = at
                    for batch in source.iter_batches(batch_size=self.task, row_groups=[group], columns=self.columns):
                        low, high = max(0, partition.first - place), min(batch.num_rows, end - place)
                        if low < high:
                            yield _micros(batch.slice(low, high - low))
                        place += batch.num_rows
                at += n


def read_log(spark: SparkSession, path: str, schema: str | StructType, cursor: str, rows: int = BATCH_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """A stream over a folder of Parquet files in batches of at most `rows`."""
    spark.dataSource.register(RowLog)
    return spark.readStream.format("row_log").schema(schema).options(path=path, cursor=cursor, rows=rows, task_rows=task_rows).load()
