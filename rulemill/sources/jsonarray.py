"""One JSON array in one file, written by all tasks and published whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes that are copied at once when the parts are joined.
COPY = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int


class JsonArray(DataSource):
    """Options: path, the URI of the file in a folder that all executors share. Rows have one column, a JSON text each."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return JsonArrayWriter(self.options["path"])


class JsonArrayWriter(DataSourceWriter):
    """Each task streams its rows to a file of its own attempt; the driver then copies the parts of those that
    ended well into one file, a piece at a time, and gives it its name."""

    def __init__(self, path: str):
        self.path = path
        self.aside = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        store, root = pafs.FileSystem.from_uri(self.aside)
        store.create_dir(root, recursive=True)
        number, rows = TaskContext.get().partitionId(), 0
        path = f"{root}/{number:06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(path) as out:
            for row in iterator:
                out.write((",\n" if rows else "").encode() + row[0].encode())
                rows += 1
        return Part(number, path, rows)

    def commit(self, messages: list[Part]) -> None:
        store, root = pafs.FileSystem.from_uri(self.aside)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/whole") as out:
            out.write(b"[")
            first = True
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number):
                out.write(b"" if first else b",\n")
                first = False
                with store.open_input_stream(part.path) as source:
                    while piece := source.read(COPY):
                        out.write(piece)
            out.write(b"]")
        target = pafs.FileSystem.from_uri(self.path)[1]
        store.move(f"{root}/whole", target)
        store.delete_dir(root)

    def abort(self, messages: list[Part]) -> None:
        store, root = pafs.FileSystem.from_uri(self.aside)
        if store.get_file_info(root).type != pafs.FileType.NotFound:
            store.delete_dir(root)
