"""Python over columns in pieces: what a worker holds as Python objects is bounded by bytes, not by rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a batch that become Python objects at once, if its rows are about alike; a row is never cut.
PIECE_BYTES = 1 << 20
KINDS = {"string": pa.string(), "array<string>": pa.list_(pa.string())}


def pieces(batch: pa.Array | pa.RecordBatch) -> Iterator[pa.Array | pa.RecordBatch]:
    """Slices of about PIECE_BYTES, a row at least; one empty slice of what is empty."""
    n = len(batch)
    step = max(1, n * PIECE_BYTES // max(PIECE_BYTES, batch.nbytes))
    for at in range(0, max(1, n), step):
        yield batch.slice(at, step)


def in_pieces(of: Callable, kind: str, *columns: Column) -> Column:
    """`of` of the values of every row, as a column of a kind of KINDS. A batch of long texts stays in Arrow; a piece of
    it at a time is made to objects and given back before the next."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.array([of(*row) for row in zip(*(c.to_pylist() for c in piece.flatten()))], KINDS[kind])

    return run(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]))
