"""Python passes over long values, with little held at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Characters or bytes read, and rows, that one array of results stands for.
SLICE_SIZE, SLICE_ROWS = 1 << 20, 1024


def in_slices(read: Callable[..., object], kind: pa.DataType, *columns: pa.Array) -> Iterator[pa.Array]:
    """Results of ``read`` for the rows of a batch, in arrays of few rows.

    Only the batch itself is held whole: its values and their results become Python objects
    slice by slice. An iterator of Arrow batches may give back arrays of other lengths.
    """
    found: list[object] = []
    size = 0
    for place in range(len(columns[0])):
        values = [column[place].as_py() for column in columns]
        found.append(read(*values))
        size += sum(len(value) for value in values if value is not None)
        if size >= SLICE_SIZE or len(found) >= SLICE_ROWS:
            yield pa.array(found, kind)
            found, size = [], 0
    yield pa.array(found, kind)
