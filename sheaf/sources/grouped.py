"""Groups of a sorted table, many at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that a task takes up before it works on the whole groups among them.
ROWS = 1 << 16


def changes(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a group starts; nulls are a key like others."""
    codes = [pc.dictionary_encode(table.column(c), null_encoding="encode").indices.to_numpy() for c in keys]
    return np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups with the places where they start, for rows sorted by the keys. A call holds about `rows`
    rows, or a group that has more."""
    held, n, enough = [], 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        every = pa.Table.from_batches(held).combine_chunks().to_batches()
        if len(every) > 1:  # more text than one batch can hold
            raise ValueError(f"a group of {keys} has over 2 GB of text")
        starts = changes(every[0], keys)
        if len(starts) > 1:
            yield every[0].slice(0, starts[-1]), starts[:-1]
        held, n = [every[0].slice(starts[-1])], n - int(starts[-1])
        enough = max(rows, 2 * n)
    if n:
        every = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield every, changes(every, keys)
