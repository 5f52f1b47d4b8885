"""Groups of rows in a sorted stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_cell(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds of its groups) where no group is cut; rows must arrive sorted by the column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column)
        last = keys[-1].as_py()
        if held and held[-1].column(column)[-1].as_py() == last:
            held.append(batch)
            continue
        values = keys.to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(values != last)[-1]) + 1 if (values != last).any() else 0
        if held or cut:
            yield _bounded(pa.Table.from_batches([*held, batch.slice(0, cut)]), column)
        held = [batch.slice(cut)]
    if held:
        yield _bounded(pa.Table.from_batches(held), column)


def _bounded(table: pa.Table, column: str) -> tuple[pa.Table, np.ndarray]:
    keys = table.column(column).to_numpy()
    return table, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def emit(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n items by the links (u, v)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


