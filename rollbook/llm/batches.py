"""Record batches of sorted partitions, cut where a key changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def borders(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where runs of equal values in the first `keys` columns begin, and the end of the batch."""
    if not batch.num_rows:
        return np.zeros(1, np.int64)
    begin = np.ones(batch.num_rows, bool)
    begin[1:] = False
    for c in batch.columns[:keys]:
        own = c.to_numpy(zero_copy_only=False)
        begin[1:] |= own[1:] != own[:-1]
    return np.append(np.flatnonzero(begin), batch.num_rows)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that no run of equal keys crosses; a run is held in memory whole."""
    waiting: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, at: int) -> list:
        return [c[at].as_py() for c in batch.columns[:keys]]

    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting and key(waiting[-1], waiting[-1].num_rows - 1) != key(batch, 0):
            yield pa.concat_batches(waiting)
            waiting = []
        last = int(borders(batch, keys)[-2])
        if last:
            yield pa.concat_batches([*waiting, batch.slice(0, last)])
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield pa.concat_batches(waiting)


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of numbers held as bytes; shorter ones end in zeros."""
    rows = [np.frombuffer(b, kind) for b in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out
