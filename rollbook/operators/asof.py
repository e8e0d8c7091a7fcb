"""As-of carrying: the last row before each row, by range partitions.

Both sides are merged in the order of key and time and cut into range partitions, however uneven
the times are; rows of one time may be split as well. A task carries the last right-hand row along
its partition and leaves one summary row, the last it has seen. A row that met none in its own
partition takes the summary of the nearest partition before it. So each row meets one candidate at
most, and no key, day or moment has to fit in a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.session import materialize


def _key_starts(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """For each row, where the run of its key begins in the batch."""
    n = batch.num_rows
    changed = np.zeros(n, bool)
    for column in batch.columns[:keys]:
        differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), True)
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.maximum.accumulate(np.where(changed, np.arange(n), 0))


def _carrying(keys: int, right_kind: int):
    """Columns: the keys, time, kind, left struct, right struct; see `last_before` for what comes out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names: list[str] = []

        def out(rows: pa.RecordBatch, right: pa.Array, known: np.ndarray, end: bool) -> pa.RecordBatch:
            n = rows.num_rows
            return pa.RecordBatch.from_arrays(
                [*rows.columns[: keys + 1], rows.column(keys + 2), right, pa.array(np.full(n, part, np.int32)),
                 pa.array(known), pa.array(np.full(n, end))], names)

        last: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [*batch.schema.names[: keys + 1], "_left", "_right", "_part", "_known", "_end"]
            carried = 0 if last is None else 1
            rows = batch if last is None else pa.concat_batches([last, batch])
            is_right = rows.column(keys + 1).to_numpy() == right_kind
            at = np.maximum.accumulate(np.where(is_right, np.arange(len(is_right)), -1))
            known = at >= _key_starts(rows, keys)
            kept = ~is_right
            kept[:carried] = False
            if kept.any():
                mask = pa.array(kept)
                right = rows.column(keys + 3).take(pa.array(at, mask=~known))
                yield out(rows.filter(mask), right.filter(mask), known[kept], False)
            if at[-1] >= 0:
                last = rows.slice(int(at[-1]), 1)
        if last is not None:
            yield out(last, last.column(keys + 3), np.ones(1, bool), True)

    return run


def last_before(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), *, same: bool = False) -> DataFrame:
    """`left` with the other columns of the last row of `right` before it, of the same `by` columns.

    Before means an earlier `on`, or, with `same`, one that is not later. Without such a row the
    columns are NULL. Rows of `right` must not share `by` and `on`; neither may be NULL.
    """
    order = [*by, on]
    rest = [c for c in left.columns if c not in order]
    values = [c for c in right.columns if c not in order]
    left_kind, right_kind = (1, 0) if same else (0, 1)
    kept, taken = F.struct(F.lit(0).alias("_"), *rest), F.struct(*values)
    shape = T.StructType([T.StructField("_", T.IntegerType()), *[left.schema[c] for c in rest]])
    value_shape = T.StructType([T.StructField(v, right.schema[v].dataType) for v in values])
    merged = left.select(*order, F.lit(left_kind).alias("_kind"), kept.alias("_left"),
                         F.lit(None).cast(value_shape).alias("_right")).unionByName(
        right.select(*order, F.lit(right_kind).alias("_kind"), F.lit(None).cast(shape).alias("_left"),
                     taken.alias("_right")))
    out = T.StructType([
        *[left.schema[c] for c in order], T.StructField("_left", shape), T.StructField("_right", value_shape),
        T.StructField("_part", T.IntegerType()), T.StructField("_known", T.BooleanType()),
        T.StructField("_end", T.BooleanType())])
    placed = materialize(
        merged.repartitionByRange(*order, "_kind", F.xxhash64("_left")).sortWithinPartitions(*order, "_kind")
        .mapInArrow(_carrying(len(by), right_kind), out), "as-of")
    end = F.struct(*[F.col(c).alias(f"_{c}") for c in by], F.col("_right").alias("_values"))
    # One row for each partition.
    ends = placed.groupBy("_part").agg(F.first(F.when(F.col("_end"), end), ignorenulls=True).alias("_end_row")).select(
        F.col("_part"), F.last("_end_row", ignorenulls=True).over(
            Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    same_key = F.lit(True)
    for c in by:
        same_key = same_key & (F.col(f"_before._{c}") == F.col(c))
    found = F.when(F.col("_known"), F.col("_right")).when(same_key, F.col("_before._values"))
    return (
        placed.where(~F.col("_end")).join(F.broadcast(ends), "_part")
        .select(*order, "_left", found.alias("_found"))
        .select(*[F.col(c) if c in order else F.col(f"_left.{c}").alias(c) for c in left.columns],
                *[F.col(f"_found.{v}").alias(v) for v in values]))
