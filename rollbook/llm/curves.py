"""Nearest neighbours by inner product along shifted space-filling curves, then made exact.

1. Each vector's direction is projected at random to DIMS coordinates, once for each curve and with
   a shift of its own; its cell's place on a Hilbert curve is its key. Spark range-partitions and
   sorts by (curve, key, id), so equal keys are split too, and ranks follow from running counts and
   the sums of the partitions before.
2. A query meets the rows within `window` ranks on every curve. The union of these windows is
   reranked on the original vectors; the score of its k-th row is a floor for the query.
3. The floor makes the search exact. The first curve's blocks of `block` neighbours are summed up
   as centre and radius, and so are groups of queries. A block is visited by a group only if the
   bound on inner products between the two reaches the lowest floor of the group. Where nearness is
   local this leaves few blocks; where vectors are spread evenly the query set meets all rows, in
   blocks. No task holds more than one group and one stretch of `span` neighbouring blocks, and it
   ranks within these before anything is merged.

Scores are sums of products in double precision, in the order of the components, so equal vectors
have equal scores; ties go to the smaller id. Rows with a null id and vectors that are null, empty,
zero, of another than the most common length, or that hold null or non-finite components take no
part. Rows that share an id count as one, with the least of their vectors. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.session import materialize

DIMS, BITS = 6, 8
FOUND = "query_id long, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (rows) on a Hilbert curve through a cube of 2 ** bits cells a side."""
    x = cells.astype(np.int64).T.copy()
    top = np.int64(1) << (bits - 1)
    q = top
    while q > 1:  # undo the turns of each level
        for i in range(len(x)):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(turned, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Keys of the vectors on one of the curves."""
    rng = np.random.default_rng(1000 + curve)
    d = vectors.shape[1]
    axes = rng.normal(size=(d, DIMS))
    shift = rng.random(DIMS) - 0.5
    y = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ axes
    place = 1 / (1 + np.exp(-1.7 * (y + shift)))  # near uniform for a normal distribution
    return hilbert(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component by component."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _best(query_ids, ids, a, b, k: int) -> pd.DataFrame:
    """The k best of each query among pairs of rows."""
    score = _scores(a, b)
    order = np.lexsort((ids, -score, query_ids))
    q = query_ids[order]
    begin = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.repeat(np.flatnonzero(begin), np.diff(np.append(np.flatnonzero(begin), len(q))))
    kept = order[place < k]
    return pd.DataFrame({"query_id": query_ids[kept], "vec_id": ids[kept], "score": score[kept]})


def _usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec): the rows that take part."""
    v = F.col("vec")
    rows = (vectors.select(F.col(id_column).cast("long").alias("id"),
                           F.col(vector_column).cast("array<double>").alias("vec"))
            .where(F.col("id").isNotNull() & (F.size(v) > 0))
            .where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            .where(F.exists(v, lambda x: x != 0)))
    rows = materialize(rows.groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vec") == (common[0].d if common else 0))


def _ranked(rows: DataFrame, curves: int) -> DataFrame:
    """(curve, rank, id, vec): every row on every curve."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(1).to_numpy(zero_copy_only=False))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(vectors), c, np.int32)), pa.array(curve_keys(vectors, c)),
                         batch.column(0), batch.column(1)], ["curve", "key", "id", "vec"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(curves, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            curve = batch.column(0).to_numpy()
            place = np.zeros(len(curve), np.int64)
            for c in range(curves):
                own = curve == c
                place[own] = seen[c] + np.arange(own.sum())
                seen[c] += own.sum()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(curve), part, np.int32)), pa.array(place),
                 batch.column(1), batch.column(2)], ["curve", "part", "place", "id", "vec"])

    ordered = (rows.mapInArrow(keyed, "curve int, key long, id long, vec array<double>")
               .repartitionByRange("curve", "key", "id").sortWithinPartitions("curve", "key", "id")
               .select("curve", "id", "vec")
               .mapInArrow(counted, "curve int, part int, place long, id long, vec array<double>"))
    placed = materialize(ordered, "curve-order")
    counts = materialize(placed.groupBy("curve", "part").agg(F.count("*").alias("n")), "curve-counts")
    before = counts.select("curve", "part", (F.sum("n").over(
        Window.partitionBy("curve").orderBy("part")) - F.col("n")).alias("before"))
    return materialize(placed.join(before, ["curve", "part"]).select(
        "curve", (F.col("place") + F.col("before")).alias("rank"), "id", "vec"), "curve-ranks")


def _top(found: DataFrame, k: int) -> DataFrame:
    """`found` without repeats, the k best of each query, with `rank`."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _windows(ranked: DataFrame, queries: DataFrame, k: int, window: int, block: int) -> DataFrame:
    """The k best rows in each query's windows, curve by curve."""
    reach = F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / block),
                       F.floor((F.col("rank") + window) / block))

    def meet(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or there.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        gap = np.abs(asked["rank"].to_numpy()[:, None] - there["rank"].to_numpy()[None, :])
        own = asked["id"].to_numpy()[:, None] == there["id"].to_numpy()[None, :]
        i, j = np.nonzero((gap <= window) & ~own)
        return _best(asked["id"].to_numpy()[i], there["id"].to_numpy()[j],
                     _matrix(asked["vec"])[i], _matrix(there["vec"])[j], k)

    asked = queries.withColumn("block", F.explode(reach)).groupBy("curve", "block")
    there = ranked.withColumn("block", F.floor(F.col("rank") / block)).groupBy("curve", "block")
    return asked.cogroup(there).applyInPandas(meet, FOUND)


def _ball(grouped, key: str, extra: bool) -> DataFrame:
    """Centre, radius and, for queries, the lowest floor of each group."""
    def around(rows: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(rows["vec"])
        centre = v.mean(axis=0)
        out = {key: [rows[key].iloc[0]], "centre": [centre], "radius": [np.linalg.norm(v - centre, axis=1).max()]}
        return pd.DataFrame(out | ({"lowest": [rows["floor"].min()]} if extra else {}))

    return grouped.applyInPandas(around, f"{key} long, centre array<double>, radius double" + ", lowest double" * extra)


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], id_column: str = "vec_id",
            vector_column: str = "embedding", *, k: int = 20, curves: int = 4, window: int = 64,
            block: int = 1024, group: int = 16, span: int = 64, exact: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product for each query.

    A task of the exact search holds up to `group` blocks' queries and `span` blocks of rows, and
    returns k rows for each query, so what is merged does not grow with every block visited.
    `is_query` tells the queries by their id. Without `exact`, only the windows' rows are ranked.
    """
    ranked = _ranked(_usable(vectors, id_column, vector_column), curves)
    queries = ranked.where(is_query(F.col("id")))
    near = materialize(_top(_windows(ranked, queries, k, window, block), k), "curve-near")
    columns = ["query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"]
    if not exact:
        return near.select(*columns)
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    blocks = ranked.where("curve = 0").select(
        F.floor(F.col("rank") / block).alias("block"), F.col("id"), F.col("vec"))
    asked = materialize(
        queries.where("curve = 0").join(floors, "id", "left")
        .select(F.floor(F.col("rank") / (block * group)).alias("asking"), "id", "vec",
                F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), "curve-queries")
    block_balls = _ball(blocks.groupBy("block"), "block", False)
    asking_balls = _ball(asked.groupBy("asking"), "asking", True)
    last = asked.agg(F.max("asking").alias("last")).first().last
    dot = F.aggregate(F.zip_with("c", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    bound = dot + norm("c") * F.col("radius") + norm("centre") * F.col("r") + F.col("radius") * F.col("r")
    pairs = materialize(
        block_balls.select("block", F.col("centre").alias("c"), F.col("radius").alias("r"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))).alias("asking"))
        .join(asking_balls, "asking")
        .where(bound * (1 + 1e-9) + 1e-9 >= F.col("lowest")).select("asking", "block"), "curve-pairs")

    def visit(own: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if own.empty or there.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b = _matrix(own["vec"]), _matrix(there["vec"])
        floor = own["floor"].to_numpy()
        slack = 1e-9 * (1 + np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max())
        q, r = own["id"].to_numpy(), there["id"].to_numpy()
        out = []
        for i in range(0, len(a), 64):
            near = (a[i : i + 64] @ b.T >= (floor - slack)[i : i + 64, None]) & (q[i : i + 64, None] != r[None, :])
            x, y = np.nonzero(near)
            out.append(_best(q[i + x], r[y], a[i + x], b[y], k))
        return pd.concat(out)

    stretch = F.floor(F.col("block") / span).alias("stretch")
    there = blocks.join(pairs, "block").select("asking", stretch, "id", "vec")
    met = (asked.join(pairs.select("asking", stretch).distinct(), "asking").groupBy("asking", "stretch")
           .cogroup(there.groupBy("asking", "stretch")).applyInPandas(visit, FOUND))
    return _top(near.select("query_id", "vec_id", "score").union(met), k).select(*columns)
