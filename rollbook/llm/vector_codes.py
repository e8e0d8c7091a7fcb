"""Product codes of vectors, trained exactly in integers over Hilbert-sorted flat blocks.

Every component x becomes the integer floor(scale * x); a vector is cut into `parts` equal pieces,
and each part position has a codebook of its own. A codebook begins as that part of the vectors with
the smallest ids and is refined in rounds: every part goes to its nearest entry (squared Euclidean
distance, ties to the lower index), then each entry becomes the componentwise floor of the mean.

1. The pieces of each part position are sorted along a Hilbert curve by Spark and cut into flat
   blocks of up to `block` neighbours, which hold the pieces, their box (least and greatest value of
   each component) and their sum.
2. In a round each block compares its box with the codebook. An entry whose least distance to the
   box exceeds another entry's greatest distance is nearest to no piece; the others are the block's
   shortlist. A block with one entry on its list adds its stored sum, without looking at a piece.
3. Otherwise a small kernel finds each piece's nearest entry on the list, in exact integers.

What goes to the driver is a codebook's worth of sums a round, `entries` times the vector length. All
arithmetic is exact: 64-bit where the values allow it, else Python's integers.

Vectors that are null, empty or hold null or non-finite components are dropped, and so are vectors of
another than the most common length. Zero vectors stay. If the length is no multiple of `parts`, zeros
are added at its end. Integers beyond 31 bits (components of 524,288 and more at a scale of 4096) count
as the greatest 31-bit ones, and sums of distances beyond 63 bits as the greatest long. Every row counts:
repeated rows are coded each, and rows with a null id are coded but begin no codebook; of rows that share
an id the least vector begins one. With fewer vectors than entries, codebooks are that much shorter; an
empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.curves import hilbert
from rollbook.session import materialize

CURVE_DIMS, CURVE_BITS = 8, 7
MOST = (1 << 31) - 1
LONG = (1 << 63) - 1
SAFE = 1 << 30  # a squared distance below this times the length of a part fits in 64 bits
BLOCKS = "part int, n int, rows binary, values binary, low binary, high binary, total binary"


def curve_places(pieces: np.ndarray, spread: float) -> np.ndarray:
    """Place of each piece on a Hilbert curve; neighbouring components are added up to CURVE_DIMS."""
    cut = np.linspace(0, pieces.shape[1], min(CURVE_DIMS, pieces.shape[1]) + 1).astype(int)[:-1]
    y = np.add.reduceat(pieces.astype(np.float64), cut, axis=1) / max(spread, 1e-300)
    side = 1 << CURVE_BITS
    at = (1 / (1 + np.exp(-np.clip(1.7 * y, -40, 40))) * side).astype(np.int64)
    return hilbert(np.minimum(at, side - 1), CURVE_BITS)


def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as 64-bit integers, or as Python's where squares could go beyond 64 bits."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    fits = 4 * most * most * max(a.shape[-1] for a in arrays) < LONG
    return [a.astype(np.int64 if fits else object) for a in arrays]


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Indices of the entries that can be nearest to a point of the box, ascending."""
    low, high, book = _exact(low, high, book)
    out = np.maximum(low - book, 0) + np.maximum(book - high, 0)
    nearest = (out * out).sum(axis=1)
    out = np.maximum(abs(book - low), abs(high - book))
    return np.flatnonzero(nearest <= (out * out).sum(axis=1).min())


def assigned(values: np.ndarray, book: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each piece among the listed entries, ties to the lower index."""
    values, book = _exact(values, book[listed])
    gap = values[:, None, :] - book[None, :, :]
    far = (gap * gap).sum(axis=2)
    best = far.argmin(axis=1)
    return listed[best], far[np.arange(len(far)), best]


def _pieces(parts: int, width: int, spread: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            given = batch.column(1)
            flat = given.flatten().to_numpy().reshape(batch.num_rows, -1)
            whole = np.zeros((batch.num_rows, parts * width), np.int32)
            whole[:, : flat.shape[1]] = flat
            for p in range(parts):
                own = np.ascontiguousarray(whole[:, p * width : (p + 1) * width])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), p, np.int32)), pa.array(curve_places(own, spread)),
                     batch.column(0), pa.array([x.tobytes() for x in own], pa.binary())],
                    ["part", "place", "row", "values"])

    return run


def _blocked(width: int, block: int):
    def packed(part: int, rows: list[np.ndarray], values: list[bytes]) -> tuple:
        own = np.frombuffer(b"".join(values), np.int32).reshape(-1, width)
        return (part, len(own), np.concatenate(rows).tobytes(), own.tobytes(), own.min(axis=0).tobytes(),
                own.max(axis=0).tobytes(), own.sum(axis=0, dtype=np.int64).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, values = -1, [], []
        for batch in batches:
            parts, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            pieces, out = batch.column(2).to_pylist(), []
            i = 0
            while i < len(parts):
                if len(values) == block or (values and parts[i] != part):
                    out.append(packed(part, rows, values))
                    rows, values = [], []
                part = int(parts[i])
                j = min(int(np.searchsorted(parts, part, "right")), i + block - len(values))
                rows.append(own[i:j])
                values += pieces[i:j]
                i = j
            if out:
                yield _batch(out, BLOCKS)
        if values:
            yield _batch([packed(part, rows, values)], BLOCKS)

    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "decimal(38,0)": pa.decimal128(38)}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), _ARROW[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _read_blocks(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for part, n, rows, values, low, high, total in zip(*(c.to_pylist() for c in batch.columns)):
            whole = lambda b: np.frombuffer(b, np.int32)
            yield (part, n, np.frombuffer(rows, np.int64), whole(values).reshape(n, width), whole(low), whole(high),
                   np.frombuffer(total, np.int64))


def _sums(books: np.ndarray):
    """For each entry that got a piece of this task: how many, and the sum of each component."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(books.shape[:2], np.int64)
        total = np.zeros(books.shape, np.int64)
        for part, n, _, values, low, high, added in _read_blocks(batches, width):
            listed = shortlist(low, high, books[part])
            if len(listed) == 1:
                count[part, listed[0]] += n
                total[part, listed[0]] += added
            else:
                entry, _ = assigned(values, books[part], listed)
                np.add.at(count[part], entry, 1)
                np.add.at(total[part], entry, values)
        found = [(int(p), int(e), at, int(count[p, e]), int(total[p, e, at]))
                 for p, e in zip(*np.nonzero(count)) for at in range(width)]
        if found:
            yield _batch(found, "part int, entry int, at int, n long, total long")

    return run


def _codes(books: np.ndarray):
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n, rows, values, low, high, _ in _read_blocks(batches, width):
            entry, far = assigned(values, books[part], shortlist(low, high, books[part]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(rows), pa.array(entry.astype(np.int32)),
                 pa.array([min(int(x), LONG) for x in far], pa.int64())], ["part", "row", "entry", "far"])

    return run


def long_sum(column: str) -> Column:
    """Sum that stops at the greatest long."""
    return F.least(F.sum(F.col(column).cast("decimal(20,0)")), F.lit(LONG).cast("decimal(30,0)")).cast("long")


def _integers(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int) -> DataFrame:
    """(row, id, label, vec): the vectors that stay, in integers."""
    v = F.col("vec")
    most = F.lit(MOST).cast("long")
    whole = lambda x: F.greatest(F.least(F.floor(x * F.lit(float(scale))).cast("long"), most), -most)
    rows = (vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"),
                           F.col(vector_column).cast("array<double>").alias("vec"))
            .where(F.size(v) > 0)
            .where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))))
    limit = (MOST + 1) / scale
    inside = lambda x: F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))
    return materialize(
        rows.select(F.monotonically_increasing_id().alias("row"), "id", "label",
                    F.transform("vec", lambda x: whole(inside(x)).cast("int")).alias("vec")), "code-vectors")


def compressed(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
               label_column: str = "label", *, parts: int = 8, entries: int = 16, rounds: int = 6,
               scale: int = 4096, block: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes, error) for every vector that stays, and the codebooks.

    `codes` are the entries' indices in the order of the parts; `error` is the sum of the squared
    distances. The codebooks are an array by part, entry and place within the part.
    """
    spark = vectors.sparkSession
    rows = _integers(vectors, id_column, vector_column, label_column, scale)
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    length = common[0].d if common else 0
    rows = rows.where(F.size("vec") == length)
    width = -(-length // parts)

    firsts = [r.id for r in rows.where("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]
    seeds = {r.id: r.vec for r in rows.where(F.col("id").isin(firsts)).groupBy("id").agg(F.min("vec").alias("vec")).collect()} if firsts else {}
    books = np.zeros((parts, len(firsts), width), np.int64)
    for e, i in enumerate(firsts):
        padded = np.zeros(parts * width, np.int64)
        padded[:length] = seeds[i]
        books[:, e] = padded.reshape(parts, width)
    if not firsts:
        return spark.createDataFrame([], f"{id_column} long, codes array<int>, error long").join(
            rows.select("label").limit(0), F.lit(True)).select(id_column, "label", "codes", "error"), books

    squares = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    spread = float((rows.agg(F.avg(squares)).first()[0] / length) ** 0.5)
    ordered = (rows.select("row", "vec").mapInArrow(_pieces(parts, width, spread), "part int, place long, row long, values binary")
               .repartitionByRange("part", "place", "row").sortWithinPartitions("part", "place", "row")
               .select("part", "row", "values"))
    blocks = materialize(ordered.mapInArrow(_blocked(width, block), BLOCKS), "code-blocks")
    for _ in range(rounds):
        sums = (blocks.mapInArrow(_sums(books), "part int, entry int, at int, n long, total long")
                .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
        books = books.copy()
        for r in sums.collect():  # parts * entries * width rows at most
            books[r.part, r.entry, r.at] = r.total // r.n

    coded = blocks.mapInArrow(_codes(books), "part int, row long, entry int, far long").groupBy("row").agg(
        *[F.max(F.when(F.col("part") == p, F.col("entry"))).alias(f"e{p}") for p in range(parts)],
        long_sum("far").alias("error"))
    return rows.select("row", "id", "label").join(coded, "row").select(
        F.col("id").alias(id_column), "label",
        F.array(*[f"e{p}" for p in range(parts)]).alias("codes"), "error"), books


def books_sha256(books: np.ndarray) -> str:
    """Digest of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def decoded(codes: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """`codes` with `decoded`: the vector that the entries stand for (zeros of the padding included)."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in book]) for book in books])
    return codes.withColumn("decoded", F.flatten(F.transform("codes", lambda c, p: table[p][c])))
