"""Near duplicates: a multi-index Hamming join of b-bit MinHash signatures.

A document's signature is `chunks * rows` symbols of SYMBOL_BITS bits, each from one MinHash
function. Two signatures at a distance of at most `chunks * (errors + 1) - 1` symbols differ, in
at least one chunk, in at most `errors` symbols (pigeonhole). So each chunk is indexed once for
every choice of `errors` symbols left out: pairs within the distance are sure to share a key.
At a similarity of 0.8 a pair shares none with a probability of 2e-6 for the default parameters.

Candidates are confirmed on the full shingle sets. A bucket is not expanded into all its pairs:

1. documents with equal sets are one node;
2. in each bucket every node is compared with the first one (a star), and the links found give
   components;
3. buckets that still hold several components get more stars, in each of `stars` rounds around another
   node of the bucket, for the nodes that are not in that node's component yet. In a group of near
   copies, where most pairs are linked, a few stars leave one component;
4. in buckets that hold several components even then, signatures are compared across components, in
   blocks of up to `block` nodes: pairs within the signature distance, each in the first bucket that it
   shares. That is the join's guarantee: no pair within the distance is missed. Of these, a pair comes
   out only if its shingles can be common enough: counts of shingles by SKETCH hash cells, the smaller
   of both added up, bound the intersection from above.

Hot keys (a group of copies) appear in joins only, which Spark splits, and in aggregates, which
combine before the shuffle.

Nulls, empty texts and texts without a word have no shingles and are linked with nothing. Rows
with a null id are returned, linked with nothing, and kept. Repeated rows are returned as often as
they came, with the same result; rows that share an id and have different texts are documents each,
and the id is the component's if any of them reaches it. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm import texts
from rollbook.llm.batches import borders, whole_runs
from rollbook.session import materialize

SYMBOL_BITS = 16
SKETCH = 1024  # cells, a byte each; 255 stands for any number from there on
_BATCH = 4096


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z taken as a-z."""
    for _, _, data, offsets in texts.slices(column):
        data = texts.LOWER[data]
        starts, ends, first = texts.words(data, offsets)
        hashes = texts.span_hashes(data, starts, ends)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(texts.shingle_hashes(hashes[a:b], words))


def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    draw = rng.integers(1, 1 << 63, (2, k), np.uint64)
    return draw[0], draw[1] * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """k symbols: SYMBOL_BITS bits of the least value of each hash function over the set."""
    add, times = _functions(k)
    least = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _BATCH):
        part = (shingles[i : i + _BATCH, None] ^ add) * times
        np.minimum(least, part.min(axis=0), out=least)
    return (texts.mix(least) & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.uint16)


def _signatures(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, marks = [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                a, b = _set_hashes(s)
                one.append(a)
                two.append(b)
                marks.append(signature(s, k).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), pa.array(marks, pa.binary())],
                ["id", "n", "set_a", "set_b", "signature"])

    return run


def index_keys(signatures: np.ndarray, chunks: int, rows: int, errors: int) -> np.ndarray:
    """One row of keys for each signature: every chunk with every choice of symbols left out."""
    parts = signatures.reshape(len(signatures), chunks, rows).astype(np.uint64)
    keys = []
    for j, kept in enumerate(combinations(range(rows), rows - errors)):
        key = np.arange(chunks, dtype=np.uint64)[None, :] + np.uint64(1000 * (j + 1))
        key = np.broadcast_to(texts.mix(key), parts.shape[:2])
        for r in kept:
            key = texts.mix(key + parts[:, :, r])
        keys.append(key)
    return np.concatenate(keys, axis=1)


def _keyed(chunks: int, rows: int, errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            marks = batch.column(1).to_pylist()
            for i in range(0, len(nodes), 2000):
                got = np.frombuffer(b"".join(marks[i : i + 2000]), np.uint16).reshape(-1, chunks * rows)
                keys = index_keys(got, chunks, rows, errors)
                places = np.broadcast_to(np.arange(keys.shape[1], dtype=np.int32), keys.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64).ravel()), pa.array(places.ravel()),
                     pa.array(np.repeat(nodes[i : i + 2000], keys.shape[1]))], ["key", "place", "node"])

    return run


def _set_hashes(s: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits that tell a set from others."""
    if not len(s):
        return None, None
    return int(texts.mix(s).sum().view(np.int64)), int(np.bitwise_xor.reduce(texts.mix(s + np.uint64(1))).view(np.int64))


def _sketch(s: np.ndarray) -> bytes:
    cells = np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.minimum(cells, 255).astype(np.uint8).tobytes()


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            group: list[np.ndarray] = []
            begun = 0
            for i, s in enumerate(shingle_sets(batch.column(1), words), 1):
                group.append(s)
                if i == len(ids) or sum(map(len, group[-50:])) > 1_000_000 or len(group) == 500:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in group])]).astype(np.int32)
                    one, two = zip(*map(_set_hashes, group))
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(begun, len(group)), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(group).view(np.int64))),
                         pa.array([_sketch(s) for s in group], pa.binary())],
                        ["id", "set_a", "set_b", "shingles", "sketch"])
                    begun, group = i, []

    return run


def _compared(chunks: int, rows: int, errors: int, percent: int):
    """Pairs (a, b) of one bucket, or of two blocks of it, within the signature distance.

    Rows are (key, one, two, part, place, node, component, signature, n, sketch): block `part` of the
    pair of blocks `one` and `two`. Nodes of one component are not compared, and a pair comes out of
    the first of the buckets it shares, if its sketches allow the similarity.
    """
    limit = chunks * (errors + 1) - 1
    kept = np.array(list(combinations(range(rows), rows - errors)))

    def first_place(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        same = (x == y).reshape(len(x), chunks, rows)
        shared = np.stack([same[:, :, k].all(axis=2) for k in kept], axis=1)
        return shared.reshape(len(x), len(kept) * chunks).argmax(axis=1)

    def possible(n_x: np.ndarray, n_y: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        least = np.minimum(x, y)
        most = least.sum(axis=1, dtype=np.int64)
        most = np.where((least == 255).any(axis=1), np.minimum(n_x, n_y), most)
        return 100 * most >= percent * (n_x + n_y - most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, 3):
            cut = borders(batch, 3)
            one, two, part, place = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
            node, component = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            marks = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint16).reshape(len(node), -1)
            n = batch.column(8).to_numpy().astype(np.int64)
            cells = np.frombuffer(b"".join(batch.column(9).to_pylist()), np.uint8).reshape(len(node), SKETCH)
            found_a, found_b = [], []
            for lo, hi in zip(cut[:-1], cut[1:]):
                left = lo + np.flatnonzero(part[lo:hi] == one[lo])
                right = lo + np.flatnonzero(part[lo:hi] == two[lo])
                for i in range(0, len(left), 64):
                    rows_ = left[i : i + 64]
                    other = component[rows_][:, None] != component[right][None, :]
                    if one[lo] == two[lo]:
                        other &= node[rows_][:, None] < node[right][None, :]
                    x, y = np.nonzero(other)
                    for j in range(0, len(x), 1 << 16):
                        p, q = rows_[x[j : j + (1 << 16)]], right[y[j : j + (1 << 16)]]
                        near = (marks[p] != marks[q]).sum(axis=1) <= limit
                        p, q = p[near], q[near]
                        own = first_place(marks[p], marks[q]) == place[lo]
                        p, q = p[own], q[own]
                        for k in range(0, len(p), 4096):
                            u, v = p[k : k + 4096], q[k : k + 4096]
                            kept_ = possible(n[u], n[v], cells[u], cells[v])
                            found_a.append(node[u[kept_]])
                            found_b.append(node[v[kept_]])
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    union = F.size("of_a") + F.size("of_b") - common
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * common >= F.lit(percent) * union).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b): the smallest id reachable.

    Labels sink to the smallest neighbour's and are then followed once more (pointer jumping),
    until nothing changes. Each round is written to the shared folder.
    """
    both = materialize(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(), "near-links")
    label = materialize(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
        .select("id", F.least("id", "m").alias("component")), "near-labels")
    while True:
        near = (both.join(label.select(F.col("id").alias("b"), F.col("component").alias("seen")), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("seen")))
        sunk = label.join(near, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        jump = label.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = materialize(
            sunk.join(jump, "component", "left")
            .select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")),
            "near-labels")
        label = new.select("id", "component")
        if new.where("old <> component").limit(1).count() == 0:
            return label


def _open(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(key, place, node, component) of the buckets that hold several components."""
    named = (buckets.join(found.withColumnRenamed("id", "node"), "node", "left")
             .select("key", "place", "node", F.coalesce("component", "node").alias("component")))
    mixed = (named.groupBy("key").agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high").select("key", "size"))
    return materialize(named.join(mixed, "key"), "near-open")


def _star(open_: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's node of this turn and those of other components."""
    pivots = open_.groupBy("key").agg(
        F.min(F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("b"), F.col("component").alias("of_b"))).alias("p"))
    return (open_.join(pivots.select("key", "p.b", "p.of_b"), "key").where("component <> of_b")
            .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct())


def _near_pairs(open_: DataFrame, marks: DataFrame, chunks: int, rows: int, errors: int, percent: int,
                block: int) -> DataFrame:
    """Pairs across components within the signature distance; a large bucket is met block by block."""
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = open_.join(marks, "node").withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return (
        met.select("key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"),
                   "part", "place", "node", "component", "signature", "n", "sketch")
        .repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
        .mapInArrow(_compared(chunks, rows, errors, percent), "a long, b long"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                    words: int = 5, percent: int = 80, chunks: int = 10, rows: int = 5,
                    errors: int = 1, stars: int = 2, block: int = 2048) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of `docs`.

    Documents are linked if 100 * intersection >= percent * union holds for their sets of shingles
    of `words` words (a shorter text is one shingle). `component_id` is the smallest id that links
    lead to, itself included; `kept` marks the row that stays.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed = materialize(source.mapInArrow(
        _signatures(words, chunks * rows),
        "id long, n long, set_a long, set_b long, signature binary"), "near-signatures")
    full = signed.where("n > 0 and id is not null")
    same = ["set_a", "set_b", "n"]
    nodes = materialize(
        full.groupBy(*same).agg(F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    marks = materialize(
        full.join(nodes.withColumnRenamed("first", "id"), [*same, "id"]).select("node", "signature").dropDuplicates(["node"]),
        "near-marks")
    keys = marks.mapInArrow(_keyed(chunks, rows, errors), "key long, place int, node long")
    shared = (keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
              .where("pivot < last").select("key", "pivot"))
    buckets = materialize(keys.join(shared, "key"), "near-buckets")
    members = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select(
        "node", "set_a", "set_b", F.col("first").alias("id"))
    sets = materialize(
        source.join(members, "id", "left_semi")
        .mapInArrow(_sets(words), "id long, set_a long, set_b long, shingles array<long>, sketch binary")
        .join(members, ["id", "set_a", "set_b"]).select("node", "shingles", F.size("shingles").alias("n"), "sketch")
        .dropDuplicates(["node"]), "near-sets")

    first = buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(confirmed(first, sets, percent), "near-confirmed")
    found = components(links)
    open_ = _open(buckets, found)
    for turn in range(stars):
        links = links.union(materialize(confirmed(_star(open_, turn), sets, percent), "near-confirmed"))
        found = components(links)
        open_ = _open(open_.select("key", "place", "node"), found)
    marked = marks.join(sets.select("node", "n", "sketch"), "node")
    more = confirmed(_near_pairs(open_, marked, chunks, rows, errors, percent, block), sets, percent)
    found = components(links.union(more))

    named = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").select(
        *same, "first", F.coalesce("component", "node").alias("component"))
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    out = signed.join(named.join(lowest, "component").select("set_a", "set_b", "lowest"), ["set_a", "set_b"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("lowest", "id"))
    return out.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
