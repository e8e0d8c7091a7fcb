"""Near-duplicate vectors within a label: a neighbour graph by NN-descent, audited, then exact counts.

1. Copies (equal vectors of one label) are one node. The graph begins with `trees` random orderings:
   signs of random projections, in lexicographic order, cut into leaves of `leaf` nodes, in which each
   node takes its nearest half list.
2. A round of descent joins neighbours of neighbours: at every node whose list has changed, all its
   neighbours, forward and (the nearest of them) reverse, are compared with each other, and a pair that
   is better than the end of a list enters it. Rounds go on while they find links, at most `rounds`.
3. Links are the edges whose cosine, now in double precision, reaches the threshold. A list that links
   fill up is saturated: more may be linked than it holds. Lists are then enlarged to all that links
   lead to, the component, and the members' links are counted exactly, in blocks: a pair of blocks is
   settled by centres and radii where these prove all or none of its pairs linked, else compared. No
   pair is written, so a large group of near copies costs counts.
4. An audit compares `audit` nodes with every node of their label. Links to other components that it
   finds are added; while it finds less than `recall` of all links settled, the graph gets as many new
   orderings, lists of twice the length, and more rounds (`attempts` in all). The audit's figures are returned.

A component's blocks hold `block` nodes, or the square root of its size if that is more, so pairs of
blocks grow as the component does.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do
rows with a null label or a null id. Vectors of different length are never linked. Repeated rows (id, label
and vector alike) are one vector and get the same result; rows that share an id and differ are vectors each.
Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.batches import borders, matrix, whole_runs
from rollbook.llm.near_dup import components
from rollbook.session import materialize

BITS = 62
NEAR = 1e-4  # what 32-bit similarities may be off
ANGLE = 1e-7  # what angles may be off
EDGES = "node long, other long, near float"


@dataclass(frozen=True)
class Audit:
    """Links of the audited nodes, and those of them that stayed within components found before."""

    nodes: int
    links: int
    found: int

    @property
    def recall(self) -> float:
        return self.found / self.links if self.links else 1.0


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors (the last column) at length 1, as bytes of doubles."""
    for batch in batches:
        out = []
        for v in batch.columns[-1].to_pylist():
            v = np.array(v)
            v /= np.abs(v).max()
            out.append((v / np.sqrt((v * v).sum())).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "unit"])


def _codes(units: np.ndarray, tree: int) -> np.ndarray:
    axes = np.random.default_rng(9000 + tree).normal(size=(units.shape[1], BITS))
    code = np.zeros(len(units), np.int64)
    for bit in (units @ axes > 0).T:
        code = (code << 1) | bit
    return code


def _ordered(first: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                units = matrix(batch.column(2), np.float64)
                near = pa.array([np.frombuffer(b).astype(np.float32).tobytes() for b in batch.column(2).to_pylist()], pa.binary())
                for t in range(first, first + trees):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(units), t, np.int32)), batch.column(1), pa.array(_codes(units, t)),
                         batch.column(0), near], ["tree", "kind", "code", "node", "near"])

    return run


def _edges(node: np.ndarray, other: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(near, pa.float32())], ["node", "other", "near"])


def _leaves(leaf: int, take: int):
    """Each node's nearest in its leaf: a run of up to `leaf` rows of one ordering and kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = borders(batch, 2)
            out = []
            for a, b in zip(cut[:-1], cut[1:]):
                for i in range(a, b, leaf):
                    rows = batch.slice(i, min(leaf, b - i))
                    if rows.num_rows > 1:
                        node, units = rows.column(2).to_numpy(), matrix(rows.column(3), np.float32)
                        near = units @ units.T
                        np.fill_diagonal(near, -2)
                        best = np.argsort(-near, axis=1, kind="stable")[:, : min(take, len(node) - 1)]
                        out.append((np.repeat(node, best.shape[1]), node[best].ravel(), np.take_along_axis(near, best, 1).ravel()))
            if out:
                yield _edges(*(np.concatenate(x) for x in zip(*out)))

    return run


def _joined(take: int, widest: int):
    """Pairs of each node's neighbours that are better than the end of a list, the `take` best for each.

    Rows are (at, node, floor, near): a neighbour `node` of `at` with its bytes and its list's end.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, 1):
            cut = borders(batch, 1)
            node, floor, units = batch.column(1).to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3), np.float32)
            size = np.diff(cut)
            for g in range(0, len(size), 256):
                own = size[g : g + 256]
                wide = min(int(own.max()), widest)
                place = cut[g : g + 256][: len(own), None] + np.arange(wide)[None, :]
                there = np.arange(wide)[None, :] < own[:, None]
                place = np.where(there, place, 0)
                u = np.where(there[:, :, None], units[place], 0)
                near = u @ u.transpose(0, 2, 1)
                near[~(there[:, :, None] & there[:, None, :])] = -2
                near[:, np.arange(wide), np.arange(wide)] = -2
                best = np.argsort(-near, axis=2, kind="stable")[:, :, :take]
                value = np.take_along_axis(near, best, 2)
                x, i, j = np.nonzero((value > floor[place][:, :, None]) & (value > -2))
                if len(x):
                    yield _edges(node[place[x, i]], node[place[x, best[x, i, j]]], value[x, i, j])

    return run


def _lists(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("node").orderBy(F.desc("near"), "other")
    return edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _descended(nodes: DataFrame, graph: DataFrame, k: int, rounds: int, threshold: float) -> DataFrame:
    """The graph (node, other, near) after rounds of joins among neighbours."""
    bytes32 = nodes.select("node", F.col("near32").alias("near"))
    graph = graph.withColumn("fresh", F.lit(True))
    for _ in range(rounds):
        floors = graph.groupBy("node").agg(
            F.when(F.count("*") >= k, F.min("near")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
        back = Window.partitionBy("other").orderBy(F.desc("near"), "node")
        reverse = graph.withColumn("place", F.row_number().over(back)).where(F.col("place") <= k)
        active = graph.where("fresh").select(F.col("node").alias("at")).distinct()
        members = (graph.select(F.col("node").alias("at"), F.col("other").alias("node"))
                   .union(reverse.select(F.col("other").alias("at"), "node")).distinct()
                   .join(active, "at", "left_semi"))
        groups = (members.join(bytes32, "node").join(floors, "node", "left")
                  .select("at", "node", F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"), "near")
                  .repartition("at").sortWithinPartitions("at", "node"))
        found = groups.mapInArrow(_joined(max(2, k // 2), 2 * k), EDGES)
        both = (graph.select("node", "other", "near", F.lit(0).alias("new"))
                .union(found.select("node", "other", "near", F.lit(1).alias("new")))
                .groupBy("node", "other").agg(F.max("near").alias("near"), F.min("new").alias("new")))
        graph = materialize(
            _lists(both, k).select("node", "other", "near", (F.col("new") == 1).alias("fresh")), "graph")
        linked = F.col("near") >= threshold - NEAR
        gained = graph.agg(F.count(F.when(linked, 1)).alias("all"), F.count(F.when(linked & F.col("fresh"), 1)).alias("new")).first()
        if gained.new * 1000 <= gained.all:
            break
    return graph


def _confirmed(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = matrix(batch.column(2), np.float64), matrix(batch.column(3), np.float64)
            kept = pa.array((a * b).sum(axis=1) >= threshold) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select([0, 1]).filter(kept)

    return run


def _links(nodes: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) whose cosine reaches the threshold in double precision."""
    likely = (graph.where(F.col("near") >= threshold - NEAR)
              .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    return (likely.join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("of_a")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("of_b")), "b")
            .select("a", "b", "of_a", "of_b").mapInArrow(_confirmed(threshold), "a long, b long"))


def _audited(asked: list, threshold: float):
    """(a, b, n): links of the asked nodes that lead out of their components; with b null, how many lead anywhere."""
    by_kind: dict[int, list] = {}
    for r in asked:
        by_kind.setdefault(r.kind, []).append(r)
    held = {k: (np.array([r.node for r in rows]), np.array([r.component for r in rows]),
                np.stack([np.frombuffer(r.unit) for r in rows])) for k, rows in by_kind.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            for k in np.unique(kinds).tolist():
                if k not in held:
                    continue
                asked_nodes, asked_components, asked_units = held[k]
                rows = batch.filter(pa.array(kinds == k))
                node, component = rows.column(0).to_numpy(), rows.column(3).to_numpy()
                linked = matrix(rows.column(2), np.float64) @ asked_units.T >= threshold
                linked &= node[:, None] != asked_nodes[None, :]
                for i in np.flatnonzero(linked.any(axis=0)).tolist():
                    total[int(asked_nodes[i])] = total.get(int(asked_nodes[i]), 0) + int(linked[:, i].sum())
                i, j = np.nonzero(linked & (component[:, None] != asked_components[None, :]))
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked_nodes[j]), pa.array(node[i]), pa.array(np.ones(len(i), np.int64))], ["a", "b", "n"])
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int64()), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                ["a", "b", "n"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its nodes, their copies and vectors, centre, radius (an angle) and weight."""
    for batch in whole_runs(batches, 2):
        out = []
        cut = borders(batch, 2)
        for a, b in zip(cut[:-1], cut[1:]):
            rows = batch.slice(a, b - a)
            units, copies = matrix(rows.column(4), np.float64), rows.column(3).to_numpy()
            centre = units.sum(axis=0)
            length = np.sqrt((centre * centre).sum())
            centre = centre / length if length > 0 else units[0]
            radius = float(np.arccos(np.clip(units @ centre, -1, 1)).max())
            out.append((rows.column(0)[0].as_py(), rows.column(1)[0].as_py(), rows.column(2).to_numpy().tobytes(),
                        copies.tobytes(), units.tobytes(), centre.tolist(), radius, int(copies.sum())))
        names = "component block nodes copies units centre radius weight".split()
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], names)


BLOCKS = ("component long, block long, nodes binary, copies binary, units binary, centre array<double>, "
          "radius double, weight long")


def _compared(threshold: float):
    """(node, weight): what each node of two blocks is linked with in the other one, itself included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, *held in zip(*(c.to_pylist() for c in batch.columns)):
                a, b, m, n = (np.frombuffer(x, np.int64) for x in held[:4])
                u, v = (np.frombuffer(x).reshape(len(k), -1) for x, k in zip(held[4:], (a, b)))
                linked = u @ v.T >= threshold
                linked |= a[:, None] == b[None, :]
                node, weight = a, linked @ n
                if one != two:
                    node, weight = np.append(a, b), np.append(weight, m @ linked)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(weight.astype(np.int64))], ["node", "weight"])

    return run


def _counted(nodes: DataFrame, found: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, weight): the copies that each node of a component is linked with, its own included."""
    sizes = found.groupBy("component").agg(F.count("*").alias("m"))
    parts = F.ceil(F.col("m") / F.greatest(F.lit(float(block)), F.ceil(F.sqrt("m"))))
    members = materialize(
        found.withColumnRenamed("id", "node").join(sizes.select("component", parts.cast("long").alias("parts")), "component")
        .withColumn("block", F.pmod(F.xxhash64("node"), "parts")), "graph-members")
    blocks = materialize(
        members.join(nodes.select("node", "copies", "unit"), "node").select("component", "block", "node", "copies", "unit")
        .repartition("component", "block").sortWithinPartitions("component", "block", "node")
        .mapInArrow(_blocks, BLOCKS), "graph-blocks")
    ball = blocks.select("component", F.col("block").alias("two"), F.col("centre").alias("c"), F.col("radius").alias("r"),
                         F.col("weight").alias("w"))
    last = members.groupBy("component").agg(F.max("block").alias("last"))
    cosine = F.aggregate(F.zip_with("centre", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.when(F.col("one") == F.col("two"), F.lit(0.0)).otherwise(F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))))
    limit = float(np.arccos(threshold))
    pairs = materialize(
        blocks.join(last, "component")
        .select("component", F.col("block").alias("one"), "centre", "radius", "weight",
                F.explode(F.sequence("block", "last")).alias("two"))
        .join(ball, ["component", "two"]).withColumn("apart", apart)
        .where(F.col("apart") - F.col("radius") - F.col("r") <= limit + ANGLE)
        .select("component", "one", "two", "weight", "w",
                (F.col("apart") + F.col("radius") + F.col("r") <= limit - ANGLE).alias("all")), "graph-pairs")
    full = pairs.where("all")
    sums = (full.select("component", F.col("one").alias("block"), F.col("w").alias("weight"))
            .union(full.where("one <> two").select("component", F.col("two").alias("block"), "weight"))
            .groupBy("component", "block").agg(F.sum("weight").alias("weight")))
    held = lambda x: blocks.select("component", F.col("block").alias(x), F.col("nodes").alias(f"nodes_{x}"),
                                   F.col("copies").alias(f"copies_{x}"), F.col("units").alias(f"units_{x}"))
    mixed = (pairs.where("not all").select("component", "one", "two")
             .join(held("one"), ["component", "one"]).join(held("two"), ["component", "two"])
             .select("one", "two", "nodes_one", "nodes_two", "copies_one", "copies_two", "units_one", "units_two")
             .mapInArrow(_compared(threshold), "node long, weight long"))
    return (members.join(sums, ["component", "block"]).select("node", "weight").union(mixed)
            .groupBy("node").agg(F.sum("weight").alias("weight")))


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes of copies, and (node, kind, copies, first, unit, near32) for each."""
    classes = materialize(
        rows.where("usable").groupBy("label", "d", "hash_a", "hash_b")
        .agg(F.min("row").alias("node"), F.min("id").alias("first"), F.countDistinct("id").alias("copies")), "graph-classes")
    kinds = materialize(
        classes.select("label", "d").distinct().select("label", "d", F.monotonically_increasing_id().alias("kind")), "graph-kinds")
    named = classes.join(kinds, ["label", "d"]).select("node", "kind", "copies", "first")
    nodes = rows.select(F.col("row").alias("node"), "vec").join(named, "node").select("node", "kind", "copies", "first", "vec")

    def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unit(batches):
            near = [np.frombuffer(b).astype(np.float32).tobytes() for b in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.binary())], [*batch.schema.names, "near32"])

    return classes, materialize(
        nodes.mapInArrow(shorter, "node long, kind long, copies long, first long, unit binary, near32 binary"), "graph-nodes")


def linked_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
                   label_column: str = "label", *, threshold: float = 0.93, trees: int = 6, leaf: int = 64,
                   neighbours: int = 8, rounds: int = 3, audit: int = 1024, recall: float = 0.99,
                   attempts: int = 3, block: int = 192) -> tuple[DataFrame, Audit]:
    """(id, n_links, component_id, kept) for every row, and the last audit.

    `n_links` is the number of other vectors of the label with a cosine of the threshold or more,
    `component_id` the smallest id that links lead to; `kept` marks the row that stays.
    """
    v = F.col("vec")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = materialize(
        vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
                       F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("vec"))
        .select("*", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & finite
                                & F.exists(v, lambda x: x != 0), F.lit(False)).alias("usable"),
                F.size(v).alias("d"), F.xxhash64(F.lit(1), v).alias("hash_a"), F.xxhash64(F.lit(2), v).alias("hash_b")),
        "graph-rows")
    classes, nodes = _nodes(rows)
    graph = links = None
    checked = Audit(0, 0, 0)
    for attempt in range(attempts):
        k = neighbours << attempt
        leaves = (nodes.select("node", "kind", "unit")
                  .mapInArrow(_ordered(attempt * trees, trees), "tree int, kind long, code long, node long, near binary")
                  .repartitionByRange("tree", "kind", "code", "node").sortWithinPartitions("tree", "kind", "code", "node")
                  .select("tree", "kind", "node", "near").mapInArrow(_leaves(leaf << attempt, k // 2), EDGES))
        begun = leaves if graph is None else leaves.union(graph.select("node", "other", "near"))
        graph = materialize(
            _lists(begun.groupBy("node", "other").agg(F.max("near").alias("near")), k).drop("place"), "graph")
        graph = _descended(nodes, graph, k, rounds, threshold)
        own = _links(nodes, graph, threshold)
        links = materialize(own if links is None else own.union(links).distinct(), "graph-links")
        found = components(links)
        placed = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").select(
            "node", "kind", "unit", F.coalesce("component", "node").alias("component"))
        asked = placed.orderBy(F.xxhash64("node", F.lit(attempt)), "node").limit(audit).collect()
        seen = materialize(placed.mapInArrow(_audited(asked, threshold), "a long, b long, n long"), "graph-audit")
        sums = seen.agg(F.sum(F.when(F.col("b").isNull(), F.col("n"))).alias("links"), F.count("b").alias("missed")).first()
        checked = Audit(len(asked), sums.links or 0, (sums.links or 0) - sums.missed)
        if sums.missed:
            links = materialize(links.union(seen.where("b is not null").select("a", "b")), "graph-links")
            found = components(links)
        if checked.recall >= recall:
            break

    weights = _counted(nodes, found, threshold, block)
    first = nodes.select("node", "first").join(found.withColumnRenamed("id", "node"), "node")
    lowest = first.groupBy("component").agg(F.min("first").alias("component_id"))
    told = (first.select("node", "component").join(lowest, "component").join(weights, "node")
            .select("node", "component_id", "weight"))
    out = (rows.join(classes.withColumn("usable", F.lit(True)), ["label", "d", "hash_a", "hash_b", "usable"], "left")
           .join(told, "node", "left"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "first", "id"))
    return out.select(
        F.col("id").alias(id_column),
        F.coalesce(F.col("weight") - 1, F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")), checked
