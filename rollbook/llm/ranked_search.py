"""Ranked lexical search: summed accumulators of short lists inside document-at-a-time skipping.

The documents' terms that queries use are kept as one row of postings a document. Which terms these
are goes to the tasks as a bitmap of fixed size (FILTER_BITS); terms it lets through by chance are in
no query and fall out where lists are joined with queries. Queries are taken in blocks of about
`block` (query, term) pairs, so what a task holds of them is bounded. A task cuts its documents into
shards of `shard` documents, and for each query of the block

1. sums the postings of the query's short lists (at most `short` of all documents) term at a time into
   accumulators, ordered by document; they are from then on one iterator with a bound of its own;
2. goes through the shard in windows of `window` documents, in order of the document ids. The bound
   of a window is the sum of the greatest impacts there: of each long list, and of the accumulators.
   A window whose bound is below the query's threshold is skipped, lists and all. In others the
   documents' scores are summed from the accumulators and the long lists, greatest bound first, until
   what is left cannot lift any document of the window to the threshold.

The threshold is the k-th best score the task has seen for the query, or the k-th best accumulator
over all documents if that is more (a first pass over the short lists alone). Documents that reach it
exactly are kept, so ties come out whole. Tasks return k rows for a query at most.

A term is a run of characters other than ASCII ones that are no letter or digit, with A-Z as a-z. Terms
are told apart by 64-bit hashes. Null and empty texts have no terms. Rows with a null document id count
in the statistics and are not ranked; repeated rows are documents each. A query without terms has no
results; queries repeated with id and text count once, and such with the same id and different texts (or
a null id) are ranked each by themselves. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm import texts
from rollbook.session import materialize

FILTER_BITS = 22
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True
LISTS = "doc_id long, n long, terms array<long>, counts array<int>"
FOUND = "item long, doc_id long, score long"


def _filter_place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _term_rows(column: pa.Array, passed: np.ndarray | None) -> Iterator[tuple]:
    """For slices of texts: number of terms of each, then borders, hashes and counts of distinct ones."""
    for _, _, data, offsets in texts.slices(column):
        data = texts.LOWER[data]
        starts, ends = texts.runs(TERM[data], offsets)
        first = np.searchsorted(starts, offsets)
        n = np.diff(first)
        hashes = texts.span_hashes(data, starts, ends)
        owner = np.repeat(np.arange(len(n)), n)
        if passed is not None:
            kept = passed[_filter_place(hashes)]
            hashes, owner = hashes[kept], owner[kept]
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        begin = np.ones(len(hashes), bool)
        begin[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(begin)
        yield (n, np.searchsorted(owner[at], np.arange(len(n) + 1)).astype(np.int32), hashes[at].view(np.int64),
               np.diff(np.append(at, len(hashes))).astype(np.int32))


def _lists(passed: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = None
        if passed is not None:
            allowed = np.unpackbits(np.frombuffer(passed, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            done = 0
            for n, borders, hashes, counts in _term_rows(batch.column(1), allowed):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(n)).cast(pa.int64()), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(borders), pa.array(hashes)),
                     pa.ListArray.from_arrays(pa.array(borders), pa.array(counts))],
                    ["doc_id", "n", "terms", "counts"])
                done += len(n)

    return run


def _bitmap(terms: DataFrame) -> bytes:
    """FILTER_BITS as bits, set where a term's hash begins so: half a megabyte for any number of terms."""
    place = F.shiftrightunsigned("term", 64 - FILTER_BITS) + 1
    found = (terms.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect())
    whole = bytearray((1 << FILTER_BITS) // 8)
    for r in found:
        whole[(r.bucket - 1) * len(r.bits) : r.bucket * len(r.bits)] = r.bits
    return bytes(whole)


@dataclass(frozen=True)
class Asked:
    """A block of queries: for each (query, term), in order of the queries, its weight and kind."""

    items: np.ndarray  # of each query
    borders: np.ndarray
    place: np.ndarray  # of each pair, in `terms`
    terms: np.ndarray  # sorted
    weights: np.ndarray
    short: np.ndarray
    documents: int  # with a term
    occurrences: int
    floors: np.ndarray | None = None

    @staticmethod
    def of(rows: list, documents: int, occurrences: int) -> Asked:
        rows = sorted((r.item, r.term, r.weight, r.short) for r in rows)
        item, term, weight, short = (np.array(c) for c in zip(*rows))
        items, begin = np.unique(item, return_index=True)
        terms, one, place = np.unique(term, return_index=True, return_inverse=True)
        return Asked(items, np.append(begin, len(item)), place, terms, weight[one], short[one], documents, occurrences)

    def places(self, i: int) -> np.ndarray:
        return self.place[self.borders[i] : self.borders[i + 1]]


class Shard:
    """Lists of one shard's documents in the order of their ids."""

    def __init__(self, asked: Asked, ids: np.ndarray, n: np.ndarray, borders: np.ndarray, terms: np.ndarray, counts: np.ndarray):
        self.ids = np.sort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        place = np.searchsorted(asked.terms, terms)
        place[place == len(asked.terms)] = 0
        known = asked.terms[place] == terms
        owner = np.repeat(np.arange(len(ids)), np.diff(borders))[known]
        place, tf = place[known], counts[known].astype(np.int64)
        m = 50 + (50 * n[owner] * asked.documents) // asked.occurrences
        impact = asked.weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
        order = np.lexsort((rank[owner], place))
        self.docs, self.impacts = rank[owner][order], impact[order]
        self.first = np.searchsorted(place[order], np.arange(len(asked.terms) + 1))

    def accumulators(self, short: np.ndarray) -> np.ndarray:
        """Sums of the impacts over the given lists, term at a time, by document."""
        acc = np.zeros(len(self.ids), np.int64)
        for t in short:
            a, b = self.first[t], self.first[t + 1]
            acc[self.docs[a:b]] += self.impacts[a:b]
        return acc


def _shards(batches: Iterator[pa.RecordBatch], asked: Asked, shard: int) -> Iterator[Shard]:
    waiting: list[pa.RecordBatch] = []

    def built() -> Shard:
        table = pa.Table.from_batches(waiting).combine_chunks()
        terms, counts = (table.column(c).combine_chunks() for c in ("terms", "counts"))
        borders = np.asarray(terms.offsets) - terms.offsets[0].as_py()
        return Shard(asked, table.column("doc_id").to_numpy(), table.column("n").to_numpy(), borders,
                     np.asarray(terms.flatten()), np.asarray(counts.flatten()))

    for batch in batches:
        for i in range(0, batch.num_rows, shard):
            waiting.append(batch.slice(i, shard))
            if sum(b.num_rows for b in waiting) >= shard:
                yield built()
                waiting.clear()
    if waiting:
        yield built()


class Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int, floor: int = 1):
        self.k, self.floor = k, max(floor, 1)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def threshold(self) -> int:
        return max(self.floor, int(self.scores[-1])) if len(self.scores) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _found(asked: Asked, best: list[Best]) -> Iterator[pa.RecordBatch]:
    if best:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(asked.items, [len(b.ids) for b in best])), pa.array(np.concatenate([b.ids for b in best])),
             pa.array(np.concatenate([b.scores for b in best]))], ["item", "doc_id", "score"])


def _accumulated(asked: Asked, shard: int, k: int):
    """The k best accumulators of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in asked.items]
        for s in _shards(batches, asked, shard):
            for i, own in enumerate(best):
                places = asked.places(i)
                acc = s.accumulators(places[asked.short[places]])
                high = np.flatnonzero(acc >= own.threshold)
                if len(high):
                    own.add(acc[high], s.ids[high])
        yield from _found(asked, best)

    return run


def search(s: Shard, asked: Asked, i: int, own: Best, tops: np.ndarray, starts: np.ndarray, window: int) -> None:
    """Take the documents of one shard that belong to the best of query `i`.

    `tops` holds the greatest impact of every list in every window, `starts` where the window begins
    in the list.
    """
    places = asked.places(i)
    acc = s.accumulators(places[asked.short[places]])
    long = places[~asked.short[places]]
    acc_tops = np.maximum.reduceat(acc, np.arange(0, len(acc), window))
    list_tops = tops[long]
    bounds = acc_tops + list_tops.sum(axis=0)
    for w in range(len(bounds)):
        threshold = own.threshold
        if bounds[w] < threshold:
            continue
        at = w * window
        score = acc[at : at + window].copy()
        left = int(bounds[w] - acc_tops[w])
        for j in np.argsort(-list_tops[:, w], kind="stable"):
            if not list_tops[j, w] or int(score.max()) + left < threshold:
                break
            t = long[j]
            a, b = starts[t, w], starts[t, w + 1]
            score[s.docs[a:b] - at] += s.impacts[a:b]
            left -= int(list_tops[j, w])
        high = np.flatnonzero(score >= threshold) if not left else np.zeros(0, np.int64)
        if len(high):
            own.add(score[high], s.ids[at + high])


def _searched(asked: Asked, shard: int, window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, int(f)) for f in asked.floors]
        for s in _shards(batches, asked, shard):
            windows = -(-len(s.ids) // window)
            term = np.repeat(np.arange(len(asked.terms)), np.diff(s.first))
            cell = term * windows + s.docs // window
            tops = np.zeros(len(asked.terms) * windows, np.int64)
            np.maximum.at(tops, cell, s.impacts)
            tops = tops.reshape(-1, windows)
            begin = np.searchsorted(cell, np.arange(len(asked.terms) * windows + 1))
            starts = begin[np.arange(len(asked.terms))[:, None] * windows + np.arange(windows + 1)[None, :]]
            for i, own in enumerate(best):
                search(s, asked, i, own, tops, starts, window)
        yield from _found(asked, best)

    return run


def _ranks(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, queries: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           query_id_column: str = "item_id", query_column: str = "text", *, k: int = 50, short: float = 0.01,
           block: int = 50_000, shard: int = 4096, window: int = 256) -> DataFrame:
    """(query id, rank, id, score): the k best documents of each query, with scores above 0.

    A term in `df` of the N documents that have terms weighs w = floor(1000 ln((2N + 2) / (2df + 1)));
    it adds w * (10^9 tf div (1000 tf + 20 m)) to the score of a document that has it tf times, where
    m = 50 + (50 n N div L) for a document of n terms and L terms in all documents.
    """
    spark = docs.sparkSession
    items = materialize(
        queries.select(F.col(query_id_column).alias("query_id"), F.col(query_column).alias("text")).distinct()
        .select(F.monotonically_increasing_id().alias("item"), "query_id", "text"), "search-items")
    wanted = materialize(
        items.select("item", "text").mapInArrow(_lists(None), LISTS)
        .select(F.col("doc_id").alias("item"), F.explode("terms").alias("term")), "search-terms")
    lists = materialize(
        docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        .mapInArrow(_lists(_bitmap(wanted)), LISTS), "search-lists")
    total = lists.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("occurrences")).first()
    kind = next(f.dataType.simpleString() for f in items.schema if f.name == "query_id")
    if not total.documents:
        return spark.createDataFrame([], f"{query_id_column} {kind}, rank int, {id_column} long, score long")
    held = lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * total.documents + 2)) / (2 * F.col("df") + 1))).cast("long")
    asked = materialize(
        wanted.join(held, "term").select("item", "term", weight.alias("weight"),
                                         (F.col("df") <= short * total.documents).alias("short")), "search-asked")
    blocks = max(1, -(-asked.count() // block))
    found = None
    there = lists.where("doc_id is not null and size(terms) > 0")
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        own = Asked.of(rows, total.documents, total.occurrences)
        first = _ranks(there.mapInArrow(_accumulated(own, shard, k), FOUND), k).where(F.col("rank") == k).collect()
        floors = {r.item: r.score for r in first}
        own = Asked(**own.__dict__ | {"floors": np.array([floors.get(i, 1) for i in own.items.tolist()], np.int64)})
        part = there.mapInArrow(_searched(own, shard, window, k), FOUND)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], f"{query_id_column} {kind}, rank int, {id_column} long, score long")
    return _ranks(found, k).join(items.select("item", "query_id"), "item").select(
        F.col("query_id").alias(query_id_column), F.col("rank").cast("int").alias("rank"),
        F.col("doc_id").alias(id_column), "score")
