"""Packing documents into sequences of a fixed number of tokens: a linear grouping scheme.

Only the histogram of lengths (at most `capacity` rows, whatever the number of documents) goes to
the driver, which plans there:

1. full pieces fill a sequence each;
2. large pieces (over a quarter or an eighth of the capacity) are put, longest first, into groups of
   equal cardinality and rounded up to the longest of their group; configurations of the few sizes left
   are found by dynamic programming and used as often as the groups allow;
3. each slot of a configuration then takes actual documents of its group, in order of length;
4. small pieces are placed best-fit, longest first, into what is left.

More groups lose less by rounding, fewer leave rooms that small pieces can fill; a plan takes a
fraction of a second, so those for all SCHEMES are made and the one with the fewest sequences is
used. A plan row says: the pieces of one length with ranks in a range go to consecutive sequences, so
many in each, from such an offset. Runs of like sequences are kept as one, so the plan's size is
bounded by the numbers of configurations, groups and lengths, and does not grow with the
documents. Ranks within a length come from running counts of each task and the sums of those of
the tasks before it. Documents meet the plan in a join on length and rank.

Tokens: each slice of texts is cut, by numpy, into units that the tokenizer treats apart; only
distinct units that the worker has not met are encoded.

Null texts count as empty: one piece that holds the end token alone. Repeated rows are packed each;
null ids are kept. Only the id and the text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm import texts
from rollbook.session import materialize

#: (share of the capacity over which a piece is large, groups): each is planned, the best is used.
SCHEMES = [(large, groups) for large in (4, 8) for groups in (8, 16, 32, 64, 128, 256)]
#: Units a worker remembers, and lines encoded at once.
CACHED = 600_000
LINES = 16

_LETTER, _DIGIT, _MARK, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[np.r_[65:91, 97:123]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[np.r_[0:9, 14:32, 127]] = _OTHER
_CLASS[128:] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = 0


class Encoder:
    """Token ids of many texts with each distinct unit encoded once.

    A unit is a run of letters, a digit or a run of marks within a word of ASCII and Latin-1
    letters. A word with anything else (an apostrophe, "<|", other alphabets, control characters)
    is one unit and left to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has given this task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        last = [i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]
        self.is_last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_last[last] = True
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _units(self, data: np.ndarray, offsets: np.ndarray):
        kind = _CLASS[data]
        # Latin-1 letters: U+00C0 to U+00FF without the signs for times and divided by.
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = _LETTER
        kind[lead + 1] = _LETTER
        starts, ends = texts.runs(kind > 0, offsets)
        odd = (kind == _OTHER) | (data == 39)
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        sums = np.concatenate([[0], np.cumsum(odd)])
        whole = sums[ends] > sums[starts]
        lowered = texts.LOWER[data]
        for a, b in zip(starts[whole].tolist(), ends[whole].tolist()):
            kind[a:b] = _OTHER
            lowered[a:b] = data[a:b]
        # Borders inside a word: where the kind changes, and at each digit.
        border = np.zeros(len(data), bool)
        border[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        border &= kind > 0
        border[starts] = False
        stop = np.zeros(len(data) + 1, bool)
        stop[:-1] = border
        stop[ends] = True
        border[starts] = True
        begin = np.flatnonzero(border)
        return lowered, begin, np.flatnonzero(stop), kind[begin] == _OTHER

    def _encode(self, units: list[str], whole: np.ndarray) -> list[np.ndarray]:
        """Ids of each unit; plain ones are encoded in lines and parted at the last pieces."""
        out: list[np.ndarray] = [None] * len(units)  # type: ignore[list-item]
        plain = np.flatnonzero(~whole)
        lines = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        alone = list(np.flatnonzero(whole))
        for at in range(0, len(lines), LINES):
            some = lines[at : at + LINES]
            for line, ids in zip(some, self._ids([" ".join(units[i] for i in line) for line in some])):
                cut = np.flatnonzero(self.is_last[ids]) + 1
                if len(cut) == len(line):
                    for i, part in zip(line, np.split(ids, cut[:-1])):
                        out[i] = part
                else:
                    alone.extend(line)
        for at in range(0, len(alone), 1000):
            some = alone[at : at + 1000]
            for i, ids in zip(some, self._ids([units[i] for i in some])):
                out[i] = ids
        return out

    def _ids(self, lines: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32)
                for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, found: list[np.ndarray]) -> None:
        if len(self.known) + len(hashes) > CACHED:
            self._clear()
        count = np.array([len(x) for x in found], np.int64)
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *found]) if found else self.ids
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.first = np.insert(self.first, at, first)
        self.count = np.insert(self.count, at, count)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (n + 1)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        lowered, begin, stop, whole = self._units(data, offsets)
        hashes = texts.span_hashes(lowered, begin, stop) ^ whole.astype(np.uint64)
        unique, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[at] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            if len(self.known) + len(new) > CACHED:  # start anew, with all units of this slice
                self._clear()
                new = np.arange(len(unique))
            units = [lowered[begin[i] : stop[i]].tobytes().decode("utf-8", "replace") for i in sample[new]]
            self._learn(unique[new], self._encode(units, whole[sample[new]]))
            at = np.searchsorted(self.known, unique)
        count = self.count[at][inverse]
        ends = np.cumsum(count)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
        ids = self.ids[np.repeat(self.first[at][inverse], count) + place]
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(begin, offsets)]


_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path)
        if encoder is None:
            encoder = _encoders[path] = Encoder(path)
        task = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for i, _, data, offsets in texts.slices(batch.column(1)):
                ids, first = encoder.encode(data, offsets)
                rows = []
                for k in range(len(first) - 1):
                    own = np.concatenate([ids[first[k] : first[k + 1]], end]).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append((i + k, piece, start, len(part), zlib.crc32(part), ranks[len(part)]))
                        ranks[len(part)] += 1
                row, piece, start, length, crc, rank = (np.array(x, np.int64) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.array(crc), pa.array(np.full(len(row), task, np.int32)), pa.array(rank)],
                    ["id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return run


def _configuration(sizes: list[int], demand: list[int], capacity: int) -> list[int]:
    """How many of each size to put into one sequence: the largest one left, and the fullest rest."""
    first = next(j for j, d in enumerate(demand) if d)
    room = capacity - sizes[first]
    chosen = [0] * len(sizes)
    chosen[first] = 1
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    steps: list[tuple[int, np.ndarray]] = []
    for j in range(first, len(sizes)):
        left = demand[j] - (j == first)
        for _ in range(min(left, room // sizes[j])):
            more = reach.copy()
            more[sizes[j]:] |= reach[: room + 1 - sizes[j]]
            if (more == reach).all():
                break
            steps.append((j, reach))
            reach = more
    at = int(np.flatnonzero(reach)[-1])
    for j, before in reversed(steps):
        if not before[at]:
            chosen[j] += 1
            at -= sizes[j]
    return chosen


class _Supply:
    """The pieces of a group, longest first, dealt in stretches of one length."""

    def __init__(self) -> None:
        self.parts: list[list[int]] = []  # length, first rank, count
        self.at = 0

    def take(self, n: int) -> list[tuple[int, int, int]]:
        out = []
        while n:
            part = self.parts[self.at]
            got = min(n, part[2])
            out.append((part[0], part[1], got))
            part[1] += got
            part[2] -= got
            n -= got
            self.at += part[2] == 0
        return out


Row = tuple[int, int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int) -> list[Row]:
    """Rows (length, rank_from, rank_to, sequence, each, offset) that place every piece.

    The piece of rank r goes to `sequence + (r - rank_from) // each`, at
    `offset + (r - rank_from) % each * length`.
    """
    plans = [_grouped(histogram, capacity, large, groups) for large, groups in SCHEMES]
    return min(plans, key=lambda p: p[0])[1]


def _grouped(histogram: dict[int, int], capacity: int, parts: int, groups: int) -> tuple[int, list[Row]]:
    """The number of sequences and the rows with pieces over `capacity // parts` in `groups` groups."""
    rows: list[Row] = []
    bins = histogram.get(capacity, 0)
    if bins:
        rows.append((capacity, 0, bins, 0, 1, 0))
    free: dict[int, list[list[int]]] = {}  # room left: [first sequence, number]

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            free.setdefault(room, []).append([first, n])

    large = sorted((x for x in histogram if capacity // parts < x < capacity), reverse=True)
    total = sum(histogram[x] for x in large)
    if total:
        quota = -(-total // groups)
        sizes: list[int] = []
        supplies: list[_Supply] = []
        room = 0
        for x in large:
            n, rank = histogram[x], 0
            while n:
                if not room:
                    sizes.append(x)
                    supplies.append(_Supply())
                    room = quota
                got = min(n, room)
                supplies[-1].parts.append([x, rank, got])
                rank, n, room = rank + got, n - got, room - got
        demand = [sum(p[2] for p in s.parts) for s in supplies]
        while any(demand):
            chosen = _configuration(sizes, demand, capacity)
            times = min(demand[j] // c for j, c in enumerate(chosen) if c)
            slots = []
            for j, c in enumerate(chosen):
                demand[j] -= c * times
                slots += [supplies[j].take(times) for _ in range(c)]
            borders = sorted({0, *(int(b) for s in slots for b in np.cumsum([p[2] for p in s]))})
            places = [0] * len(slots)
            used = [0] * len(slots)
            for low, high in zip(borders, borders[1:]):
                offset = 0
                for k, s in enumerate(slots):
                    length, rank, n = s[places[k]]
                    rows.append((length, rank + used[k], rank + used[k] + high - low, bins + low, 1, offset))
                    offset += length
                    used[k] += high - low
                    if used[k] == n:
                        places[k], used[k] = places[k] + 1, 0
                leave(capacity - offset, bins + low, high - low)
            bins += times
    for x in sorted((x for x in histogram if x <= capacity // parts), reverse=True):
        n, rank = histogram[x], 0
        while n:
            fit = min((r for r in free if r >= x), default=0)
            if not fit:
                new = -(-n // (capacity // x))
                leave(capacity, bins, new)
                bins += new
                fit = capacity
            run = free[fit][-1]
            each = min(fit // x, n)
            many = min(run[1], n // each)
            first = run[0]
            run[0], run[1] = run[0] + many, run[1] - many
            if not run[1]:
                free[fit].pop()
                if not free[fit]:
                    del free[fit]
            rows.append((x, rank, rank + many * each, first, each, capacity - fit))
            leave(fit - each * x, first, many)
            rank, n = rank + many * each, n - many * each
    return bins, rows


def packed(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", *,
           capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    `tokenizer` is the path of a tokenizer file that the executors have; `end_id` closes a text.
    """
    spark = docs.sparkSession
    pieces = materialize(
        docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
        .mapInArrow(_pieces(tokenizer, capacity, end_id),
                    "id long, piece int, start long, length long, ids_crc32 long, task int, rank long"), "pieces")
    counts = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    before = counts.select("length", "task", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = spark.createDataFrame(
        plan(histogram, capacity),
        "length long, rank_from long, rank_to long, sequence long, each long, offset_from long")
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The plan's size does not depend on the number of documents.
    place = F.col("rank") - F.col("rank_from")
    return (ranked.join(F.broadcast(rows), "length")
            .where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
            .select(F.col("id").alias(id_column), "piece", "start", "length", "ids_crc32",
                    (F.col("sequence") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
                    (F.col("offset_from") + place % F.col("each") * F.col("length")).alias("offset")))
