"""SentencePiece encoding and decoding: Viterbi over a trie of marked words.

Text is marked as the library does it: a mark in front, and one for every space. It is cut where no
piece of the vocabulary reaches across (before marks, around line feeds, between a letter and a
punctuation sign that follows a letter in no piece), so that the best segmentation of the text is
that of its parts one after another. The distinct parts of a run of texts that a worker has not met yet are sorted;
walking them in this order is a depth-first walk of their trie: forward scores up to the common
prefix with the part before are still on the stack and are used again. The ids of a text are then
gathered from those of its parts, and its bytes from those of its pieces, many texts at a time.

The segmentation has the greatest sum of piece scores; of equal ones that with the longest last
piece. Characters outside the vocabulary cost 10 more than the worst piece and become byte pieces.
With a vocabulary trained by merges, scores are merge ranks, and the result can differ from the
library's, which replays the merges; the decoded text is the same.

Null and empty texts have no pieces. Repeated rows are encoded each. Columns of the input are kept;
those of the names of the results are replaced.
"""

from __future__ import annotations

import re
import string
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_COST = 10.0
CACHED = 600_000
_LETTER = r"[^\W\d_]"


class _Numbers(dict):
    """Numbers its keys as they are first asked for."""

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        return n


class Pieces:
    """A vocabulary: pieces with scores, byte pieces and the places where text may be cut."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_unknown(i) or model.is_control(i) for i in range(n)]
        self.bytes_id = [0] * 256
        self.plain: dict[str, tuple[float, int]] = {}
        self.raw: list[bytes] = []
        for i, piece in enumerate(names):
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes_id[value] = i
                self.raw.append(bytes([value]))
            elif special[i]:
                self.raw.append(b"")
            else:
                self.plain[piece] = (model.get_score(i), i)
                self.raw.append(piece.replace(MARK, " ").encode())
        #: Every end of a piece, with (score, id) where it is a piece itself.
        self.ends: dict[str, tuple[float, int] | None] = {
            p[i:]: self.plain.get(p[i:]) for p in self.plain for i in range(len(p))}
        self.unknown = min((s for s, _ in self.plain.values()), default=0.0) - UNKNOWN_COST
        self.cut = self._cuts()
        self.raw_lengths = np.array([len(b) for b in self.raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        #: Parts met so far by number; their pieces, and where and how many they are; how often each was met.
        self.known = _Numbers()
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def forget(self, keep: int) -> None:
        """Know only the `keep` parts met most often, with half their counts."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:keep])
        names = list(self.known)
        self.known = _Numbers((names[i], n) for n, i in enumerate(kept.tolist()))
        self.ids, self.lengths = _gathered(self.ids, self.starts, self.lengths, kept)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.uses = self.uses[kept] // 2

    def _cuts(self) -> re.Pattern[str]:
        """The pattern of parts that no piece reaches out of."""
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.plain):
            return re.compile(r".+", re.S)
        after = set(re.findall(rf"(?<={_LETTER})[^\w\s]", "\n".join(self.plain)))
        signs = re.escape("".join(sorted(set(string.punctuation) - after - {"_"})))
        inner = rf"(?:[^{MARK}\n{signs}]+|(?<!{_LETTER})[{signs}])" if signs else rf"[^{MARK}\n]"
        return re.compile(rf"\n|{MARK}*[^{MARK}\n]{inner}*|{MARK}+")

    def segment(self, parts: list[str]) -> None:
        """Find the pieces of `parts`, which are numbered on from those that have theirs."""
        order = sorted(range(len(parts)), key=parts.__getitem__)
        pool: list[int] = []
        lengths: list[int] = []
        scores = [0.0]
        begins, last_ids = [0], [-1]  # for each length: where its last piece begins, and its id
        previous = ""
        ending, unknown = self.ends.get, self.unknown
        for part in map(parts.__getitem__, order):
            shared = 0
            for a, b in zip(part, previous):
                if a != b:
                    break
                shared += 1
            del scores[shared + 1 :], begins[shared + 1 :], last_ids[shared + 1 :]
            for end in range(shared + 1, len(part) + 1):
                first, piece = end - 1, -1
                found = ending(part[first:end], 0)
                if found:
                    best = scores[first] + found[0]
                    piece = found[1]
                else:
                    best = scores[first] + unknown
                begin = end - 2
                while found != 0 and begin >= 0:
                    found = ending(part[begin:end], 0)
                    if found:
                        score = scores[begin] + found[0]
                        if score >= best:
                            best, first, piece = score, begin, found[1]
                    begin -= 1
                scores.append(best)
                begins.append(first)
                last_ids.append(piece)
            ids: list[int] = []
            end = len(part)
            while end:
                begin, piece = begins[end], last_ids[end]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids.extend(self.bytes_id[b] for b in reversed(part[begin:end].encode()))
                end = begin
            pool.extend(reversed(ids))
            lengths.append(len(ids))
            previous = part
        own = np.array(lengths, np.int64)
        place = np.argsort(np.array(order, np.int64))
        self.starts = np.append(self.starts, (len(self.ids) + np.cumsum(own) - own)[place])
        self.lengths = np.append(self.lengths, own[place])
        self.ids = np.append(self.ids, np.array(pool, np.int32))

    def encode_run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        old = len(self.known)
        number = self.known.__getitem__
        found = []
        for t in texts:
            parts = self.cut.findall(MARK + t.replace(" ", MARK)) if t else []
            found.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        numbers = np.concatenate([np.zeros(0, np.int64), *found])
        if len(self.known) > old:
            self.segment(list(islice(self.known, old, None)))
        self.uses = np.bincount(numbers, minlength=len(self.known)) + np.append(
            self.uses, np.zeros(len(self.known) - old, np.int64))
        ids, lengths = _gathered(self.ids, self.starts, self.lengths, numbers)
        ends = np.cumsum([0, *map(len, found)])
        if len(self.known) > CACHED:
            self.forget(CACHED // 2)
        return ids, np.diff(np.append(0, np.cumsum(lengths))[ends])

    def decode_run(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of runs of ids, `counts` of them each; bytes that are no text are replaced."""
        data, lengths = _gathered(self.raw_bytes, self.raw_starts, self.raw_lengths, ids)
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        begins = ends[:-1][np.diff(ends) > 0]
        marks = begins[data[begins] == ord(" ")]
        data = np.delete(data, marks)
        ends = ends - np.searchsorted(marks, ends, side="left")
        texts = pa.StringArray.from_buffers(
            len(counts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            texts = pa.array([
                data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())
        return texts

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        ids, counts = self.encode_run(texts)
        return [own.tolist() for own in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def decode(self, ids: list[int]) -> str:
        """The text of one run of ids."""
        return self.decode_run(np.array(ids, np.int64), np.array([len(ids)]))[0].as_py()


def _gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `pool` of these numbers one after another, and their lengths."""
    own = lengths[numbers]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts[numbers] - ends + own, own)], own


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The vocabulary of a model file, loaded once for each worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _some(column: pa.Array, chars: int = 8_000_000):
    """Runs of texts of about so many characters."""
    run: list[str] = []
    n = 0
    for x in column:
        text = x.as_py() or ""
        run.append(text)
        n += len(text)
        if n >= chars:
            yield run
            run, n = [], 0
    yield run


def _some_lists(column: pa.ListArray, items: int = 500_000):
    """(ids, counts) of runs of rows of about so many ids in all."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(counts))
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + items, side="right")) - 1)
        yield ids[ends[at] : ends[to]], counts[at:to]
        at = to


def encoded(docs: DataFrame, model: str, text_column: str = "text", *, ids_column: str = "ids") -> DataFrame:
    """`docs` with the piece ids of each text; `model` is a path that the executors have."""
    @F.arrow_udf("array<int>")
    def of(column: pa.Array) -> pa.Array:
        out = [pieces(model).encode_run(run) for run in _some(column)]
        ends = np.append(0, np.cumsum(np.concatenate([counts for _, counts in out])))
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(np.concatenate([ids for ids, _ in out]), pa.int32()))

    return docs.withColumn(ids_column, of(F.col(text_column)))


def decoded(docs: DataFrame, model: str, ids_column: str = "ids", *, text_column: str = "decoded") -> DataFrame:
    """`docs` with the text of each array of piece ids; null and empty arrays give the empty text."""
    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([
            pa.array([], pa.string()),
            *[pieces(model).decode_run(ids, counts) for ids, counts in _some_lists(column)]])

    return docs.withColumn(text_column, of(F.col(ids_column)))
