"""Quality classifier: multiple-instance learning with gated attention over passages.

A document is a bag of passages of PASSAGE words. Each passage is described by measures of its
form (FEATURES), encoded by a learned layer, weighted by learned gated attention (tanh times
sigmoid, softmax over the document's passages), and the weighted sum is scored. Only document
labels are used.

The model is fitted on the driver from at most `sample` labelled documents (those with the smallest
hash of their id; 4096 by default), of which only the passage measures are collected: one row of each
id, and for fitting at most `bag` passages of it, longer texts by the means of neighbouring passages.
So what reaches the driver has a bound in bytes. Scoring runs in Arrow batches over all passages of
whole texts, without a shuffle.

Null and empty texts are one passage without words and get a score. Without labels the score is
0.5; with labels of one kind it tends to that. Null labels and ids do not take part in fitting;
conflicting labels of one id count as the larger, of rows that share an id one is learnt from. All columns of the input are kept; one of the
name of the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm import texts

PASSAGE = 64
SAMPLE = 4096
BAG = 512
HIDDEN = 24

#: Measures of a passage, in order.
FEATURES = [
    "word length", "spread of word lengths", "capitals", "digits", "symbols", "exclamation marks", "bars",
    "stops and commas", "bytes beyond ASCII", "words in capitals", "words with a capital first",
    "words with a symbol", "words like the one before", "words in a run met before", "line feeds",
    "log of its words", "log of the text's words",
]


def _table(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_UPPER = _table(*range(65, 91))
_BYTES = np.stack([
    _UPPER, _table(*range(48, 58)), _table(*b"#*$%&|<>"), _table(*b"!"), _table(*b"|"), _table(*b".,"),
    _table(*range(128, 256))])


def _met_before(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, whether the three words from it on have stood in its text before."""
    n = len(hashes)
    met = np.zeros(n, bool)
    if n < 3:
        return met
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    run = texts.mix(hashes[:-2] + texts.mix(hashes[1:-1] + texts.mix(hashes[2:])))
    key = texts.mix(run + text[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    whole = np.flatnonzero(text[:-2] == text[2:])
    order = whole[np.argsort(key[whole], kind="stable")]
    met[order[1:][key[order[1:]] == key[order[:-1]]]] = True
    return met


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measures of all passages of a slice, and for each text the number of passages before it."""
    starts, ends, first = texts.words(data, offsets)
    n_words = np.diff(first)
    per_text = np.maximum(1, -(-n_words // PASSAGE))
    before = np.concatenate([[0], np.cumsum(per_text)])
    out = np.zeros((before[-1], len(FEATURES)), np.float32)
    if not len(starts):
        return out, before
    hashes = texts.span_hashes(data, starts, ends)
    length = (ends - starts).astype(np.float64)
    counts = []
    for table in _BYTES:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        counts.append((sums[ends] - sums[starts]).astype(np.float64))
    text = np.repeat(np.arange(len(per_text)), n_words)
    same = np.zeros(len(starts))
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    gap = np.zeros(len(starts))
    gap[1:] = feeds[starts[1:]] - feeds[ends[:-1]]
    per_word = np.stack([
        np.ones(len(starts)), length, length**2, *counts, counts[0] == length - counts[5] - counts[3],
        _UPPER[data[starts]], counts[2] > 0, same, _met_before(hashes, first), gap], axis=1)
    # The passages that have words, by their first word.
    number = np.arange(before[-1]) - np.repeat(before[:-1], per_text)
    begin = np.repeat(first[:-1], per_text) + number * PASSAGE
    full = np.flatnonzero(np.repeat(n_words, per_text) > 0)
    total = np.add.reduceat(per_word, begin[full], axis=0)
    n, size = total[:, 0], total[:, 1]
    mean = size / n
    shares = [mean / 10, np.sqrt(np.maximum(total[:, 2] / n - mean**2, 0)) / 10]
    shares += [total[:, 3 + k] / size for k in range(len(_BYTES))]
    shares += [total[:, k] / n for k in range(10, 16)]
    shares += [np.log1p(n) / 4, np.log1p(np.repeat(n_words, per_text)[full]) / 10]
    out[full] = np.stack(shares, axis=1)
    return out, before


def pooled(x: np.ndarray, most: int) -> np.ndarray:
    """At most `most` rows that stand for all of `x`: means of runs of neighbours, alike in length."""
    if len(x) <= most:
        return x
    begin = np.arange(most) * len(x) // most
    return (np.add.reduceat(x, begin, axis=0) / np.diff([*begin, len(x)])[:, None]).astype(x.dtype)


def _softmax(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Within each text; `before` counts the passages before each."""
    per_text = np.diff(before)
    e = np.exp(x - np.repeat(np.maximum.reduceat(x, before[:-1]), per_text))
    return e / np.repeat(np.add.reduceat(e, before[:-1]), per_text)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(model: dict[str, np.ndarray], x: np.ndarray, before: np.ndarray) -> dict[str, np.ndarray]:
    x = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    e = np.tanh(x @ model["W"] + model["b"])
    t, s = np.tanh(e @ model["V"]), _sigmoid(e @ model["U"])
    a = _softmax((t * s) @ model["w"], before)
    z = np.add.reduceat(a[:, None] * e, before[:-1], axis=0)
    return {"x": x, "e": e, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ model["c"] + model["c0"])}


def score(model: dict[str, np.ndarray], x: np.ndarray, before: np.ndarray) -> np.ndarray:
    return _forward(model, x.astype(np.float64), before)["score"]


def train(x: np.ndarray, before: np.ndarray, labels: np.ndarray, *, steps: int = 160, rate: float = 0.03,
          decay: float = 1e-4, bags: int = 512) -> dict[str, np.ndarray]:
    """Fit all weights together by Adam on the cross entropy of the documents' labels.

    Each step takes the next `bags` documents, in an order drawn anew for each round over all.
    """
    rng = np.random.default_rng(11)
    d = x.shape[1]
    model = {
        "mean": x.mean(axis=0) if len(x) else np.zeros(d), "scale": (x.std(axis=0) if len(x) else np.ones(d)) + 1e-3,
        "W": rng.normal(0, 0.3, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, HIDDEN)),
        "U": rng.normal(0, 0.3, (HIDDEN, HIDDEN)), "w": np.zeros(HIDDEN), "c": np.zeros(HIDDEN), "c0": np.zeros(1),
    }
    if not len(labels):
        return model
    names = ["W", "b", "V", "U", "w", "c", "c0"]
    first = {k: np.zeros_like(model[k]) for k in names}
    second = {k: np.zeros_like(model[k]) for k in names}
    left = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if not len(left):
            left = rng.permutation(len(labels))
        taken, left = left[:bags], left[bags:]
        sizes = before[taken + 1] - before[taken]
        inner = np.concatenate([[0], np.cumsum(sizes)])
        text = np.repeat(np.arange(len(taken)), sizes)
        f = _forward(model, x[np.repeat(before[taken] - inner[:-1], sizes) + np.arange(inner[-1])].astype(np.float64), inner)
        d_out = (f["score"] - labels[taken]) / len(taken)
        d_z = d_out[:, None] * model["c"]
        e, a, t, s = f["e"], f["a"], f["t"], f["s"]
        d_a = (d_z[text] * e).sum(axis=1)
        d_l = a * (d_a - np.add.reduceat(a * d_a, inner[:-1])[text])
        d_t = d_l[:, None] * model["w"] * s * (1 - t**2)
        d_s = d_l[:, None] * model["w"] * t * s * (1 - s)
        d_e = a[:, None] * d_z[text] + d_t @ model["V"].T + d_s @ model["U"].T
        d_h = d_e * (1 - e**2)
        slopes = {"W": f["x"].T @ d_h, "b": d_h.sum(axis=0), "V": e.T @ d_t, "U": e.T @ d_s,
                  "w": (t * s).T @ d_l, "c": f["z"].T @ d_out, "c0": d_out.sum(keepdims=True)}
        for k in names:
            g = slopes[k] + decay * model[k]
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            model[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_column: str = "doc_id") -> Column:
    """Whether a row is kept from fitting: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
        label_column: str = "quality", sample: int = SAMPLE, bag: int = BAG) -> dict[str, np.ndarray]:
    """A model from at most `sample` labelled documents that are not held out, `bag` passages of each."""
    chosen = (labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & ~held_out(id_column))
              .groupBy(id_column).agg(F.max(label_column).cast("int").alias("label_"))
              .orderBy(F.xxhash64(id_column), id_column).limit(sample))

    def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in texts.slices(batch.column(2)):
                x, before = passages(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                     pa.array([pooled(x[a:b], bag).tobytes() for a, b in zip(before[:-1], before[1:])], pa.binary())],
                    ["id", "label", "x"])

    # At most `sample` ids are broadcast.
    rows = (docs.select(F.col(id_column), F.col(text_column).alias("text_"))
            .join(F.broadcast(chosen), id_column)
            .select(F.col(id_column).cast("long").alias("id"), F.col("label_").alias("label"), "text_")
            .mapInArrow(measures, "id long, label int, x binary")
            .groupBy("id", "label").agg(F.min("x").alias("x")).collect())
    rows = sorted(rows, key=lambda r: r.id)
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)) for r in rows]
    before = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate(bags) if bags else np.zeros((0, len(FEATURES)), np.float32)
    return train(x, before, np.array([r.label > 0 for r in rows], np.float64))


def scored(docs: DataFrame, model: dict[str, np.ndarray], text_column: str = "text", *,
           score_column: str = "score") -> DataFrame:
    """`docs` with the probability that the text's label is 1."""
    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for _, _, data, offsets in texts.slices(column):
            out.append(score(model, *passages(data, offsets)))
        return pa.array(np.concatenate(out))

    return docs.withColumn(score_column, of(F.col(text_column)))
