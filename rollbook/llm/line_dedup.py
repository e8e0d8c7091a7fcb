"""Line dedup: repeated windows of three consecutive lines, found over all documents.

Lines are what stands between line feeds. Every window of `size` neighbouring lines with at least
one word is hashed; a window that occurs earlier - in a document with a smaller id, or further up
in the same text - is a repeat, and all lines that repeats cover are removed. Windows overlap, so
the covered positions merge into runs. The first occurrence stays; texts of fewer than `size`
lines stay as they are.

Windows, not texts, are shuffled to find repeats: one aggregate with map-side combine gives the
smallest id for each hash, a join (split by Spark where a line is hot) brings it back, and each
document gets the set of its own repeated hashes, which its own length bounds.

A null text stays null and has no lines. Rows with a null id are only compared within themselves.
Rows that share an id are judged each by its own text, and not as repeats of each other. All
columns of the input are returned; those that clash with the ones added are replaced.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.session import materialize

A_WORD = r"[^\x20\x09-\x0D]"
_WORD = re.compile(A_WORD)


def _windows(docs: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """(id, window): a 128-bit hash of every window with a word."""
    lines = docs.select(F.col(id_column).alias("id"), F.split(text_column, "\n").alias("lines"))
    joined = F.transform(F.sequence(F.lit(1), F.size("lines") - size + 1),
                         lambda i: F.array_join(F.slice("lines", i, size), "\n"))
    return (lines.where((F.size("lines") >= size) & F.col("id").isNotNull())
            .select("id", F.explode(joined).alias("window"))
            .where(F.col("window").rlike(A_WORD))
            .select("id", F.unhex(F.md5(F.col("window").cast("binary"))).alias("window")))


def covered(text: str, repeated: set[bytes], size: int) -> tuple[str, int, int, int]:
    """What is left of `text`, its lines, the lines removed and the runs they form."""
    lines = text.split("\n")
    gone = [False] * len(lines)
    seen = set()
    if len(lines) >= size and (repeated or len(lines) > size):
        for i in range(len(lines) - size + 1):
            window = "\n".join(lines[i : i + size])
            if not _WORD.search(window):
                continue
            key = hashlib.md5(window.encode()).digest()
            if key in seen or key in repeated:
                gone[i : i + size] = [True] * size
            seen.add(key)
    n = sum(gone)
    if not n:
        return text, len(lines), 0, 0
    spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
    return "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), n, spans


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
               size: int = 3) -> DataFrame:
    """`docs` with the text that is left, and `n_lines`, `n_removed` and `n_spans` of each."""
    windows = materialize(_windows(docs, id_column, text_column, size), "line-windows")
    shared = (windows.groupBy("window").agg(F.min("id").alias("first"), F.max("id").alias("last"))
              .where("first < last").select("window", "first"))
    repeats = (windows.join(shared, "window").where("id > first")
               .groupBy(F.col("id").alias("repeats_of_id")).agg(F.collect_set("window").alias("repeats_in_it")))

    @F.pandas_udf("text string, n_lines long, n_removed long, n_spans long")
    def remaining(text: pd.Series, repeated: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0, 0) if t is None else covered(t, set() if r is None else set(r), size)
                for t, r in zip(text, repeated)]
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed", "n_spans"])

    added = ["n_lines", "n_removed", "n_spans"]
    joined = docs.join(repeats, docs[id_column] == repeats.repeats_of_id, "left")
    done = joined.withColumn("line_dedup_", remaining(F.col(text_column), F.col("repeats_in_it")))
    return done.select(
        *[F.col("line_dedup_.text").alias(c) if c == text_column else docs[c] for c in docs.columns if c not in added],
        *[F.col(f"line_dedup_.{c}").alias(c) for c in added])
