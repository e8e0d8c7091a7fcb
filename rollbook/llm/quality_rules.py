"""Quality rules whose thresholds come from the data: a quantile sketch per language and source.

Every document gets a few measures. KLL sketches of them are built per (language, source), with
partial sketches combined before the shuffle, and merged upwards to languages and to the whole.
A cell with fewer than `least` documents takes the fences of its language, and a language with
fewer those of the whole. A fence lies `reach` times the distance of the quartiles beyond them,
and at least a fixed slack (SLACK), so that a cell in which all documents are alike rejects none
of its like. The fences are joined to the documents' measures; the texts are read once.

Column functions only. Null texts have no words; null language or source count as ''. Repeated
rows are judged and returned each. With no document to learn from nothing is fenced off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.columns import let
from rollbook.session import materialize

# White space of words, and the characters that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WORD_BREAK = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"

#: The measures, with the least distance of a fence from the quartile (above, below).
SLACK = {
    "word_length": (2.0, 2.0),
    "symbol_share": (0.05, None),
    "dup_line_share": (0.4, None),
    "repeat_share": (0.3, None),
}
SKETCH_K = 200


def _repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more, first ones included."""
    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, i, by: F.coalesce(F.get(s, i + by)["h"] == x["h"], F.lit(False))
            at = F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])
            return let(at, lambda p: F.size(F.array_distinct(F.flatten(F.array(
                p, F.transform(p, lambda k: k + 1), F.transform(p, lambda k: k + 2))))))

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(placed, places)).otherwise(0)

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, let(hashes, covered)).otherwise(0)


def measured(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` without the text, with the struct `m` of the counts of each whole text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(A_WORD))
    counts = F.struct(
        let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"))
    return docs.select(*[c for c in docs.columns if c != text_column], counts.alias("m"))


def _fences(eligible: DataFrame, least: int, reach: float) -> DataFrame:
    """(lang_, source_, <measure>_low, <measure>_high) for each cell of `eligible`."""
    names = list(SLACK)
    cells = eligible.groupBy("lang_", "source_").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, SKETCH_K).alias(m) for m in names])
    cells = materialize(cells, "quality-sketches")
    merged = [F.kll_merge_agg_double(m).alias(f"{m}_up") for m in names]
    langs = cells.groupBy("lang_").agg(F.sum("n").alias("lang_n"), *merged)
    whole = (cells.groupBy(F.lit(0).alias("all_")).agg(*[F.kll_merge_agg_double(m).alias(f"{m}_all") for m in names]))
    chosen = (cells.join(langs, "lang_").withColumn("all_", F.lit(0)).join(whole, "all_")
              .select("lang_", "source_", *[
                  F.when(F.col("n") >= least, F.col(m))
                  .when(F.col("lang_n") >= least, F.col(f"{m}_up"))
                  .otherwise(F.col(f"{m}_all")).alias(m) for m in names]))
    fences = []
    for m, (above, below) in SLACK.items():
        q1 = F.kll_sketch_get_quantile_double(F.col(m), F.lit(0.25))
        q3 = F.kll_sketch_get_quantile_double(F.col(m), F.lit(0.75))
        fences.append((q3 + F.greatest(reach * (q3 - q1), F.lit(above))).alias(f"{m}_high"))
        if below is not None:
            fences.append((q1 - F.greatest(reach * (q3 - q1), F.lit(below))).alias(f"{m}_low"))
    return chosen.select("lang_", "source_", *fences)


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                  lang_column: str = "lang", source_column: str = "source",
                  least: int = 200, reach: float = 4.0) -> DataFrame:
    """Counts, base rule and verdict for every row of `docs`.

    (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reasons):
    `reasons` lists the measures that lie beyond their fences.
    """
    source = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"),
        F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang_"),
        F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source_"))
    m = F.col("m")
    n_words, repeats = m["w"]["n_words"], m["w"]["n_repeat_words"]
    rows = materialize(measured(source).select(
        "id", "lang_", "source_", n_words.alias("n_words"), m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        ((n_words < 50) | (100 * repeats > 50 * n_words)).alias("base_failed"),
        F.try_divide(m["word_chars"].cast("double"), n_words).alias("word_length"),
        F.try_divide(m["n_symbols"].cast("double"), m["word_chars"]).alias("symbol_share"),
        F.try_divide(m["l"]["n_dup_lines"].cast("double"), m["l"]["n_lines"]).alias("dup_line_share"),
        F.try_divide(repeats.cast("double"), n_words).alias("repeat_share")), "quality-measures")
    fences = _fences(rows.where("not base_failed"), least, reach)
    beyond = []
    for name, (_, below) in SLACK.items():
        out = F.col(name) > F.col(f"{name}_high")
        if below is not None:
            out = out | (F.col(name) < F.col(f"{name}_low"))
        beyond.append(F.when(out, F.lit(name)))
    judged = rows.join(fences, ["lang_", "source_"], "left").withColumn(
        "reasons", F.array_compact(F.array(*beyond)))
    return judged.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons")
