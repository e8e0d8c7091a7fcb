"""The operators of this subpackage as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import classifier, oracle, sentence_pieces, vector_codes
from rollbook.llm.curves import nearest
from rollbook.llm.html_text import extracted
from rollbook.llm.line_dedup import line_dedup
from rollbook.llm.near_dup import near_duplicates
from rollbook.llm.neighbour_graph import linked_vectors
from rollbook.llm.packing import packed
from rollbook.llm.quality_rules import quality_rules
from rollbook.llm.ranked_search import ranked
from rollbook.llm.secrets import secret_report
from rollbook.llm.suffixes import substring_dedup

ACCEPTED = 0.3


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated windows of three lines leave of each document."""
    done = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "n_spans",
                       F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether decoding them gives the text again."""
    model = tokenizer_path("piece_bpe_32k.model")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    there = sentence_pieces.decoded(sentence_pieces.encoded(docs, model), model)
    return there.select(
        "doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: base spans and weak ones with a complementary part near by."""
    return secret_report(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document and its verdict by thresholds per language and source."""
    return quality_rules(_table(spark, sf_dir, "documents")).drop("reasons")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document by attention over its passages."""
    docs = _table(spark, sf_dir, "documents")
    model = classifier.fit(docs, _table(spark, sf_dir, "labels"))
    score = F.col("score")
    return classifier.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", classifier.held_out().alias("held_out"), "score",
        F.when(score >= ACCEPTED, 1).otherwise(0).alias("predicted"))


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, by inner product."""
    return nearest(_table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without 50-byte strings that earlier documents have."""
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates: four-word shingles, a similarity of 0.8."""
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 4096 tokens as the scheme finds."""
    return packed(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each vector within its label at a cosine of 0.93, and their components."""
    return linked_vectors(_table(spark, sf_dir, "embeddings"))[0]


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of eight parts for each vector, with errors and a digest of the codebooks."""
    codes, books = vector_codes.compressed(_table(spark, sf_dir, "embeddings"))
    by_label = codes.groupBy(F.col("label").alias("of_label")).agg(vector_codes.long_sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_line_dedup, op2_html_extraction, op3_sentence_pieces, op4_secret_scan, op5_quality_rules,
        op6_quality_classifier, op7_hilbert_neighbours, op8_suffix_array_dedup, op9_minhash_near_dup,
        op10_best_fit_packing, op11_neighbour_graph, op12_ranked_search, op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
