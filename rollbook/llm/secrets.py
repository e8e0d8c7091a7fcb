"""Secret scans: base spans by pattern, weak spans by linking parts of one credential.

Base spans (assignments, access identifiers, long hex runs) are always reported. Weak candidates
(user names, opaque strings, endpoints) are reported only where a complementary part stands within
their scope, `scope` code points to either side: a secret for a user name or an endpoint, a user
name, access identifier or endpoint for an opaque string. The parts of all texts are joined as
intervals: each is dealt to the blocks of `scope` code points that it touches, so that a join on
(row, block) meets every pair within reach and no others but those of neighbouring blocks. A weak
span that overlaps a base span is none, which the same join tells.

Positions and masks are folds over the matches in stretches, so that a very long text with very many
matches costs about its length for each STRETCH of them, not for each match.

Column functions only. Null texts count as empty. Rows are told apart by two hashes of id and
text, so that repeated rows get the same result and a null id is an id like any other. Columns of
the input with names used here do no harm: only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.columns import let
from rollbook.session import materialize

# The patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# The patterns of the weak kinds.
USER = r"""((?i:username|user|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = (r"(?:https?|postgres|postgresql|mysql|mongodb|redis|amqp|ftp|s3)://[A-Za-z0-9][A-Za-z0-9.:@/_-]*"
            r"|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{2,5})?")
KINDS = ["assign", "access", "hex", "user", "opaque", "endpoint"]
BASE_KINDS = KINDS[:3]
SECRET_KINDS = ["assign", "hex", "opaque"]

#: Matches that one inner aggregate takes.
STRETCH = 512

_SPAN = "struct<start:int,rank:int,end:int>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _stretches(items: Column) -> Column:
    """`items`, not empty, cut into arrays of at most STRETCH.

    An aggregate copies the array it appends to; over stretches the copies stay short.
    """
    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STRETCH).cast("int"))
    return F.transform(numbers, lambda i: F.slice(items, i * STRETCH + 1, STRETCH))


def _mixed(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def _spans(text: Column, pattern: str, rank: int, value_group: int | None = None, least: int = 0,
           holds: Callable[[Column], Column] | None = None) -> Column:
    """Spans (start, rank of kind, end) of the matches that pass, in code points.

    Matches do not tell where they stand; the lengths of what lies between them does.
    """
    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        passes = F.length(x["value"]) >= least
        if holds:
            passes = passes & holds(x["value"])
        kept = F.when(passes, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    def located(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
        steps = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), values.alias("value"))

        def stretch(acc: Column, part: Column) -> Column:
            begin = F.struct(acc["at"].alias("at"), F.expr(_NONE).alias("spans"))
            return let(F.aggregate(part, begin, step), lambda done: F.struct(
                done["at"].alias("at"), F.array_append(acc["parts"], done["spans"]).alias("parts")))

        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{_SPAN}>>)").alias("parts"))
        return let(steps, lambda all_: F.aggregate(
            _stretches(all_), start, stretch, lambda acc: F.flatten(acc["parts"])))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, located(found)).otherwise(F.expr(_NONE)))


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _keys(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row_a, row_b, id, text): two hashes that stand for id and whole text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.xxhash64(F.lit("a"), F.col(id_column), text).alias("row_a"),
        F.xxhash64(F.lit("b"), text, F.col(id_column)).alias("row_b"),
        F.col(id_column).alias("id"), text.alias("text"))


def _blocks(first: Column, last: Column, scope: int) -> Column:
    """The blocks of `scope` code points from that of `first` to that of `last`."""
    return F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope)))


def _parts(scanned: DataFrame, column: str) -> DataFrame:
    """(row_a, row_b, s): the spans of a column, one row each."""
    return scanned.select("row_a", "row_b", F.explode(column).alias("s")).distinct()


def _apart(scanned: DataFrame, scope: int) -> DataFrame:
    """(row_a, row_b, s): weak spans that overlap no base span."""
    weak = _parts(scanned, "weak")
    base = _parts(scanned.where(F.size("weak") > 0), "base").withColumnRenamed("s", "o")
    placed = weak.select("*", _blocks(F.col("s.start"), F.col("s.end") - 1, scope).alias("block"))
    others = base.select("*", _blocks(F.col("o.start"), F.col("o.end") - 1, scope).alias("block"))
    covered = (placed.join(others, ["row_a", "row_b", "block"])
               .where((F.col("o.start") < F.col("s.end")) & (F.col("s.start") < F.col("o.end")))
               .select("row_a", "row_b", "s").distinct())
    return weak.join(covered, ["row_a", "row_b", "s"], "left_anti")


def _linked(scanned: DataFrame, scope: int) -> DataFrame:
    """(row_a, row_b, linked): weak spans apart from base spans with a complementary part in their scope."""
    secret = [KINDS.index(k) for k in SECRET_KINDS]
    apart = materialize(_apart(scanned, scope), "secret-weak")
    weak = apart.select(
        "row_a", "row_b", "s", F.col("s.rank").isin(secret).alias("is_secret"),
        _blocks(F.col("s.start") - scope, F.col("s.end") + scope - 1, scope).alias("block"))
    every = apart.union(_parts(scanned.where(F.size("weak") > 0), "base")).withColumnRenamed("s", "o").select(
        "row_a", "row_b", "o", F.col("o.rank").isin(secret).alias("other_secret"),
        _blocks(F.col("o.start"), F.col("o.end") - 1, scope).alias("block"))
    near = (F.col("o.start") < F.col("s.end") + scope) & (F.col("o.end") > F.col("s.start") - scope)
    return (weak.join(every, ["row_a", "row_b", "block"])
            .where(near & (F.col("is_secret") != F.col("other_secret")))
            .select("row_a", "row_b", "s").distinct()
            .groupBy("row_a", "row_b").agg(F.sort_array(F.collect_list("s")).alias("linked")))


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                 scope: int = 200) -> DataFrame:
    """(row_a, row_b, id, base, spans) for every row: arrays of (start, rank, end), in order.

    `rank` is a place in KINDS; positions count code points, the end is exclusive.
    """
    keyed = _keys(docs, id_column, text_column)
    text = F.col("text")
    base = F.sort_array(F.concat(
        _spans(text, ASSIGN, 0, 2, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    # [A-Za-z0-9] runs of 20 and the words before an assignment are rare: tests that cost little come first.
    weak = F.concat(
        F.when(text.rlike(USER), _spans(text, USER, 3)).otherwise(F.expr(_NONE)),
        F.when(text.rlike(OPAQUE), _spans(text, OPAQUE, 4, holds=_mixed)).otherwise(F.expr(_NONE)),
        F.when(text.rlike(ENDPOINT), _spans(text, ENDPOINT, 5)).otherwise(F.expr(_NONE)))
    found = keyed.select("row_a", "row_b", "id", base.alias("base"), weak.alias("weak"))
    scanned = materialize(found, "secret-parts")
    linked = _linked(scanned, scope)
    return scanned.join(linked, ["row_a", "row_b"], "left").select(
        "row_a", "row_b", "id", "base",
        F.when(F.col("linked").isNull(), F.col("base"))
        .otherwise(F.sort_array(F.concat("base", "linked"))).alias("spans"))


def secret_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                  scope: int = 200) -> DataFrame:
    """Counts of each base kind, a digest of the base spans and the list of all spans."""
    found = secret_spans(docs, id_column, text_column, scope=scope)

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        F.col("id").alias(id_column),
        *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
             scope: int = 200, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every reported span replaced by `mark`; overlapping spans give one mark."""
    hits = (secret_spans(docs, id_column, text_column, scope=scope).where(F.size("spans") > 0)
            .select(F.col("row_a").alias("secret_row_a_"), F.col("row_b").alias("secret_row_b_"),
                    F.col("spans").alias("secret_spans_")).dropDuplicates(["secret_row_a_", "secret_row_b_"]))
    text = F.coalesce(F.col(text_column), F.lit(""))
    keyed = docs.withColumn("secret_row_a_", F.xxhash64(F.lit("a"), F.col(id_column), text)).withColumn(
        "secret_row_b_", F.xxhash64(F.lit("b"), text, F.col(id_column)))
    none = F.expr("cast(array() as array<string>)")

    def masked_text(spans: Column) -> Column:
        def stretch(acc: Column, part: Column) -> Column:
            """Append the text from `at` to the last end in `part`, with marks; only this stretch is read again."""
            last = F.greatest(F.array_max(F.transform(part, lambda s: s["end"])), acc["at"])

            def within(piece: Column) -> Column:
                def step(inner: Column, s: Column) -> Column:
                    kept = F.concat(F.substring(
                        piece, inner["at"] - acc["at"] + 1, s["start"] - inner["at"]), F.lit(mark))
                    return F.when(s["start"] >= inner["at"], F.struct(
                        s["end"].alias("at"), F.array_append(inner["parts"], kept).alias("parts"))).otherwise(
                            F.struct(F.greatest(s["end"], inner["at"]).alias("at"), inner["parts"].alias("parts")))

                begin = F.struct(acc["at"].alias("at"), none.alias("parts"))
                return let(F.aggregate(part, begin, step), lambda done: F.struct(
                    done["at"].alias("at"),
                    F.array_append(acc["parts"], F.array_join(done["parts"], "")).alias("parts")))

            return let(F.substring(text, acc["at"] + 1, last - acc["at"]), within)

        start = F.struct(F.lit(0).alias("at"), none.alias("parts"))
        return F.aggregate(_stretches(spans), start, stretch, lambda acc: F.concat(
            F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))

    masked = masked_text(F.col("secret_spans_"))
    joined = keyed.join(hits, ["secret_row_a_", "secret_row_b_"], "left")
    return joined.withColumn(text_column, F.when(F.col("secret_spans_").isNull(), F.col(text_column)).otherwise(masked)).select(docs.columns)
