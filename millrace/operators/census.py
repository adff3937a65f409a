"""A census of a bound input: its lines parsed strictly, cleaned, counted, hashed and scored, and the binding checked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: the field that only a selection may write
RESERVED = "selection"
COUNTERS = ("physical_rows", "excluded_rows", "empty_text", "empty_after_cleaning", "eligible_rows")


class CensusError(RuntimeError):
    """An input that isn't the one that was bound, or that holds what it may not hold."""


@dataclass(frozen=True)
class Binding:
    """What an input was when it was bound: its rows, how many of them are excluded, and the digest of its lines."""

    rows: int
    excluded: int
    digest: str


def multiset_digest(rows: DataFrame, line: str) -> DataFrame:
    """One row, `digest`: SHA-256 of the count and of the sums of four 60-bit parts of each line's SHA-256.

    Sums don't mind the order of lines, nor how they are dealt; lines that repeat count again.
    """
    h = F.sha2(F.col(line), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(part(k), F.lit(0)).alias(f"s{k}") for k in range(4)])
    return sums.select(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")]), 256).alias("digest"))


def census(
    lines: DataFrame,
    excluded: DataFrame,
    binding: Binding,
    clean: Callable[[Column], Column],
    tokens: Callable[[Column], Column],
    fingerprint: Callable[[Column], Column],
    text_field: str = "text",
    integer_score: str | None = None,
    score: str | None = None,
    least_chars: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """(records, counters) of `lines` (row_index, raw) without the rows of `excluded` (row_index).

    A record has row_index, cleaned_sha256, fingerprint, tokens (with two boundary tokens), raw_sha256, record_sha256 (of
    the line), int_score and score. Lines are JSON objects: malformed ones and repeated keys, the reserved field, a
    text that is missing or no string, and a score that isn't a (finite) number of its kind raise CensusError or
    Spark's own error with the row, and nothing of a broken input comes out. Empty texts, and those with fewer than
    `least_chars` after cleaning, are counted and left out; score fields are literal names, dots and all. An input with
    other rows, another digest or exclusions that aren't all rows of it raises, before any record is made.
    """
    excluded = excluded.select("row_index").distinct()
    own = excluded.join(lines.select("row_index"), "row_index", "left_semi").count()
    rows = lines.count()
    found = Binding(rows, own, multiset_digest(lines, "raw").first()["digest"])
    if excluded.count() != binding.excluded or found != binding:
        raise CensusError(f"bound {binding}, found {found}")
    left = lines.join(excluded, "row_index", "left_anti").select("row_index", "raw", F.parse_json("raw").alias("v"))
    at = lambda name, kind: F.try_variant_get("v", f'$["{name}"]', kind)
    stop = lambda said: F.raise_error(F.concat(F.lit(f"CensusError: {said} in row "), F.col("row_index").cast("string")))
    is_kind = lambda name, pattern: F.coalesce(F.schema_of_variant(at(name, "variant")).rlike(pattern), F.lit(False))

    def number(name: str | None, kind: str, pattern: str) -> Column:
        if name is None:
            return F.lit(None).cast(kind)
        none = at(name, "variant").isNull() | (F.schema_of_variant(at(name, "variant")) == "VOID")
        return F.when(none, F.lit(None).cast(kind)).when(~is_kind(name, pattern), stop(f"{name} is no number of its kind").cast(kind)).otherwise(at(name, kind))

    text = (
        F.when(~F.schema_of_variant("v").startswith("OBJECT"), stop("no object"))
        .when(at(RESERVED, "variant").isNotNull(), stop("reserved field"))
        .when(~is_kind(text_field, "^STRING$"), stop(f"{text_field} is missing or no string"))
        .otherwise(at(text_field, "string"))
    )
    checked = left.select("row_index", "raw", text.alias("text"), number(integer_score, "long", "^BIGINT$").alias("int_score"), number(score, "double", "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$").alias("score"))
    cleaned = checked.withColumn("cleaned", clean(F.col("text")))
    enough = F.coalesce(F.length("cleaned") >= least_chars, F.lit(False)) & (F.col("cleaned") != "")
    state = F.when(F.col("text") == "", "empty_text").when(~enough, "empty_after_cleaning").otherwise("eligible_rows")
    told = cleaned.withColumn("state", state)
    counted = told.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    fixed = lines.sparkSession.createDataFrame([("physical_rows", rows), ("excluded_rows", own)], "state string, n long")
    every = lines.sparkSession.createDataFrame([(c,) for c in COUNTERS], "counter string")
    counters = every.join(counted.unionByName(fixed).withColumnRenamed("state", "counter"), "counter", "left").select("counter", F.coalesce("n", F.lit(0)).alias("n"))
    records = told.where("state = 'eligible_rows'").select(
        "row_index", F.sha2("cleaned", 256).alias("cleaned_sha256"), fingerprint(F.col("cleaned")).alias("fingerprint"), (tokens(F.col("cleaned")) + 2).cast("long").alias("tokens"),
        F.sha2("text", 256).alias("raw_sha256"), F.sha2("raw", 256).alias("record_sha256"), "int_score", (F.col("score") + F.lit(0.0)).alias("score"),
    )
    return records, counters
