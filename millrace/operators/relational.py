"""Joins that Spark lacks a word for: as-of, interval overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str]) -> DataFrame:
    """`left` with `values` of the last right row at or before its own time, by key; nulls if there is none.

    Both sides are laid in one order per key, and the last right row is carried
    forward: one shuffle, no range join. Right rows at the same time: the last by values.
    """
    l = left.select("*", F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("int").alias("_x"))
    r = right.select(*keys, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both = l.drop("_x").unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return carried.where("_side = 1").select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def overlap(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], width: int) -> DataFrame:
    """Pairs of half-open intervals [a, b) that overlap, by key; each side is laid into buckets of `width`
    and joined on equal buckets; a pair counts in the bucket where the later of both begins."""
    cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.greatest(F.col(a), F.col(b) - 1)) / width)))
    x, y = left.withColumn("_b", cover(*l)), right.withColumn("_b", cover(*r))
    joined = x.join(y, [*keys, "_b"]).where((F.col(l[0]) < F.col(r[1])) & (F.col(r[0]) < F.col(l[1])))
    return joined.where(F.col("_b") == F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width)).drop("_b")
