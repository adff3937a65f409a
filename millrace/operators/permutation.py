"""Epoch orders by arithmetic: a keyed bijection of 0..n-1, positions that can be resumed, and their log.

The bijection is the swap-or-not shuffle: in each round a number may change places with its
partner (key - x) mod n, and a hash of the larger of the two says whether. Every round is its own
inverse and stays within 0..n-1 whatever n is, so a position gives its row and a row its position without
a sort, a table or a walk; rows are made where they are needed.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 32


def round_keys(n: int, seed: int, epoch: int, rounds: int = ROUNDS) -> list[int]:
    return [int(hashlib.md5(f"{seed}:{epoch}:{r}".encode()).hexdigest()[:15], 16) % n for r in range(rounds)]


def permuted(x: Column, n: int, seed: int, epochs: range, epoch: Column, inverse: bool = False, rounds: int = ROUNDS) -> Column:
    """Where `x` of 0..n-1 goes in an epoch's order; with `inverse` what is at place `x`. `epochs` holds the values of `epoch`."""
    keys = F.array(*[F.array(*[F.lit(k).cast("long") for k in round_keys(n, seed, e, rounds)]) for e in epochs])
    own = F.element_at(keys, (epoch - epochs.start + 1).cast("int"))
    order = F.sequence(F.lit(rounds - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.element_at(own, r + 1) + F.lit(n) - at, F.lit(n).cast("long"))
        coin = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), r.cast("string"), F.greatest(at, partner).cast("string")))
        return F.when(F.left(coin, F.lit(1)) < "8", partner).otherwise(at)

    return F.aggregate(order, x.cast("long"), swap)


@dataclass(frozen=True)
class Plan:
    """A range of positions over repeated epochs of `data_length` rows, and how far it has been used."""

    data_length: int
    seed: int
    start: int
    committed: int
    end: int

    def __post_init__(self):
        if self.data_length <= 0:
            raise ValueError("an order needs at least one row")
        if not 0 <= self.start <= self.committed <= self.end:
            raise ValueError(f"positions must ascend: start {self.start}, committed {self.committed}, end {self.end}")

    def commit(self, n: int) -> Plan:
        """The plan after `n` more rows were used; rows that were only issued don't count."""
        if n < 0 or self.committed + n > self.end:
            raise ValueError(f"can't commit {n} rows from {self.committed} with end {self.end}")
        return replace(self, committed=self.committed + n)


def planned_rows(spark: SparkSession, plan: Plan, most: int | None = None) -> DataFrame:
    """(position, epoch, place) of the positions that aren't committed, the next `most` of them if given.

    Within an epoch no place comes twice. The plan is a range and arithmetic: no exchange.
    """
    end = plan.end if most is None else min(plan.end, plan.committed + most)
    epochs = range(plan.committed // plan.data_length, max(end - 1, plan.committed) // plan.data_length + 1)
    rows = spark.range(plan.committed, end).select(F.col("id").alias("position"), F.expr(f"id div {plan.data_length}L").alias("epoch"))
    offset = F.col("position") - F.col("epoch") * F.lit(plan.data_length)
    return rows.select("position", "epoch", permuted(offset, plan.data_length, plan.seed, epochs, F.col("epoch"), inverse=True).alias("place"))


def positions_of(rows: DataFrame, place: str, n: int, seed: int, epoch: int) -> DataFrame:
    """`rows` with `position`: where each place comes in an epoch."""
    e = F.lit(epoch).cast("long")
    return rows.withColumn("position", e * F.lit(n) + permuted(F.col(place), n, seed, range(epoch, epoch + 1), e))


def fixed_subset(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    """(stratum, place): one row of each of `k` equal strata of 0..n-1, the same ones for the same seed."""
    if not 0 <= k <= n:
        raise ValueError(f"a subset of {n} rows can't have {k}")
    edge = lambda i: F.expr(f"cast(({i}) as decimal(38,0)) * {n} div {max(k, 1)}")
    draw = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("subset"), F.col("id").cast("string"))), F.lit(15)), 16, 10).cast("long")
    return spark.range(k).select(F.col("id").alias("stratum"), (edge("id") + F.pmod(draw, edge("id + 1") - edge("id"))).alias("place"))


class PositionLog:
    """Committed plans in a folder of the shared file system, one entry a commit, each written whole or not at all.

    An entry is a folder named by its number; making one that exists fails, so of two writers that
    commit from the same state one is refused. An entry without its success mark is a commit that broke off.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entries(self) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at(self.path))]
        return sorted(int(x) for x in names if x.isdigit() and self._fs.exists(self._at(f"{self.path}/{x}/_SUCCESS")))

    def latest(self) -> Plan | None:
        entries = self._entries()
        if not entries:
            return None
        row = self.spark.read.schema("data_length long, seed long, start long, committed long, end long").json(f"{self.path}/{entries[-1]:012d}").first()
        return Plan(**row.asDict())

    def append(self, plan: Plan) -> None:
        """Log a plan; it must go on from the latest one."""
        entries, before = self._entries(), self.latest()
        if before and (replace(before, committed=plan.committed) != plan or plan.committed < before.committed):
            raise ValueError(f"{plan} doesn't go on from {before}")
        number = entries[-1] + 1 if entries else 0
        left = self._at(f"{self.path}/{number:012d}")
        if self._fs.exists(left) and not self._fs.exists(self._at(f"{self.path}/{number:012d}/_SUCCESS")):
            self._fs.delete(left, True)
        rows = self.spark.createDataFrame([tuple(asdict(plan).values())], "data_length long, seed long, start long, committed long, end long")
        rows.coalesce(1).write.mode("errorifexists").json(f"{self.path}/{number:012d}")
