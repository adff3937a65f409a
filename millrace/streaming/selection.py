"""Selection by a stream: each source keeps the rows of least rank that reach its target, and gives up those beyond."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import select as S

CHANGES = "source string, bin string, rank string, doc_id long, tokens long, kept boolean"


class PrefixKeeper(StatefulProcessor):
    """Keyed state of one bin of a source's ranks: what is kept, by rank.

    A row is probed first: the same rank again is the same text, of which the smallest doc_id stays. Others are
    inserted, and ranks beyond the prefix that reaches the target are evicted; they can't come back, as the
    prefix only ever ends earlier. So the state holds a target's worth of rows, whatever arrives.
    """

    def __init__(self, target: int):
        self.target = target

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("kept", "rank string", "doc_id long, tokens long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = {k[0]: (v[0], v[1]) for k, v in self.state.iterator()}
        before = dict(kept)
        for frame in rows:
            for rank, doc_id, tokens in zip(frame["rank"], frame["doc_id"].tolist(), frame["tokens"].tolist()):
                if rank not in kept or doc_id < kept[rank][0]:
                    kept[rank] = (doc_id, tokens)
            total, inside = 0, {}
            for rank in sorted(kept):
                if total >= self.target:
                    break
                inside[rank] = kept[rank]
                total += kept[rank][1]
            kept = inside
        out = []
        for rank, value in before.items():
            if rank not in kept:
                self.state.removeKey((rank,))
                out.append((*key, rank, *value, False))
        for rank, value in kept.items():
            if before.get(rank) != value:
                self.state.updateValue((rank,), value)
                out.append((*key, rank, *value, True))
        yield pd.DataFrame(out, columns=["source", "bin", "rank", "doc_id", "tokens", "kept"])

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession):
    """Keyed state with maps needs this store, which then commits changes instead of whole files; the session's own choice comes back afterwards."""
    store = "spark.sql.streaming.stateStore"
    wanted = {f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{store}.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def keep_prefixes(spark: SparkSession, arrivals: DataFrame, target: int, log: str, checkpoint: str) -> None:
    """Take what has arrived of a stream (source, rank, doc_id, tokens), appending each change to the table at `log`.

    A source is split by the first digit of its ranks, so a hot one has sixteen tasks, each of which keeps
    at least its part of the source's prefix. A run that is stopped goes on at its checkpoint.
    """
    keyed = arrivals.select(F.coalesce("source", F.lit("")).alias("source"), F.left("rank", F.lit(1)).alias("bin"), "rank", "doc_id", "tokens").groupBy("source", "bin")
    with _rocksdb(spark):
        changes = keyed.transformWithStateInPandas(PrefixKeeper(target), outputStructType=CHANGES, outputMode="Append", timeMode="None")
        changes.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def kept_rows(log: DataFrame, target: int) -> DataFrame:
    """(source, rank, doc_id, tokens, running): each source's prefix, from the changes so far."""
    rows = log.groupBy("source", "rank").agg(F.bool_and("kept").alias("kept"), F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    left = rows.where("kept").drop("kept").withColumn("target", F.lit(target))
    return S.prefix_by_quota(left, "source", ["rank", "doc_id"], "tokens", "target").drop("target")
