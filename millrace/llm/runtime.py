"""What the operators share: the shared folder, materialised tables, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made and set for the
    session's life, in local mode only: on a cluster its machines would write to
    different disks, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


BROADCAST_EDGES = 200_000  # of two longs: 6 MB at most


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark then deletes a statement's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends there,
    and a lost executor costs a reread instead of the whole plan. The shuffle files of the write go with it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._millrace_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what `materialise` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_millrace_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            df._millrace_path = None


def bounded(df: DataFrame, most: int, lists: str | None = None) -> DataFrame:
    """Broadcast a materialised table if its rows, and entries of its lists, are counted to be at most
    `most`; a shuffled join otherwise."""
    entries = df.agg(F.sum(F.size(lists) + 1 if lists else F.lit(1))).first()[0] or 0
    return F.broadcast(df) if entries <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or the first like it that isn't the name of a column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that an edge names; component is the smallest id. The table is materialised.

    Alternating large-star and small-star steps: each round hangs every node's
    larger neighbours, then its smaller ones, below its smallest neighbour, and
    drops repeated edges, so a star of any size shrinks to one row for each leaf
    in O(log n) rounds. Each round is written to the shared folder. Self loops and
    edges with a null end are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(e)
    while True:
        # few edges: minima are broadcast; many: they are written first, so that Spark can split the rows of a star's centre
        held: list[DataFrame] = []

        def side(df: DataFrame, name: str, few: bool = state[0] <= BROADCAST_EDGES, held: list = held) -> DataFrame:
            if few:
                return F.broadcast(df)
            held.append(materialise(df, name))
            return held[-1]

        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = side(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        # large star: larger neighbours v > u go below m
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        if state[0] > BROADCAST_EDGES:
            held.append(large := materialise(large, "large"))
        # small star: smaller neighbours v <= u, and u itself, go below their smallest
        low = side(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        new = materialise(large.join(low, "u").select(F.explode(ends).alias("x")).select("x.*").where("u <> v").distinct(), "edges")
        now = _state(new)
        discard(e, *held)
        e = new
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = materialise(e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots), "components")
    discard(e)
    return out


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets; one small row to the driver."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s"),
    ).first()
    return row["n"], row["s"]
