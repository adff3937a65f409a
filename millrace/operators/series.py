"""Series by step: moving averages as an associative scan, metric logs in long form, comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 512  # steps of a chunk; chunks of a run of chunks
SHORT = 200  # series of so many values are shown as they are

# fixed values: what a log line has besides its metrics
SKIPPED = ("kind", "step", "time")


def _starts(pairs: DataFrame, firsts: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """(keys, k, start): the average before chunk k, from the maps x -> a x + b of all chunks before it.

    Runs of `fan` chunks are composed into one map and settled first, so no list is longer than `fan`.
    """
    most = pairs.agg(F.max("_c")).first()[0] or 0
    listed = pairs.withColumn("_g", F.expr(f"_c div {fan}")).groupBy(*keys, "_g").agg(F.sort_array(F.collect_list(F.struct("_c", "_a", "_b"))).alias("_maps"))
    if most < fan:
        listed = listed.join(firsts.withColumnRenamed("_first", "_start"), keys)
    else:
        one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        whole = F.aggregate("_maps", one, lambda s, m: F.struct((m["_a"] * s["a"]).alias("a"), (m["_a"] * s["b"] + m["_b"]).alias("b")))
        upper = listed.select(*keys, F.col("_g").alias("_c"), whole.alias("w")).select(*keys, "_c", F.col("w.a").alias("_a"), F.col("w.b").alias("_b"))
        listed = listed.join(_starts(upper, firsts, keys, fan).withColumnRenamed("_c", "_g"), [*keys, "_g"])
    empty = F.array().cast("array<double>")
    state = F.struct(F.col("_start").alias("x"), empty.alias("out"))
    scan = F.aggregate("_maps", state, lambda s, m: F.struct((m["_a"] * s["x"] + m["_b"]).alias("x"), F.concat(s["out"], F.array(s["x"])).alias("out")), lambda s: s["out"])
    rows = listed.select(*keys, F.explode(F.arrays_zip("_maps", scan.alias("out"))).alias("z"))
    return rows.select(*keys, F.col("z._maps._c").alias("_c"), F.col("z.out").alias("_start"))


def moving_average(rows: DataFrame, keys: list[str], step: str, value: str, beta: float = 0.9, tie: str | None = None, fan: int = CHUNK) -> DataFrame:
    """(keys, step, value, ema) of every row whose value isn't null: ema = beta * the one before + (1 - beta) * value, beginning with the first value.

    Rows go by step, those of one step by `tie` and value. A chunk of steps is a map x -> a x + b, and maps
    compose, so chunks are settled apart from each other and only their maps are chained: a task holds
    the rows of `fan` steps of one series, or `fan` maps. Null keys aren't taken.
    """
    kept = rows.where(F.col(value).isNotNull())
    order = F.struct(F.col(step).alias("step"), (F.col(tie) if tie else F.lit(0)).alias("tie"), F.col(value).cast("double").alias("value"))
    chunks = kept.groupBy(*keys, F.expr(f"`{step}` div {fan}").alias("_c")).agg(F.sort_array(F.collect_list(order)).alias("_v"))
    b = F.aggregate("_v", F.lit(0.0), lambda x, r: F.lit(beta) * x + F.lit(1 - beta) * r["value"])
    pairs = chunks.select(*keys, "_c", F.pow(F.lit(beta), F.size("_v")).alias("_a"), b.alias("_b"))
    firsts = kept.groupBy(*keys).agg(F.min(order)["value"].alias("_first"))
    joined = chunks.join(_starts(pairs, firsts, keys, fan), [*keys, "_c"])
    state = F.struct(F.col("_start").alias("x"), F.array().cast("array<double>").alias("out"))

    def step_on(s, r):
        x = F.lit(beta) * s["x"] + F.lit(1 - beta) * r["value"]
        return F.struct(x.alias("x"), F.concat(s["out"], F.array(x)).alias("out"))

    out = joined.select(*keys, F.explode(F.arrays_zip("_v", F.aggregate("_v", state, step_on, lambda s: s["out"]).alias("ema"))).alias("z"))
    return out.select(*keys, F.col("z._v.step").alias("step"), F.col("z._v.value").alias("value"), F.col("z.ema").alias("ema"))


def metric_rows(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ("run",)) -> DataFrame:
    """(keep, kind, step, time, field, value): a row for each number of a metric log's JSON lines.

    Malformed lines, lines that aren't objects and lines without a whole step are left out; a line without a kind is
    `val` if it has a val_loss, else `train`. Booleans, texts and nulls aren't metrics.
    """
    v = lines.select(*keep, F.try_parse_json(column).alias("v")).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    kind = F.coalesce(get("$.kind", "string"), F.when(get("$.val_loss", "variant").isNotNull(), "val").otherwise("train"))
    rows = v.select(*keep, kind.alias("kind"), get("$.step", "long").alias("step"), F.coalesce(get("$.time", "double"), F.lit(0.0)).alias("time"), F.explode(F.map_entries(get("$", "map<string, variant>"))).alias("e"))
    number = F.schema_of_variant(F.col("e.value")).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return rows.where(F.col("step").isNotNull() & ~F.col("e.key").isin(*SKIPPED) & number).select(*keep, "kind", "step", "time", F.col("e.key").alias("field"), F.try_variant_get("e.value", "$", "double").alias("value"))


def compare_runs(metrics: DataFrame, run: str = "run", beta: float = 0.9) -> DataFrame:
    """(field, label, step, shown): each run's curve of each field: its `val` rows if it has any, else all kinds.

    The label is the run, with the kind if several are shown. Series of more than 200 values are shown as moving averages.
    """
    size = metrics.groupBy("field", run, "kind").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("field", run)  # a row for each kind
    chosen = size.withColumn("val", F.max((F.col("kind") == "val").cast("int")).over(one)).where("val = 0 or kind = 'val'")
    chosen = chosen.withColumn("kinds", F.count(F.lit(1)).over(one))
    label = F.when(F.col("kinds") == 1, F.col(run).cast("string")).otherwise(F.concat_ws("/", F.col(run).cast("string"), "kind"))
    chosen = chosen.select("field", run, "kind", label.alias("label"), (F.col("n") > SHORT).alias("long"))
    curves = moving_average(metrics, ["field", run, "kind"], "step", "value", beta, "time")
    return curves.join(chosen, ["field", run, "kind"]).select("field", "label", "step", F.when(F.col("long"), F.col("ema")).otherwise(F.col("value")).alias("shown"))
