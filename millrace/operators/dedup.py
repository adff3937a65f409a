"""Exact and near duplicates, overlap with protected texts, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import removed, shared_folder, written


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first by `order`, which takes the place of arrival order. Null keys are one key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def representatives(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each key, the least by `order`, by aggregation: a hot key is combined before the shuffle."""
    rest = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.min_by(rest, F.struct(*order)).alias("_r")).select(key, "_r.*")


def disagreements(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys with more than one value of a column that should depend on the key."""
    found = df.groupBy(key).agg(F.min(column).alias("a"), F.max(column).alias("z"), F.count(F.lit(1)).alias("n"))
    return found.where(~F.col("a").eqNullSafe(F.col("z"))).select(key, "n")


BROADCAST_GRAMS = 200_000  # of some 100 bytes each


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), "")


def shingles(words: Column, n: int) -> Column:
    """Distinct n-word shingles; none if there are fewer words."""
    made = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def shingle_places(df: DataFrame, key: str, text: str, n: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, extra, shingle): a row for each place of a shingle; shingles are made row by row, not as an array."""
    words = df.select(key, *extra, tokens(F.col(text)).alias("_w")).where(F.size("_w") >= n)
    at = words.select(key, *extra, "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - n + 1)).alias("_i"))
    return at.select(key, *extra, F.array_join(F.slice("_w", F.col("_i"), n), " ").alias("shingle"))


def shingle_rows(df: DataFrame, key: str, text: str, n: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, extra, shingle): a row for each distinct shingle."""
    return shingle_places(df, key, text, n, extra).distinct()


SHARED = 0.4  # of the shingles that similar sets may differ by: how many more are looked at, to be shared
PART = 2_000_000  # shingles of a part, about
BATCH = 2_000_000  # shingles of a batch
MOST_LIVE = 2_000_000  # of a long each
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 500_000
DENSE = 64  # increments of a cell cost as much as this many of a matrix product


def word_hashes(df: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """(key, _id, _g, _w): 64-bit hashes of the key, of the group, and of the words in their order; a null group is the row's own."""
    own = F.coalesce(F.when(F.col(group).isNotNull(), F.xxhash64(group)), F.xxhash64(F.lit("no group"), key))
    return df.where(F.col(key).isNotNull()).select(key, F.xxhash64(key).alias("_id"), own.alias("_g"), F.transform(tokens(F.col(text)), lambda x: F.xxhash64(x)).alias("_w"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sets(batches, n: int):
    """(batch, values, sizes): batches of `word_hashes`, cut to some BATCH words, less rows of under n words; the distinct n-word shingles of each row in the order of their hashes."""
    for batch in batches:
        words = np.diff(batch["_w"].offsets.to_numpy()).astype(np.int64)
        cuts = np.cumsum(words) // BATCH + np.arange(len(words)) // 65_536
        for cut in np.unique(cuts[words >= n]):
            some = batch.take(pa.array(np.flatnonzero((cuts == cut) & (words >= n))))
            flat, sizes = _lists(some["_w"])
            made = sizes - n + 1
            ends = np.cumsum(made)
            at = np.repeat(np.cumsum(sizes) - sizes - ends + made, made) + np.arange(ends[-1])
            h = np.repeat(_mixed(some["_g"].to_numpy().view(np.uint64)), made)
            for j in range(n):
                h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) ^ flat.view(np.uint64)[at + j])
            rows = [np.unique(x) for x in np.split(h, ends[:-1])]
            yield some, np.concatenate(rows), np.array([len(x) for x in rows], np.int64)


def _set_rows(n: int, key: str):
    def go(batches):
        for some, values, sizes in _sets(batches, n):
            s = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([some[key], some["_again"], s], [key, "_again", "s"])

    return go


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _least(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """How many shingles sets of these sizes have in common with similar ones, at least."""
    return np.ceil(sizes * threshold - 1e-9).astype(np.int64)


def _dealt(n: int, threshold: float, parts: int):
    """Sets dealt by hash: of each the first shingles by hash, as 32 bits and the row's number in the batch."""

    def go(batches):
        for some, values, sizes in _sets(batches, n):
            least, again = _least(sizes, threshold), some["_again"].to_numpy(zero_copy_only=False)
            shared = np.minimum(least, 1 + (SHARED * (sizes - least)).astype(np.int64))
            most = np.where(again, sizes, sizes - least + shared)
            row = np.repeat(np.arange(len(sizes)), sizes)
            first = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < most[row]
            values, row = values[first], row[first]
            part = ((values >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, low, row = part[order], values[order].astype(np.uint32), row[order].astype(np.uint16)
            name = uuid.uuid4().hex
            ends = np.searchsorted(part, np.arange(parts + 1))
            used = np.flatnonzero(np.diff(ends))
            ids, need = some["_id"].to_numpy().tobytes(), np.where(again, 0, shared).tobytes()
            cells = [(int(p), name, low[ends[p] : ends[p + 1]].tobytes(), row[ends[p] : ends[p + 1]].tobytes(), ids if p == used[0] else None, need if p == used[0] else None) for p in used]
            types = (pa.int32(), pa.string(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cells), types)], ["part", "batch", "low", "row", "ids", "need"])

    return go


def _met(rows: pa.Table) -> pa.Table:
    """Of the shingles of a part, the rows of those that come twice."""
    lows = [np.frombuffer(x, np.uint32) for x in rows["low"].to_pylist()]
    flat, ends = np.concatenate(lows), np.cumsum([len(x) for x in lows])
    values, n = np.unique(flat, return_counts=True)
    twice = values[n > 1]
    hit = np.zeros(len(flat), bool)
    if len(twice):
        hit = twice[np.minimum(np.searchsorted(twice, flat), len(twice) - 1)] == flat
    hits = np.split(hit, ends[:-1])
    out = [np.frombuffer(x, np.uint16)[h].tobytes() for x, h in zip(rows["row"].to_pylist(), hits)]
    return pa.table({"batch": rows["batch"], "row": pa.array(out, pa.binary()), "ids": rows["ids"], "need": rows["need"]})


def _enough(rows: pa.Table) -> pa.Table:
    """The ids of a batch that share as many shingles as they need."""
    ids = np.frombuffer(next(x for x in rows["ids"].to_pylist() if x is not None), np.int64)
    need = np.frombuffer(next(x for x in rows["need"].to_pylist() if x is not None), np.int64)
    n = np.bincount(np.concatenate([np.frombuffer(x, np.uint16) for x in rows["row"].to_pylist()]), minlength=len(ids))
    return pa.table({"id": ids[n >= need]})


def similar_sets(df: DataFrame, key: str, text: str, group: str, n: int, threshold: float) -> DataFrame:
    """(key, s), written: the shingle sets of the keys that can be similar to another one; the rows of a key are one set.

    In any order, similar sets share l of their first x - ceil(threshold x) + l shingles.
    Of each set that many are dealt by hash, in six bytes each, and those that come twice
    are counted for it. What shares fewer than l is similar to none, and goes before a row is made of a shingle.
    """
    twice = written(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit(True).alias("_again")), "again")
    again = F.broadcast(twice) if twice.count() <= MOST_LIVE else twice
    words = lambda rows: word_hashes(rows, key, text, group).join(again, key, "left").select(key, "_id", "_g", "_w", F.coalesce("_again", F.lit(False)).alias("_again"))
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(12, chars // 8 // PART)
    dealt = words(df).mapInArrow(_dealt(n, threshold, parts), "part int, batch string, low binary, row binary, ids binary, need binary")
    met = dealt.groupBy("part").applyInArrow(_met, "batch string, row binary, ids binary, need binary")
    live = written(met.groupBy("batch").applyInArrow(_enough, "id long").distinct(), "live")
    if live.count() <= MOST_LIVE:  # before the texts are read as words
        found = words(df.join(F.broadcast(live.toDF("_live")), F.xxhash64(key) == F.col("_live"), "left_semi"))
    else:
        found = words(df).join(live.toDF("_id"), "_id", "left_semi").select(key, "_id", "_g", "_w", "_again")
    kind = dict(df.dtypes)[key]
    found = written(found.mapInArrow(_set_rows(n, key), f"`{key}` {kind}, _again boolean, s array<bigint>"), "found")
    whole = found.where("_again").groupBy(key).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    out = written(found.where("not _again").select(key, "s").unionByName(whole), "sets")
    removed(twice, live, found)
    return out


def equal_sets(sets: DataFrame, key: str) -> DataFrame:
    """(key, rep), written: the least key with the same set."""
    same = [F.xxhash64("s"), F.hash("s"), F.size("s")]
    rows = sets.select(key, *[c.alias(f"_{i}") for i, c in enumerate(same)])
    least = rows.groupBy("_0", "_1", "_2").agg(F.min(key).alias("rep"))
    return written(rows.join(least, ["_0", "_1", "_2"]).select(key, "rep"), "equal")


def _overlaps(threshold: float):
    """Similarities of the sets of two blocks, or within one, that reach the threshold."""

    def go(rows: pa.Table) -> pa.Table:
        ids, left = rows["id"].to_numpy(), rows["left"].to_numpy()
        within = rows["i"][0] == rows["j"][0]
        values, sizes = _lists(rows["s"])
        owner = np.repeat(np.arange(len(ids)), sizes)
        sides = [np.flatnonzero(left), np.flatnonzero(left if within else ~left)]
        common = np.zeros((len(sides[0]), len(sides[1])), np.int64)
        place = np.zeros(len(ids), np.int64)
        held = []
        for side in sides:
            place[side] = np.arange(len(side))
            mine = np.zeros(len(ids), bool)
            mine[side] = True
            at = np.flatnonzero(mine[owner])
            at = at[np.argsort(values[at], kind="stable")]
            held.append((values[at], place[owner[at]]))
        (va, a), (vb, b) = held
        both = np.intersect1d(va, vb)
        start_a, end_a = np.searchsorted(va, both), np.searchsorted(va, both, "right")
        start_b, end_b = np.searchsorted(vb, both), np.searchsorted(vb, both, "right")
        ka, kb = end_a - start_a, end_b - start_b
        dense = ka * kb * DENSE > common.size
        for x in np.array_split(np.flatnonzero(dense), max(1, int(dense.sum()) // 2048)):
            m = [np.zeros((len(side), len(x)), np.float32) for side in sides]
            for k, c in enumerate(x):
                m[0][a[start_a[c] : end_a[c]], k] = 1
                m[1][b[start_b[c] : end_b[c]], k] = 1
            common += (m[0] @ m[1].T).astype(np.int64)
        sparse = np.flatnonzero(~dense & (ka + kb > 2) if within else ~dense)
        made = np.cumsum(ka[sparse] * kb[sparse])
        for cut in np.split(sparse, np.searchsorted(made, np.arange(4_000_000, made[-1] if len(made) else 0, 4_000_000))):
            # each entry of the one side, as often as the shingle stands on the other
            times = np.repeat(kb[cut], ka[cut])
            one = np.repeat(start_a[cut] - np.cumsum(ka[cut]) + ka[cut], ka[cut]) + np.arange(ka[cut].sum())
            other = np.repeat(np.repeat(start_b[cut], ka[cut]) - np.cumsum(times) + times, times) + np.arange(times.sum())
            common += np.bincount(np.repeat(a[one], times) * common.shape[1] + b[other], minlength=common.size).reshape(common.shape)
        x, y = np.nonzero(common)
        c = common[x, y]
        x, y = sides[0][x], sides[1][y]
        similarity = c / (sizes[x] + sizes[y] - c)
        keep = similarity >= threshold
        if within:
            keep &= ids[x] < ids[y]
        x, y, similarity = x[keep], y[keep], similarity[keep]
        swap = ids[x] > ids[y]
        return pa.table({"a": pa.array(np.where(swap, ids[y], ids[x]), rows["id"].type), "b": pa.array(np.where(swap, ids[x], ids[y]), rows["id"].type), "similarity": similarity})

    return go


def set_pairs(sets: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b, similarity), written: the pairs of rows (key, s) that have at least `threshold`.

    Prefix filter: in the order of rising frequency, similar sets share one of their first
    x - ceil(threshold x) + 1 shingles. Sets of one neighbourhood are dealt into blocks, and
    a set is sent to the blocks in which another has one of these; a task counts what the sets
    of two blocks have in common. So a group of m near copies costs its pairs of blocks, not a row for each pair and shingle.
    """
    kind = dict(sets.dtypes)[key]
    rows = sets.select(key, F.size("s").alias("size"), F.explode("s").alias("shingle"))
    # a shingle of one row makes no pair, but takes up a place
    rows = rows.withColumn("f", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("f > 1")
    ordered = rows.groupBy(key, "size").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("g"))
    most = (F.size("g") - F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")
    prefix = written(ordered.where(most > 0).select(key, "size", F.explode(F.transform(F.slice("g", F.lit(1), most), lambda x: x["shingle"])).alias("shingle")), "prefix")
    pivots = prefix.groupBy("shingle").agg(F.min(key).alias("pivot"))
    near = prefix.join(pivots, "shingle").groupBy(key, "size", "pivot").agg(F.count(F.lit(1)).alias("n"))
    near = written(near.groupBy(key, "size").agg(F.max(F.struct("n", "pivot")).alias("m")).select(key, "size", "m.pivot"), "near")
    need = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_SHINGLES))
    whole = near.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    blocks = max(1, -(-whole["n"] // BLOCK_ROWS), -(-(whole["size"] or 0) // BLOCK_SHINGLES))
    crowds = near.groupBy("pivot").agg(need(F.count(F.lit(1)), F.sum("size")).alias("cut"))
    block = F.when(F.col("cut") > 1, F.xxhash64("pivot", F.pmod(F.xxhash64(key), F.col("cut")))).otherwise(F.pmod(F.xxhash64("pivot"), F.lit(blocks)))
    placed = written(near.join(crowds, "pivot").select(key, block.alias("block")), "placed")
    at = written(prefix.select(key, "shingle").join(placed, key), "at")
    others = at.groupBy("shingle", F.col("block").alias("other")).agg(F.count(F.lit(1)).alias("m"))
    met = at.join(others, "shingle").where("block <> other or m > 1").select(key, "block", "other").distinct()
    tasks = written(met.select(F.col(key).alias("id"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.expr("block <= other").alias("left")), "tasks")
    sent = tasks.join(sets.select(F.col(key).alias("id"), "s"), "id")
    out = written(sent.groupBy("i", "j").applyInArrow(_overlaps(threshold), f"a {kind}, b {kind}, similarity double"), "pairs")
    removed(prefix, near, placed, at, tasks)
    return out


def distinct_pairs(df: DataFrame, key: str, text: str, group: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, equal): (a, b, similarity) of different sets, each known by its least key, and (key, rep) of the keys with these sets."""
    sets = similar_sets(df, key, text, group, n, threshold)
    equal = equal_sets(sets, key)
    reps = written(sets.join(equal.where(F.col(key) == F.col("rep")), key, "left_semi"), "reps")
    removed(sets)
    pairs = set_pairs(reps, key, threshold)
    removed(reps)
    return pairs, equal


def jaccard_pairs(df: DataFrame, key: str, text: str, group: str, n: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of pairs in a group whose shingle sets have at least `threshold`.

    Shingles, with their group, are known by a 64-bit hash. Only sets that share enough
    shingles become rows (`similar_sets`), equal sets are compared once, the others block by block (`set_pairs`).
    """
    pairs, equal = distinct_pairs(df, key, text, group, n, threshold)
    side = lambda x: equal.select(F.col(key).alias("_" + x), F.col("rep").alias(x))
    all_pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    copies = side("a").join(equal.select(F.col(key).alias("_b"), F.col("rep").alias("a")), "a").where("_a < _b")
    return all_pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "similarity").unionByName(copies.select(F.col("_a").alias("a"), F.col("_b").alias("b"), F.lit(1.0).alias("similarity")))


def greedy_similar(df: DataFrame, key: str, text: str, group: str, n: int, threshold: float) -> DataFrame:
    """Keys that a greedy pass in key order keeps, none of which is similar to a kept smaller one.

    Of equal sets the least key stands for all: the others go if it is kept, and by the same neighbour if it isn't.
    """
    pairs, equal = distinct_pairs(df, key, text, group, n, threshold)
    ends = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    gone = ends.join(greedy_keep(ends, pairs, key), key, "left_anti").unionByName(equal.where(F.col(key) != F.col("rep")).select(key))
    return df.select(key).distinct().join(gone, key, "left_anti")


def greedy_keep(nodes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Nodes that a greedy pass in key order keeps: those with no kept smaller neighbour.

    Rounds: every undecided node without undecided smaller neighbours is settled at
    once, so the number of rounds is the longest decreasing chain of pairs. Each
    round is written to the checkpoint folder.
    """
    edges = pairs.select(F.greatest("a", "b").alias(key), F.least("a", "b").alias("other")).distinct().checkpoint()
    state = nodes.select(key).distinct().withColumn("kept", F.lit(None).cast("boolean")).checkpoint()
    while True:
        other = state.select(F.col(key).alias("other"), F.col("kept").alias("other_kept"))
        seen = edges.join(other, "other").groupBy(key).agg(F.bool_or(F.coalesce("other_kept", F.lit(False))).alias("hit"), F.bool_or(F.col("other_kept").isNull()).alias("wait"))
        new = state.join(seen, key, "left")
        new = new.select(key, F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), False).when(F.coalesce("wait", F.lit(False)), None).otherwise(True).alias("kept")).checkpoint()
        state = new
        if state.where("kept is null").isEmpty():
            return state.where("kept").select(key)


def protected_overlap(docs: DataFrame, protected: DataFrame, key: str, text: str, protected_text: str, n: int = 13) -> DataFrame:
    """(key, grams): documents that share an n-gram with protected text, and how many distinct ones."""
    grams = shingle_rows(protected.withColumn("_k", F.lit(0)), "_k", protected_text, n).select("shingle").distinct()
    if grams.count() <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    # only what is protected is made distinct
    hits = shingle_places(docs, key, text, n).join(grams, "shingle", "left_semi")
    return hits.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("grams"))


def components(pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, component): the least id reachable from each id of `pairs` (a, b).

    Minimum labels run along the edges, and over labels of labels, until nothing
    changes; rounds are cut by checkpoints. Raises if `most_rounds` don't do.
    """
    edges = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")).checkpoint()
    for _ in range(most_rounds):
        along = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("c"))
        new = labels.join(along, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("m"))
        jump = new.join(labels.select(F.col("id").alias("m"), F.col("component").alias("j")), "m", "left")
        new = jump.select("id", F.least("m", F.coalesce("j", "m")).alias("component")).checkpoint()
        if new.exceptAll(labels).isEmpty():
            return new
        labels = new
    raise RuntimeError("components did not settle")


def duplicate_rate(blocks: DataFrame, key: str) -> DataFrame:
    """One row: blocks, distinct blocks, and the share of blocks that repeat an earlier one."""
    counts = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("blocks"), F.count(F.lit(1)).alias("distinct_blocks")).withColumn("rate", F.round(F.when(F.col("blocks") > 0, 1 - F.col("distinct_blocks") / F.col("blocks")).otherwise(0.0), 9))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


VECTORS = 4096  # of a block; a task compares two blocks


def _block_pairs(threshold: float):
    """Cosines of two blocks by one matrix product; what reaches the threshold is summed again in the vector's order, as `cosine` does."""

    def go(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        ids, block = rows["id"].to_numpy(), rows["block"].to_numpy()
        v = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        square = np.zeros(len(ids))
        for k in range(v.shape[1]):
            square += v[:, k] * v[:, k]
        unit = v / np.sqrt(square)[:, None]
        within = rows["i"][0] == rows["j"][0]
        first, second = np.flatnonzero(block == rows["i"][0].as_py()), np.flatnonzero(block == rows["j"][0].as_py())
        out: list[tuple] = [(ids[:0], ids[:0], square[:0])]
        for at in range(0, len(first), 256):
            some = first[at : at + 256]
            x, y = np.nonzero(unit[some] @ unit[second].T >= threshold - 1e-9)
            x, y = some[x], second[y]
            if within:
                x, y = x[ids[x] < ids[y]], y[ids[x] < ids[y]]
            x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
            dot = np.zeros(len(x))
            for k in range(v.shape[1]):
                dot += v[x, k] * v[y, k]
            cos = dot / np.sqrt(square[x] * square[y])
            keep = cos >= threshold
            out.append((ids[x[keep]], ids[y[keep]], cos[keep]))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["a", "b", "cos"])

    return go


def cosine_pairs(df: DataFrame, key: str, label: str, vector: str, threshold: float) -> DataFrame:
    """(a, b, cos) of a < b with one label whose cosine reaches `threshold`, by comparing all of them.

    A label's vectors are dealt into blocks, and each task compares two blocks, whatever
    the size of the label. Vectors with a null are in no pair, nor are two of different
    lengths; those with a square that is zero or not finite are compared row by row.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.withColumn("dim", F.size("v")).withColumn("plain", (square > 1e-100) & (square < 1e100))
    good, odd = rows.where("plain"), rows.where("not plain")
    blocks = good.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / VECTORS).cast("int").alias("blocks"))
    dealt = good.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("label", "dim", "block", "id", "v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("label", "dim", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "v")
    pairs = dealt.groupBy("label", "dim", "i", "j").applyInArrow(_block_pairs(threshold), "a long, b long, cos double")
    met = odd.select("label", F.col("id").alias("x"), F.col("v").alias("vx")).join(rows.select("label", F.col("id").alias("y"), F.col("v").alias("vy"), "plain"), "label")
    met = met.where("x < y or plain and x > y").select("x", "y", cosine(F.col("vx"), F.col("vy")).alias("cos")).where(F.col("cos") >= threshold)
    return pairs.unionByName(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cos"))
