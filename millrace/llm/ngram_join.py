"""Exact n-gram Jaccard join by vertical partitioning."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import mixed
from .components import KIND, SINGLE, agreeing, components_from_buckets, merged
from .runtime import discard, materialise
from .words import shingle_hashes, text_chunks, word_hashes

OVERLAP_FRAGMENTS = 8
AGREE = 3  # equal fragments of linked sets that are signed, at least
TINY = 24  # sizes of bands below which it is one: such sets have hardly more n-grams than that


def size_bands(percent: int, largest: int) -> list[int]:
    """Lower bounds of bands of set sizes: linked sets lie in the same or in neighbouring bands."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(bounds[-1] * 100 // percent + 1)
    return bounds


def most_differences(size_a: int, size_b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets: |a ^ b| <= (|a|+|b|) (1-t) / (1+t)."""
    return (size_a + size_b) * (100 - percent) // (100 + percent)


_BANDS = {p: size_bands(p, 1 << 40) for p in (80, 90)}


def fragment_cuts(largest: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragments, slack) for sets of a band up to size `largest`: AGREE more than linked sets may differ by (one, if they are tiny), and the slack.

    The slack is five deviations above the number of fragments that are empty by chance in the
    smallest sets that are cut so, which have percent**2 of the largest size. Sets with more
    share their empty fragments, and with a slack that is little above the number they are a
    share of all sets and make crowds.
    """
    differ = 2 * largest * (100 - percent) // (100 + percent)
    agree = np.where(largest < TINY, 1, AGREE)
    smallest = np.maximum(1, largest * (percent / 100) ** 2)
    slack = np.full(len(largest), 2, np.int64)
    for _ in range(40):  # more fragments leave more of them empty
        cuts = differ + agree + slack
        fill = smallest / cuts
        empty = cuts * np.exp(-fill)
        spread = np.sqrt(np.maximum(0, empty * (1 - (1 + fill) * np.exp(-fill))))
        slack = np.maximum(slack, np.minimum(2 * largest, np.ceil(empty + 5 * spread).astype(np.int64)))
    return differ + agree + slack, slack


def fragment_signatures(shingles: np.ndarray, owner: np.ndarray, sizes: np.ndarray, percent: int):
    """(owner, signature) of every set's fragments.

    The global order of n-grams is that of their hashes. For sets of one band the
    order is cut into more fragments than linked sets may differ by, so at least
    `slack` and AGREE fragments of linked sets are equal, and a fragment is known by the
    hash of its n-grams. A set is signed under its own band's cut and under the
    next band's. Empty fragments, which unrelated sets share, are signed only by
    the rare sets with more than `slack` of them: otherwise a linked pair has AGREE
    equal fragments that aren't empty. Sets that share one frequent n-gram by chance
    seldom have a second equal fragment. The two lowest bits of a signature
    are those of `components.agreeing`: SINGLE if one equal fragment is enough, as of
    tiny sets, and KIND, which tells apart the cuts that linked sets can share.
    """
    bands = _BANDS.setdefault(percent, size_bands(percent, 1 << 40))
    full = np.flatnonzero(sizes > 0)
    band_of = np.array([bisect_right(bands, int(s)) - 1 for s in sizes[full]], np.int64)
    out_o, out_s = [], []
    for step in (0, 1):
        upper = np.array([bands[b + step + 1] - 1 for b in band_of], np.int64)
        cuts, slack = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        cuts[full], slack[full] = fragment_cuts(upper, percent)
        band, upper_of = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        band[full], upper_of[full] = band_of + step, upper
        first = np.cumsum(cuts) - cuts
        with np.errstate(over="ignore"):
            at = ((shingles >> np.uint64(32)) * cuts[owner].astype(np.uint64)) >> np.uint64(32)
            slot = first[owner] + at.astype(np.int64)
            sums, counts = np.zeros(int(cuts.sum()), np.uint64), np.bincount(slot, minlength=int(cuts.sum()))
            starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
            if len(starts):
                sums[slot[starts]] = np.add.reduceat(mixed(shingles), starts)
            who = np.repeat(np.arange(len(sizes)), cuts)
            index = np.arange(len(who)) - first[who]
            signature = mixed(sums + counts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ mixed((band[who] << 32 | index).astype(np.uint64))
        empty = counts == 0
        many = np.bincount(who, weights=empty, minlength=len(sizes)) > slack
        keep = ~empty | many[who]
        out_o.append(who[keep])
        marks = np.where(upper_of < TINY, SINGLE, 0) | np.where(band & 1, KIND, 0)
        out_s.append(mixed(signature[keep]) & ~np.uint64(SINGLE | KIND) | marks[who[keep]].astype(np.uint64))
    return np.concatenate(out_o), np.concatenate(out_s)


def _starts(slot: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)


def _print(shingles: np.ndarray, owner: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """A fingerprint of each set that doesn't depend on order."""
    total = np.zeros(rows, np.uint64)
    starts = _starts(owner)
    if len(starts):
        total[owner[starts]] = np.add.reduceat(mixed(shingles ^ np.uint64(salt)), starts)
    return mixed(total).view(np.int64)


def _sets(batches, n: int):
    """Yield (ids, sizes, node, shingles, owner) of chunks of rows; equal sets are one node."""
    for batch in batches:
        for row, rows, data, ends in text_chunks(batch, 1):
            words, of, *_ = word_hashes(data, ends)
            shingles, owner = shingle_hashes(words, of, rows, n)
            yield batch.column(0).slice(row, rows), np.bincount(owner, minlength=rows), _print(shingles, owner, rows, 0x1234567), shingles, owner


def ngram_sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, node, check): equal sets have equal sizes and fingerprints."""

    def go(batches):
        for ids, sizes, node, shingles, owner in _sets(batches, n):
            check = _print(shingles, owner, len(sizes), 0x89ABCDEF)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), pa.array(node), pa.array(check)], ["id", "n_shingles", "node", "check"])

    return docs.mapInArrow(go, "id long, n_shingles long, node long, check long")


def _signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    def go(batches):
        for _, sizes, node, shingles, owner in _sets(batches, n):
            who, signature = fragment_signatures(shingles, owner, sizes, percent)
            yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(node[who])], ["bucket", "id"])

    return docs.mapInArrow(go, "bucket long, id long")


def _fragments(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, part, grams): each set cut at fixed places of the global order."""

    def go(batches):
        for _, sizes, node, shingles, owner in _sets(batches, n):
            part = (shingles >> np.uint64(61)).astype(np.int64)
            slot = owner * OVERLAP_FRAGMENTS + part
            starts = _starts(slot)
            grams = pa.ListArray.from_arrays(pa.array(np.append(starts, len(slot)).astype(np.int32)), pa.array(shingles.view(np.int64)))
            who = owner[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[who]), pa.array(sizes[who].astype(np.int64)), pa.array(part[starts].astype(np.int32)), grams], ["id", "n_shingles", "part", "grams"]
            )

    return docs.mapInArrow(go, "id long, n_shingles long, part int, grams array<long>")


def _runs(batches):
    """Rows of sorted (bucket, id) whose bucket the row before or behind shares, with another id."""
    held = None  # last row so far, and whether it is out already

    def table(bucket, ident):
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ident)], ["bucket", "id"])

    for batch in batches:
        bucket, ident = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held is not None:
            bucket, ident = np.append(held[0], bucket), np.append(held[1], ident)
        fresh = np.ones(len(bucket), bool)
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (ident[1:] != ident[:-1])
        bucket, ident = bucket[fresh], ident[fresh]
        same = bucket[1:] == bucket[:-1]
        keep = np.zeros(len(bucket), bool)
        keep[1:] |= same
        keep[:-1] |= same
        if held is not None and held[2]:
            keep[0] = False
            if len(keep) == 1:
                continue
        out = bool(keep[-1]) or (held is not None and held[2] and len(bucket) == 1)
        if keep.any():
            yield table(bucket[keep], ident[keep])
        held = (bucket[-1], ident[-1], out)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a row's set
    is its distinct `n`-word shingles (fewer words: the whole sequence as one).
    Rows link when 100 * |a & b| >= `percent` * |a | b|, exactly; component_id is
    the smallest id reachable by links.

    Vertical partitioning: the global n-gram order is cut into fragments. Sets
    that agree on several whole fragments are candidates (linked sets always do, see
    `fragment_signatures`); their overlaps are counted fragment by fragment and
    summed per pair. Equal sets are one node from the start, and candidates come
    from `components_from_buckets`, so neither copies nor near copies are
    expanded into all pairs, and no link is lost.

    Null or empty texts have an empty set and are linked with nothing. Rows with a
    null id keep their set's size and have a null component. Rows that repeat an
    id are one vertex with all their sets' links. Other columns are ignored. An
    empty table gives no rows.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = materialise(ngram_sets(plain, n), "sets")
    keyed = sets.where("id is not null and n_shingles > 0")
    classes = materialise(keyed.groupBy("n_shingles", "node", "check").agg(F.min("id").alias("rep")), "classes")
    # a repeated id with different texts joins their nodes
    twice = keyed.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    twice = keyed.join(twice, "id").where("node <> a").select("a", F.col("node").alias("b"))

    signed = _signatures(plain.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), n, percent)
    met = materialise(signed.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(_runs, "bucket long, id long"), "shared")
    shared = materialise(agreeing(met, AGREE), "shared")
    discard(met)

    nodes = shared.select(F.col("id").alias("node")).distinct()
    wanted = materialise(classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("id")).distinct(), "wanted")
    parts = materialise(_fragments(plain.join(wanted, "id", "left_semi"), n).dropDuplicates(["id", "part"]), "fragments")

    def verify(pairs: DataFrame) -> DataFrame:
        left = parts.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), "part", F.col("grams").alias("ga"))
        right = parts.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), "part", F.col("grams").alias("gb"))
        partial = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("common"))
        total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
        return total.select("a", "b", F.expr(f"100 * common >= {percent} * (na + nb - common)").alias("linked"))

    def grams_of(rows: DataFrame) -> DataFrame:
        return parts.join(rows, "id", "left_semi").select("id", F.explode("grams").alias("gram"))

    held = shared.groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    narrow, shared = shared, materialise(shared.join(held, "id"), "shared")
    discard(narrow)
    labels = merged(components_from_buckets(shared, grams_of, verify, percent, AGREE), twice)
    # the smallest id of each component, by nodes; each step is written, so that Spark can split a large component or class
    reps = materialise(classes.groupBy("node").agg(F.min("rep").alias("rep")), "reps")
    named = materialise(reps.join(labels.select(F.col("id").alias("node"), "component"), "node").select("node", "component", "rep"), "named")
    least = materialise(named.groupBy("component").agg(F.min("rep").alias("least")), "least")
    linked = named.join(least, "component").select("node", "least")
    place = materialise(reps.join(linked, "node", "left").select("node", F.coalesce("least", "rep").alias("least")), "places")
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    out = sets.join(place, "node", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("least")).alias("component_id"))
    discard(classes, shared, wanted, parts, labels, reps, named, least)
    return out
