"""Fuzzy line deduplication by MinHash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components_from_buckets
from .runtime import bounded, discard, fresh, materialise

SHINGLE = 8
STEP = 4  # shingles to a row while signatures are made
MINIMA = 9
#: Bands of three minima each: the lines of the affine plane of order three, of which any two minima share one.
BANDS = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (1, 5, 6), (2, 3, 7), (0, 5, 7), (1, 3, 8), (2, 4, 6))
BROADCAST_ENTRIES = 2_000_000  # of a long or two each: 64 MB at most
BLANK = " \t\r\x0b\x0c"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, pos, line) of the lines that aren't blank; key stands for id and text."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))  # below the explode, else a text is hashed once for each of its lines
    rows = rows.select("key", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("key", "doc_id", "pos", F.btrim("line", F.lit(BLANK)).alias("line")).where("line <> ''").withColumn("id", F.xxhash64("line"))


def _wide(line: Column) -> Column:
    """Two bytes per character, so that a shingle is cut out in constant time."""
    return F.encode(line, "UTF-16BE")


def _last(wide: Column) -> Column:
    """The 1-based byte at which the last shingle begins; a line shorter than a shingle is one shingle."""
    return F.greatest(F.lit(0), (F.octet_length(wide) / 2).cast("int") - SHINGLE) * 2 + 1


def _cut(wide: Column, at: Column) -> Column:
    return F.substring(wide, at, F.lit(2 * SHINGLE))


def minhash_signatures(lines: DataFrame) -> DataFrame:
    """(id, k, m0, m1, ...) of each distinct line: how often it occurs, and minima of its shingles' hashes under MINIMA orders.

    An order is that of the hashes xor a constant. Shingles are generated, hashed
    and reduced in one stage; equal lines meet before the shuffle.
    """
    rows = lines.select("id", _wide(F.col("line")).alias("wide"))
    rows = rows.select("id", "wide", _last(F.col("wide")).alias("last"))
    rows = rows.select("id", "wide", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(2 * STEP))).alias("at"))
    # 32 bits do for candidates; a line's last shingle may count again, which changes no minimum
    hashed = [F.hash(_cut(F.col("wide"), F.least(F.col("at") + 2 * j, F.col("last")))).alias(f"x{j}") for j in range(STEP)]
    rows = rows.select("id", "at", *hashed)
    order = lambda j: F.hash(F.lit(f"order {j}"))
    minima = [F.min(F.least(*[F.col(f"x{i}").bitwiseXOR(order(j)) for i in range(STEP)])).alias(f"m{j}") for j in range(MINIMA)]
    return rows.groupBy("id").agg(F.sum(F.when(F.col("at") == 1, 1).otherwise(0)).alias("k"), *minima)


def line_buckets(signatures: DataFrame) -> DataFrame:
    """(bucket, id): one bucket for each band of a signature."""
    bands = [F.xxhash64(F.lit(b), *[F.col(f"m{j}") for j in band]) for b, band in enumerate(BANDS)]
    return signatures.select(F.explode(F.array(*bands)).alias("bucket"), "id")


def _shingles(line: Column) -> Column:
    """The shingles of a line; the outer array binds its encoded form once, as a column would be copied for each shingle."""
    of = lambda w: F.transform(F.sequence(F.lit(1), _last(w), F.lit(2)), lambda i: F.xxhash64(_cut(w, i)))
    return F.element_at(F.transform(F.array(_wide(line)), of), 1)


def line_classes(texts: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """(id, component) of lines that are similar to others, from rows (bucket, id, k); `texts` has (id, line, n), n the number of shingles, of each of these ids."""
    percent = round(100 * similarity)

    def verify(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("id").alias("a"), F.col("line").alias("la"), F.col("n").alias("na"))
        right = texts.select(F.col("id").alias("b"), F.col("line").alias("lb"), F.col("n").alias("nb"))
        # c of na + nb - c in common; each shingle list stands here once, as the optimiser would repeat its evaluation
        common = F.size(F.array_intersect(_shingles(F.col("la")), _shingles(F.col("lb"))))
        sizes = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        linked = sizes & ((100 + percent) * common >= percent * (F.col("na") + F.col("nb")))
        return pairs.join(left, "a").join(right, "b").select("a", "b", linked.alias("linked"))

    def grams_of(rows: DataFrame) -> DataFrame:
        return texts.join(rows, "id", "left_semi").select("id", F.explode(F.array_distinct(_shingles(F.col("line")))).alias("gram"))

    return components_from_buckets(shared, grams_of, verify, percent)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """`docs` with its text less repeated lines, and columns n_lines, n_removed added.

    Lines are the pieces between newlines, less white space at their ends; blank
    ones are never removed. Two lines are linked if the Jaccard similarity of
    their sets of 8-character shingles is at least `similarity` (a shorter line is
    one shingle); candidates agree in a band of their MinHash signatures (a pair at
    0.8 does with probability 0.990, at 0.85 with 0.997), and are verified on the
    whole sets. Of each component of links and equal lines the first line stays, by
    (id, row, position); the others are removed wherever they are.

    Null texts stay null with n_lines 0, empty ones stay empty. A null id sorts before all
    others. Rows that repeat both id and text are one document and get the same
    result. The other columns pass through, whatever their names, unless they are
    named n_lines or n_removed, which are replaced. An empty table gives no rows.
    Lines are told apart by a 64-bit hash; a line of any length is one row.
    """
    lines = _lines(docs, id_col, text_col)
    signatures = materialise(minhash_signatures(lines), "signatures")
    buckets = line_buckets(signatures)
    several = materialise(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "several")
    # a row for each line that shares a bucket or occurs more than once; a line has as many buckets as there are bands at most
    wanted = buckets.join(bounded(several, BROADCAST_ENTRIES), "bucket").groupBy("id").agg(F.collect_list("bucket").alias("buckets"))
    wanted = signatures.where("k > 1").select("id").join(wanted, "id", "full").withColumn("similar", F.col("buckets").isNotNull())
    wanted = materialise(wanted, "wanted")
    shared = wanted.where("similar").select(F.explode("buckets").alias("bucket"), "id", F.size("buckets").alias("k"))
    discard(signatures, several)
    # the places of lines that others equal or may be similar to, and the texts of the latter
    found = lines.join(bounded(wanted.select("id", "similar"), BROADCAST_ENTRIES), "id").select("id", "key", "doc_id", "pos", F.when(F.col("similar"), F.col("line")).alias("line"))
    found = materialise(found, "lines")
    texts = found.where("line is not null").groupBy("id").agg(F.first("line").alias("line"))
    texts = materialise(texts.withColumn("n", F.size(F.array_distinct(_shingles(F.col("line")))).cast("long")), "texts")
    labels = line_classes(texts, shared, similarity)
    place = F.struct("doc_id", "key", "pos")
    heads = found.groupBy("id").agg(F.min(place).alias("first"))
    heads = materialise(heads.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "first"), "heads")
    first = materialise(heads.groupBy("component").agg(F.min("first").alias("first")), "firsts")
    heads_of = materialise(heads.drop("first").join(first, "component").select("id", "first"), "kept")
    drops = found.select("id", "doc_id", "key", "pos").join(heads_of, "id").where(~place.eqNullSafe(F.col("first")))
    key, drop = fresh(docs, "key"), fresh(docs, "drop")
    drops = materialise(drops.groupBy(F.col("key").alias(key)).agg(F.collect_set("pos").alias(drop)), "drops")
    discard(wanted, found, texts, labels, heads, first, heads_of)
    text = F.col(f"`{text_col}`").cast("string")
    pieces = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains(F.col(drop), i)), "\n")
    joined = docs.withColumn(key, F.xxhash64(F.col(f"`{id_col}`"), text)).join(bounded(drops, BROADCAST_ENTRIES, drop), key, "left")
    removed = F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop))
    return joined.withColumns(
        {
            "n_lines": F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(pieces, lambda x: F.btrim(x, F.lit(BLANK)) != ""))),
            "n_removed": removed,
            text_col: F.when(F.col(drop).isNull(), text).otherwise(kept),
        }
    ).drop(key, drop)
