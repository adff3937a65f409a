"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import bounded, fresh, materialise

# Of 5 to 13 aligned words with a quarter of them substituted at most,
# one of the masks meets words that agree wherever it has a 1.
MASKS = ("1111", "11101", "11011", "10111", "110011")
LEAST_WORDS = 5  # the masks are sure to meet items from this size on
BROADCAST_SEEDS = 2_000_000  # rows of (hash, item, position): 64 MB at most
BROADCAST_HITS = 500_000  # of (item, offset)


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits of a text; empty for null."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each position and mask that fits: `keep`, at, seed. `h` goes no further, so that rows stay narrow."""
    span = min(map(len, MASKS))
    places = F.when(F.size("h") >= span, F.sequence(F.lit(0), F.size("h") - span))
    placed = rows.select(*keep, "h", F.explode(places).alias("at"))
    seed = lambda i, mask: F.when(
        F.col("at") + len(mask) <= F.size("h"), F.xxhash64(F.lit(i), *[F.get("h", F.col("at") + j) for j, c in enumerate(mask) if c == "1"])
    )
    return placed.select(*keep, "at", F.explode(F.array(*[seed(i, m) for i, m in enumerate(MASKS)])).alias("seed")).where("seed is not null")


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: float = 0.75,
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """(doc_id, item_id, first_word): documents with a passage of a benchmark item.

    A document has a passage of an item if `window` consecutive words of both,
    aligned without gaps, agree in at least `share` of the places (an item shorter
    than the window: all its words). Words are lower-cased runs of letters and
    digits. Spaced seeds, whose masks ignore fixed places, are hashed at every word
    of test and training texts and joined; along each hit the aligned words are
    compared, so a substitution neither hides a passage nor counts as an agreement.
    first_word is the 0-based word at which the first such window begins. With the
    default window and share the masks meet every pattern of substitutions, so all
    pairs that the definition names are found.

    The seeds of the benchmark are broadcast if they are counted to be at most
    BROADCAST_SEEDS, and joined by shuffle otherwise. Items with fewer than
    `least_words` words (nearly every text holds some of these), or null, take no
    part; null or empty documents give no rows; null ids are kept as they are; rows
    that repeat an id are counted together; other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), word_hashes(F.col(f"`{item_text_col}`")).alias("h"))
    items = materialise(items.where(F.size("h") >= max(least_words, LEAST_WORDS)).withColumn("item", F.xxhash64("item_id", "h")).dropDuplicates(["item"]), "items")
    seeds = _seeds(items.withColumn("item_size", F.size("h")), ["item", "item_size"]).select("seed", "item", "item_size", F.col("at").alias("item_at"))
    small = seeds.count() <= BROADCAST_SEEDS
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    words = keyed.select(F.xxhash64("doc_id", "text").alias("key"), word_hashes(F.col("text")).alias("h"))
    hits = _seeds(words, ["key"]).join(F.broadcast(seeds) if small else seeds, "seed").select("key", "item", "item_size", (F.col("at") - F.col("item_at")).alias("offset")).distinct()
    hits = materialise(hits.groupBy("key").agg(F.collect_list(F.struct("item", "item_size", "offset")).alias("hits")), "hits")
    found = keyed.withColumn("key", F.xxhash64("doc_id", "text")).join(bounded(hits, BROADCAST_HITS, "hits"), "key")
    found = found.select("doc_id", word_hashes(F.col("text")).alias("h"), "hits")

    def beside(hit: Column) -> Column:
        """The words of the document that lie beside words of the item at this offset: cut here, so that a hit doesn't carry the whole text."""
        start = F.greatest(hit["offset"], F.lit(0))
        length = F.least(F.size("h") - start, hit["item_size"] - F.greatest(-hit["offset"], F.lit(0)))
        return F.struct(hit["item"].alias("item"), hit["item_size"].alias("item_size"), hit["offset"].alias("offset"), F.slice("h", start + 1, F.greatest(F.lit(0), length)).alias("words"))

    found = found.select("doc_id", F.explode(F.transform("hits", beside)).alias("hit")).select("doc_id", "hit.*")
    ends = items.select("item", "item_id", F.col("h").alias("item_h"))
    hits = found.join(F.broadcast(ends) if small else ends, "item")
    at, item_at = F.greatest("offset", F.lit(0)), F.greatest(-F.col("offset"), F.lit(0))
    length = F.size("words")
    w = F.least(F.lit(window), F.col("item_size"))
    same = F.zip_with("words", F.slice("item_h", item_at + 1, length), lambda x, y: F.when(x == y, 1).otherwise(0))
    total = lambda x: F.aggregate(x, F.lit(0), lambda t, y: t + y)
    hits = hits.where(length >= w).select("doc_id", "item_id", at.alias("at"), w.alias("w"), F.ceil(w * F.lit(share)).cast("int").alias("need"), same.alias("same"))
    # safe for rows that another condition leaves out, too: expressions may be evaluated before it
    room = F.size("same") - F.col("w")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), room)), lambda s: (room >= 0) & (total(F.slice("same", s + 1, F.col("w"))) >= F.col("need")))
    good = hits.where(total(F.col("same")) >= F.col("need")).select("doc_id", "item_id", (F.col("at") + F.array_min(starts)).alias("first_word"))
    return good.where("first_word is not null").groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` without a benchmark passage, as they were; rows with a null id stay only if
    no row with a null id has one."""
    name = fresh(docs, "bad")
    bad = contaminated_pairs(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(name)), "left_anti")
