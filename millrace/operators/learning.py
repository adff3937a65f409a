"""Rows to learn from: preference pairs with a shared prefix, weighted rewards, loss masks of packed blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: the marks before a speaker's words in a dialogue of one text
MARK = "\n\n(Human|Assistant): "
_BARE = "\n\n(?:Human|Assistant): "


def dialogue_turns(dialogue: Column) -> Column:
    """Array of (role, content) of a dialogue in one text; what stands before the first mark isn't a turn, contents are stripped."""
    text = F.regexp_replace(F.coalesce(dialogue, F.lit("")), "\r\n?", "\n")
    contents = F.split(text, _BARE, -1)
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(MARK), F.lit(1)),
        F.slice(contents, 2, F.greatest(F.size(contents) - 1, F.lit(0))),
        lambda who, said: F.struct(F.when(who == "Human", "user").otherwise("assistant").alias("role"), T.strip(said).alias("content")),
    )


def preference_pairs(dialogues: DataFrame, tokens: Callable[[Column], Column], prompt_tokens: int, least_chars: int, least_tokens: int, all_tokens: int) -> DataFrame:
    """`dialogues` (chosen, rejected and further columns) with messages, chosen, rejected and `reject`: why a pair can't be used, null if it can.

    Both dialogues must end with an assistant and have the same turns before, none of them empty; the answers
    must differ and have `least_chars` characters and, with their end, `least_tokens` tokens; the prompt has
    `prompt_tokens` at most and with either answer `all_tokens`. Reasons come in this order. `tokens` counts a text's.
    """
    rest = [c for c in dialogues.columns if c not in ("chosen", "rejected")]
    rows = dialogues.select(*rest, dialogue_turns(F.col("chosen")).alias("_c"), dialogue_turns(F.col("rejected")).alias("_r"))
    last = lambda c: F.get(c, F.size(c) - 1)
    prefix = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    rows = rows.select(*rest, prefix("_c").alias("messages"), prefix("_r").alias("_p"), last("_c").alias("_a"), last("_r").alias("_b"))
    rows = rows.select(*rest, "messages", "_p", F.col("_a.content").alias("chosen"), F.col("_b.content").alias("rejected"), ((F.col("_a.role") == "assistant") & (F.col("_b.role") == "assistant")).alias("_ends"))
    size = lambda c: tokens(F.col(c)) + 1
    prompt = F.aggregate(F.transform("messages", lambda m: tokens(m["content"]).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    rows = rows.withColumns({"_n": prompt, "_x": size("chosen"), "_y": size("rejected")})
    reject = T.first_reason(
        ("no_answer", ~F.coalesce("_ends", F.lit(False))),
        ("no_prompt", F.size("messages") == 0),
        ("prefix_differs", F.col("messages") != F.col("_p")),
        ("empty_turn", F.exists("messages", lambda m: m["content"] == "")),
        ("same_answer", F.col("chosen") == F.col("rejected")),
        ("short_answer", F.least(F.length("chosen"), F.length("rejected")) < least_chars),
        ("long_prompt", F.col("_n") > prompt_tokens),
        ("few_tokens", F.least("_x", "_y") < least_tokens),
        ("too_long", F.col("_n") + F.greatest("_x", "_y") > all_tokens),
    )
    return rows.select(*rest, "messages", "chosen", "rejected", reject.alias("reject"))


def _words(c: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), T.S + "+"), "")


def _normal(c: Column) -> Column:
    return T.squeeze(F.lower(F.coalesce(c, F.lit(""))))


def _length(completion: Column, target: Column) -> Column:
    n = F.size(_words(completion))
    return F.when(n == 0, 0.0).otherwise(F.exp(-F.pow((n - target) / F.greatest(target, F.lit(1.0)), 2)))


def _no_repeat(completion: Column) -> Column:
    def share(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " "))
        return F.when(F.size(w) < 4, 1.0).otherwise(F.size(F.array_distinct(grams)) / (F.size(w) - 2))

    # the outer array binds the words once; else each gram would split the text again
    return F.element_at(F.transform(F.array(_words(completion)), share), 1)


#: name -> reward of (completion, reference, target_words); rewards that run code aren't here
REWARDS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "nonempty": lambda c, r, t: F.when(T.strip(F.coalesce(c, F.lit(""))) != "", 1.0).otherwise(0.0),
    "length": lambda c, r, t: _length(c, t),
    "no_repeat": lambda c, r, t: _no_repeat(c),
    "reference_exact": lambda c, r, t: F.when(r.isNotNull() & (_normal(c) == _normal(r)), 1.0).otherwise(0.0),
    "reference_contains": lambda c, r, t: F.when((F.coalesce(r, F.lit("")) != "") & F.contains(_normal(c), _normal(r)), 1.0).otherwise(0.0),
}


def parse_rewards(spec: str) -> list[tuple[str, float]]:
    """(name, weight) of a spec such as "nonempty+no_repeat:0.5"; ValueError for an unknown name, a weight that is no number, or nothing."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split("+"))):
        name, _, weight = part.partition(":")
        if name.strip() not in REWARDS:
            raise ValueError(f"unknown reward {name.strip()!r}; known: {sorted(REWARDS)}")
        out.append((name.strip(), float(weight) if weight else 1.0))
    if not out:
        raise ValueError(f"empty reward spec: {spec!r}")
    return out


def reward(spec: str, completion: Column, reference: Column | None = None, target_words: Column | None = None) -> Column:
    """The weighted sum that a spec names, as one column expression. Null texts count as empty; a null target as 40 words."""
    reference = F.lit(None).cast("string") if reference is None else reference
    target = F.coalesce(F.lit(40.0) if target_words is None else target_words.cast("double"), F.lit(40.0))
    total = F.lit(0.0)
    for name, weight in parse_rewards(spec):
        total = total + F.lit(weight) * REWARDS[name](completion, reference, target)
    return total


def masked_blocks(runs: DataFrame, size: int, begin: int, end: int, mask_last: bool = False) -> DataFrame:
    """(split, block, ids, labels, mask) of a stream of ids in runs (split, start, ids): blocks of `size` inputs, one id apart from their labels.

    Block b has the ids from b * size to (b + 1) * size, so its last label is the next block's first id; a tail without all of
    them is left out. The mask is 0 where the label begins a document, where it ends one for the second time
    in a row, and with `mask_last` at the last label. A task holds the ids of one block.
    """
    # no filter on ids and no explode that Spark puts one before: such filters go below and make the ids once more each
    full = runs.select("split", "start", "ids", (F.col("start") + F.size("ids") - 1).alias("stop"))
    # an id on a block's edge belongs to two blocks
    cut = full.select("split", "start", "ids", F.explode_outer(F.sequence(F.greatest(F.lit(0), F.expr(f"(start - 1) div {size}L")), F.expr(f"stop div {size}L"))).alias("block"))
    low = F.greatest(F.col("block") * size, F.col("start"))
    high = F.least((F.col("block") + 1) * size, F.col("start") + F.size("ids") - 1)
    pieces = cut.where(low <= high).select("split", "block", low.alias("at"), F.slice("ids", (low - F.col("start") + 1).cast("int"), (high - low + 1).cast("int")).alias("ids"))
    blocks = pieces.groupBy("split", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("all")).where(F.size("all") == size + 1)
    rows = blocks.select("split", "block", F.slice("all", 1, size).alias("ids"), F.slice("all", 2, size).alias("labels"))
    again = lambda x, i: (i > 0) & (x == end) & (F.get("labels", i - 1) == end)
    last = (lambda i: i == size - 1) if mask_last else (lambda i: F.lit(False))
    return rows.withColumn("mask", F.transform("labels", lambda x, i: F.when((x == begin) | F.coalesce(again(x, i), F.lit(False)) | last(i), 0).otherwise(1)))
