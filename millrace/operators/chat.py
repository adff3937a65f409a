"""Conversations: validation, rendering, truncation, supervised counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def messages(df: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<turn, role, content>>) in turn order."""
    row = F.struct("turn", F.lower(T.strip(F.col("role"))).alias("role"), T.chat_text(F.lower(T.strip(F.col("role"))), F.col("text")).alias("content"))
    return df.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("messages"))


def chat_error(m: Column, default_system: bool = True, end: str | None = "assistant") -> Column:
    """Why a conversation isn't valid; null if it is.

    Roles are system (first only; a default stands in for a missing one), then user
    and assistant in turn; contents aren't empty, except a first system turn that the
    default replaces; there is a user; the last role is `end`.
    """
    known = F.forall(m, lambda x: x["role"].isin("system", "user", "assistant"))
    filled = F.forall(m, lambda x: (T.strip(x["content"]) != "") | ((x["role"] == "system") & F.lit(default_system) & (x["turn"] == m[0]["turn"])))
    rest = F.when(m[0]["role"] == "system", F.slice(m, 2, F.greatest(F.lit(1), F.size(m)))).otherwise(m)
    order = F.size(F.filter(rest, lambda x, i: x["role"] != F.when(i % 2 == 0, "user").otherwise("assistant"))) == 0
    rules = [("unknown_role", ~known), ("empty_content", ~filled)]
    if not default_system:
        rules.append(("no_system", m[0]["role"] != "system"))
    rules += [("role_order", ~order), ("no_user", F.size(rest) == 0)]
    if end:
        rules.append((f"end_not_{end}", F.element_at(m, -1)["role"] != end))
    return T.first_reason(*rules)


def render(m: Column) -> Column:
    """role, colon, newline, content; messages apart by an empty line; empty contents left out."""
    full = F.filter(m, lambda x: x["content"] != "")
    return F.array_join(F.transform(full, lambda x: F.concat(x["role"], F.lit(":\n"), x["content"])), "\n\n")


def truncate(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """Rows (conv_id, turn, role, ...) that fit `limit`: all system turns and the longest suffix that starts at
    a user turn. A conversation whose system and last user suffix don't fit keeps nothing."""
    w = Window.partitionBy("conv_id")
    sized = df.withColumn("_n", size).withColumn("_sys", F.sum(F.when(F.col("role") == "system", F.col("_n")).otherwise(0)).over(w))
    suffix = w.orderBy("turn").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sized = sized.withColumn("_rest", F.sum(F.when(F.col("role") == "system", 0).otherwise(F.col("_n"))).over(suffix))
    sized = sized.withColumn("_from", F.min(F.when((F.col("role") == "user") & (F.col("_rest") + F.col("_sys") <= limit), F.col("turn"))).over(w))
    return sized.where(F.col("_from").isNotNull() & ((F.col("role") == "system") | (F.col("turn") >= F.col("_from")))).drop("_n", "_sys", "_rest", "_from")


# Marks of a conversation's ids, and the label of what isn't supervised.
BEGIN_ID, END_ID, ROLE_IDS, IGNORED = 2, 3, {"system": 4, "user": 5, "assistant": 6}, -100


def encode_chat(df: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, ids, labels): a begin mark, then each turn's role mark and content, and an end mark behind answers.

    Labels have the ids of answers and their end marks, IGNORED elsewhere. Turns are encoded row by row, and
    meet only as ids. A turn with an unknown role or without ids, such as an empty one, makes both null.
    """
    from ..functions.tokens import bpe_ids

    role = F.lower(T.strip(F.col("role")))
    mark = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_IDS.items() for x in kv]), role)
    rows = df.select("conv_id", "turn", role.alias("role"), mark.alias("mark"), bpe_ids(T.chat_text(role, F.col("text"))).alias("own"))
    answer = F.col("role") == "assistant"
    ids = F.when(F.col("mark").isNotNull() & (F.size("own") > 0), F.concat(F.array("mark"), "own", F.when(answer, F.array(F.lit(END_ID))).otherwise(F.array().cast("array<int>"))))
    rows = rows.select("conv_id", "turn", ids.alias("ids"), answer.alias("answer"))
    rows = rows.select("conv_id", "turn", "ids", F.transform("ids", lambda x, i: F.when(F.col("answer") & (i > 0), x).otherwise(IGNORED)).alias("labels"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "ids", "labels"))).alias("t"))
    joined = lambda name, first: F.concat(F.array(F.lit(first)), F.flatten(F.transform("t", lambda x: x[name])))
    return turns.select("conv_id", joined("ids", BEGIN_ID).alias("ids"), joined("labels", IGNORED).alias("labels"))
