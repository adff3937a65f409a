"""Repair of conversation structure: cheapest edits by Dial's bucket queue, settled in segments of bounded size.

A row's place among the rows of its conversation and what may be done with it make a layer
of a graph whose nodes are (rows done, state) and whose arcs are edits with small whole costs.
Distances to the end are found by Dial's queue, backwards; the audit is the walk along
tight arcs that takes the least letter each time. A conversation longer than a segment is
cut: segments give the distances between their ends, those are chained, and each segment is
then walked by itself.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .runtime import discard, materialise

SEGMENT_BITS = 14  # a segment has 2**14 rows at most
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_FAR = 1 << 60
# states: nothing yet, after system, after user, after assistant; what a role's initial makes of them
_STATES = range(4)
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ADDED = {0: 2, 1: 2, 2: 3, 3: 2}  # the one state that a new or changed user or assistant row can lead to
_END = [0, _FAR, _FAR, 0]  # a conversation may end empty or after an assistant
_ROLE = {2: "user", 3: "assistant"}
_INITIALS = "suax"


def code_of(initial: str, fault: int) -> str:
    """A row as one letter: its role's initial, and 0 for sound, 1 for truncated, 2 for what must go."""
    return chr(65 + 3 * _INITIALS.find(initial if initial in _INITIALS[:3] and initial else "x") + fault)


def _moves(code: str) -> list[dict[str, tuple[int, int]]]:
    """For each state the edits of a row: letter -> (cost, next state)."""
    initial, fault = _INITIALS[(ord(code) - 65) // 3], (ord(code) - 65) % 3
    out = []
    for state in _STATES:
        edits = {"D": (DELETE, state)}
        if fault < 2:
            more = TRUNCATED if fault else 0
            edits["R"] = (REROLE + more, _ADDED[state])
            if (state, initial) in _NEXT:
                edits["K"] = (KEEP + more, _NEXT[state, initial])
        out.append(edits)
    return out


_MOVES = {chr(65 + k): _moves(chr(65 + k)) for k in range(12)}
_MOST = max(cost for rows in _MOVES.values() for edits in rows for cost, _ in edits.values())
# the same arcs by where they lead: (from state, cost)
_BACK = {code: [[(state, cost) for state in _STATES for cost, to in rows[state].values() if to == target] for target in _STATES] for code, rows in _MOVES.items()}
_ADDED_BACK = [[state for state in _STATES if _ADDED[state] == target] for target in _STATES]


def distances(codes: str, ends: list[int]) -> list[int]:
    """Dial's algorithm: cost from each node (4 * rows done + state) to the end, whose states cost `ends`.

    Costs of arcs are at most `_MOST`, so the open nodes lie in as many buckets, taken in turn.
    The end's states may begin far apart; a bucket ring reaches no further than its costs, so they
    enter when the queue comes to them.
    """
    n = len(codes)
    found = [_FAR] * (4 * n + 4)
    waiting = sorted((cost, 4 * n + state) for state, cost in enumerate(ends) if cost < _FAR)
    if not waiting:
        return found
    ring: list[list[int]] = [[] for _ in range(_MOST + 1)]
    now, open_nodes = waiting[0][0], 0
    for cost, node in waiting:
        found[node] = cost
    while waiting or open_nodes:
        if not open_nodes:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            ring[now % (_MOST + 1)].append(waiting.pop(0)[1])
            open_nodes += 1
        bucket = ring[now % (_MOST + 1)]
        while bucket:
            node = bucket.pop()
            open_nodes -= 1
            if found[node] != now:
                continue
            row, state = node >> 2, node & 3
            arcs = [(4 * row + before, INSERT) for before in _ADDED_BACK[state]]
            if row:
                arcs += [(4 * row - 4 + before, cost) for before, cost in _BACK[codes[row - 1]][state]]
            for before, cost in arcs:
                if now + cost < found[before]:
                    found[before] = now + cost
                    ring[(now + cost) % (_MOST + 1)].append(before)
                    open_nodes += 1
        now += 1
    return found


def walk(codes: str, found: list[int], state: int, last: bool = True) -> tuple[str, int]:
    """The least letters along tight arcs from a state before the first row, and the state where the walk ends.

    Rows after a segment that isn't its conversation's last one follow at once: inserts there are theirs.
    """
    out, row, n = [], 0, len(codes)
    while last or row < n:
        here, best = found[4 * row + state], None
        if here >= _FAR:
            break
        if row < n:
            edits, after = _MOVES[codes[row]][state], found[4 * row + 4 : 4 * row + 8]
            best = next((x for x in "DKR" if x in edits and here == edits[x][0] + after[edits[x][1]]), None)
        if best != "D" and here == INSERT + found[4 * row + _ADDED[state]]:
            best = "I"  # letters ascend: D, I, K, R
        if best is None:
            break
        out.append(best)
        state = _ADDED[state] if best == "I" else edits[best][1]
        row += best != "I"
    return "".join(out), state


def between(codes: str) -> list[list[int]]:
    """Cost from each state before a segment to each state after it."""
    columns = [distances(codes, [0 if s == end else _FAR for s in _STATES])[:4] for end in _STATES]
    return [[columns[end][start] for end in _STATES] for start in _STATES]


def illegal(codes: str) -> int:
    """Neighbours whose initials aren't su, ua or au."""
    initials = [_INITIALS[(ord(c) - 65) // 3] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


@lru_cache(maxsize=1 << 16)
def settle(codes: str) -> tuple[str, int, int]:
    """Audit, cost and illegal neighbours of a whole conversation."""
    found = distances(codes, _END)
    return walk(codes, found, 0)[0], found[0], illegal(codes)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: [row[k] for row in rows] for k, name in enumerate(schema.names)}, schema)


def _per_row(function, schema: str):
    """A function of a row's values, for mapInArrow."""
    kinds = _arrow(schema)

    def run(batches):
        for batch in batches:
            yield _batch([function(*row.values()) for row in batch.to_pylist()], kinds)

    return run


def _per_conversation(function, schema: str):
    """A function of a conversation's segments in order, for applyInArrow; rows get the key in front."""
    kinds = _arrow(schema)

    def run(key, table):
        rows = function(table.sort_by("block").to_pylist())
        return pa.Table.from_batches([_batch([(key[0].as_py(), *row) for row in rows], kinds)])

    return run


def _chain(rows: list[dict]) -> list[tuple]:
    """What the end of each segment costs from there on, chained from a conversation's last segment to its first."""
    ends, after, out = _END, "", []
    for row in reversed(rows):
        edge = illegal(row["last"] + after) if after else 0
        out.append((row["block"], ends, not after, edge + row["inner"], 0))
        ends = [min(a + b for a, b in zip(row["costs"][4 * s : 4 * s + 4], ends)) for s in _STATES]
        after = row["first"]
    out[-1] = (*out[-1][:-1], ends[0])
    return out


def _starts(rows: list[dict]) -> list[tuple]:
    """The state in which the walk enters each segment, handed from one to the next."""
    state, out = 0, []
    for row in rows:
        out.append((row["block"], state))
        state = row["leads"][state]
    return out


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls are equal; the right side's keys go."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    out = left.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_{k}" for k in keys])


def _audits(segments: DataFrame, kind: str) -> DataFrame:
    """(conv_id, audit, cost, illegal) from the codes of conversations in segments."""
    cut = materialise(segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id"), "repair-cut")
    result = f"conv_id {kind}, audit string, cost long, illegal long"
    none = not cut.limit(1).count()
    whole = (segments if none else _join(segments, cut, ["conv_id"], "left_anti")).select("conv_id", "codes")
    whole = whole.mapInArrow(_per_row(lambda c, codes: (c, *settle(codes)), result), result)
    if none:
        discard(cut)
        return whole
    parts = materialise(_join(segments, cut, ["conv_id"], "left_semi").select("conv_id", "block", "codes"), "repair-parts")
    ends = f"conv_id {kind}, block long, ends array<long>, final boolean, illegal long, cost long"
    costs = f"conv_id {kind}, block long, costs array<long>, first string, last string, inner long"
    across = parts.mapInArrow(_per_row(lambda c, b, codes: (c, b, sum(between(codes), []), codes[0], codes[-1], illegal(codes)), costs), costs)
    chained = materialise(across.groupBy("conv_id").applyInArrow(_per_conversation(_chain, ends), ends), "repair-ends")

    def walks(c, block, codes, ends, final):
        found = distances(codes, ends)
        four = [walk(codes, found, s, final) for s in _STATES]
        return c, block, [x[0] for x in four], [x[1] for x in four]

    leads = f"conv_id {kind}, block long, audits array<string>, leads array<int>"
    walked = _join(parts, chained, ["conv_id", "block"]).select("conv_id", "block", "codes", "ends", "final")
    walked = materialise(walked.mapInArrow(_per_row(walks, leads), leads), "repair-walks")
    start = f"conv_id {kind}, block long, start int"
    starts = walked.select("conv_id", "block", "leads").groupBy("conv_id").applyInArrow(_per_conversation(_starts, start), start)
    pieces = _join(walked, starts, ["conv_id", "block"]).select("conv_id", "block", F.col("audits")[F.col("start")].alias("piece"))
    pieces = _join(pieces, chained.select("conv_id", "block", "cost", "illegal"), ["conv_id", "block"])
    in_order = F.array_sort(F.collect_list(F.struct("block", "piece")))
    long = pieces.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda x: x["piece"]), "").alias("audit"), F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
    return whole.unionByName(long)


def fault_columns(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """Whether a text is blank, whether it is truncated, and a row's initial."""
    ended = F.rtrim(text, F.lit(" \t\n\x0b\f\r"))
    return ended == "", ~F.right(ended, F.lit(1)).isin(".", "!", "?"), F.left(role, F.lit(1))


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None, keep_text: bool = False) -> DataFrame:
    """The cheapest repair of each conversation of `rows` (conv_id, turn, role, text), by the edits of its audit.

    Rows are taken by turn (nulls first), those of one turn by the digest of role and text; a null
    role or text counts as one space. A row's first fault counts: blank, duplicate (its role and text came
    earlier), truncated (the last visible character isn't `.`, `!` or `?`). Edits are K(eep), R(erole), D(elete) and
    I(nsert) at the costs above; blank and duplicate rows must go. The audit has the edits of a cheapest
    repair to roles `(s?(ua)+)?`, the least by ASCII if there are several.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (and
    repaired with `keep_text`) for each conversation, and with zeros, an empty audit and the hash of nothing for each
    of `ids` (conv_id) that has no rows. A null conv_id is a conversation; rows that repeat are duplicates; an
    empty table gives no rows; other columns are ignored. A conversation is cut into segments of 16,384
    rows, so no task holds its rows; its audit must fit one string, and its text is hashed by one
    task as a stream.
    """
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    rows = rows.withColumn("h", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    blank, truncated, initial = fault_columns(F.col("role"), F.col("text"))
    narrow = rows.select("conv_id", "turn", "h", blank.alias("blank"), truncated.alias("cut"), initial.alias("initial"))
    same = narrow.groupBy("conv_id", "turn", "h").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("blank", "cut", "initial")])
    same = materialise(same.withColumn("at", F.struct(F.col("turn").isNotNull().alias("x"), "turn")), "repair-rows")
    firsts = same.groupBy("conv_id", "h").agg(F.count(F.lit(1)).alias("turns"), F.min("at").alias("first_at")).where("turns > 1").drop("turns")
    told = _join(same, firsts, ["conv_id", "h"], "left").withColumn("again", F.coalesce(F.col("at") > F.col("first_at"), F.lit(False)))

    every = F.when(F.col("blank"), 0).otherwise(F.col("n") - F.when(F.col("again"), 0).otherwise(1))
    stats = told.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(every).alias("duplicate"),
        F.count_if(F.col("cut") & ~F.col("blank") & ~F.col("again")).alias("truncated"),
    )
    # a letter for each row: copies are rows of their own, dealt by their number
    fault = F.when(F.col("blank") | F.col("again"), 2).when(F.col("cut"), 1).otherwise(0)
    kind = F.coalesce(*[F.when(F.col("initial") == x, F.lit(k)) for k, x in enumerate(_INITIALS[:3])], F.lit(3))
    lead = told.select("conv_id", "turn", "h", "n", kind.alias("kind"), fault.alias("fault"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 4096))).alias("many"))
    lead = lead.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(4095), F.col("n") - 1 - 4096 * F.col("many")).cast("int"))).alias("few"))
    code = F.char(65 + 3 * F.col("kind") + F.when((F.col("many") == 0) & (F.col("few") == 0), F.col("fault")).otherwise(2))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), *map(F.asc, ("h", "many", "few"))]
    placed = lead.select("conv_id", "turn", "h", "many", "few", code.alias("code")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(placed.select("conv_id", "code", F.monotonically_increasing_id().alias("pos")), "repair-places")
    in_order = F.array_sort(F.collect_list(F.struct("pos", "code")))
    segments = placed.groupBy("conv_id", F.shiftright("pos", SEGMENT_BITS).alias("block")).agg(F.array_join(F.transform(in_order, lambda x: x["code"]), "").alias("codes"))
    segments = materialise(segments, "repair-segments")
    discard(placed)

    known = rows.select("conv_id").distinct() if ids is None else ids.select("conv_id").distinct()
    audits = _audits(segments, rows.schema["conv_id"].dataType.simpleString())
    facts = _join(_join(known, stats, ["conv_id"], "left"), audits, ["conv_id"], "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    facts = facts.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"))
    return _repaired(facts, rows, counts, keep_text)


def _repaired(facts: DataFrame, rows: DataFrame, counts: list[str], keep_text: bool) -> DataFrame:
    """`facts` with the repaired text's hash: a conversation's facts, then its rows, pass through one task as a stream."""
    stream = facts.withColumn("body", F.lit(False)).unionByName(rows.withColumn("body", F.lit(True)), allowMissingColumns=True)
    stream = stream.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "body", F.asc_nulls_first("turn"), "h")
    stream = stream.select("conv_id", *counts, "audit", "body", "role", "text")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string" + (", repaired string" if keep_text else "")
    kinds = _arrow(schema)

    def run(batches):
        fact, edits, state, seen, hashed, kept = None, iter(""), 0, False, sha256(), []

        def add(role: str, text: str) -> None:
            nonlocal seen
            line = ("\n" if seen else "") + f"{role}:{text}"
            seen = True
            hashed.update(line.encode())
            if keep_text:
                kept.append(line)

        def edit() -> str | None:
            """The next edit of a row; what is inserted before it is added."""
            nonlocal state
            for letter in edits:
                if letter != "I":
                    return letter
                state = _ADDED[state]
                add(_ROLE[state], "")

        def close() -> list:
            edit()
            return [*fact, hashed.hexdigest(), *(["".join(kept)] if keep_text else [])]

        for batch in batches:
            out = []
            for conv, *rest, audit, body, role, text in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if not body:
                    if fact:
                        out.append(close())
                    fact, edits, state, seen, hashed, kept = [conv, *rest, audit], iter(audit), 0, False, sha256(), []
                    continue
                letter = edit()
                if letter == "K":
                    state = _NEXT[state, role[:1]]
                    add(role, text)
                elif letter == "R":
                    state = _ADDED[state]
                    add(_ROLE[state], text)
            if out:
                yield _batch(out, kinds)
        if fact:
            yield _batch([close()], kinds)

    return stream.mapInArrow(run, schema)
