"""Deterministic selection: quotas by rank, ownership across sources, apportionment, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RANK_DIGITS = 4  # hex digits of a digest that make a bin, at most: 65,536 bins a group, 1.5 million rows each at 10**11
BIN_BYTES = 1 << 20  # of the tables that are read, for each bin


def rank_digits(df: DataFrame) -> int:
    """How many digits cut what `df` reads into bins of about BIN_BYTES; 0 for tables of less. A matter of the plan, not of the result."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return next((k for k in range(RANK_DIGITS) if BIN_BYTES * 16**k >= size), RANK_DIGITS)


def running_total(df: DataFrame, groups: list[str], order: list[str], size: str, name: str = "running", rank: str | None = None, digits: int | None = None) -> DataFrame:
    """`df` with `name`, the sum of `size` from a group's first row to this one, without a task for each group.

    `rank` (the first of `order` unless named) is a hex digest, so its first digits cut a
    group into even bins in order; bins are summed, and only rows of one bin are ordered
    together. Columns of `order` before it should have few values; they are part of the bin.
    The number of digits follows the size of the tables; small ones are one bin a group.
    """
    rank = rank or order[0]
    lead = order[: order.index(rank)]
    digits = rank_digits(df) if digits is None else digits
    if not digits:
        return df.withColumn(name, F.sum(size).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    keys = [*groups, *lead, "_bin"]
    binned = df.withColumn("_bin", F.coalesce(F.left(rank, F.lit(digits)), F.lit("")))
    sums = binned.groupBy(*keys).agg(F.sum(size).alias("_s"))
    w = Window.partitionBy(*groups).orderBy(*lead, "_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_before", F.sum("_s").over(w) - F.col("_s")).select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)]
    v = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = binned.join(sums, same).withColumn(name, F.col("_before") + F.sum(size).over(v))
    return out.drop("_bin", "_before", *[f"_{i}" for i in range(len(keys))])


def prefix_by_quota(df: DataFrame, group: str, order: list[str], size: str, target: str, rank: str | None = None) -> DataFrame:
    """Whole rows in order until a group's sizes reach its target: a row stays if those before it fall short."""
    return running_total(df, [group], order, size, rank=rank).where(F.col("running") - F.col(size) < F.col(target))


def prefix_by_quota_windowed(df: DataFrame, group: str, order: list[str], size: str, target: str) -> DataFrame:
    """The same rows by one window over whole groups: for small tables, and to hold the other against."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") - F.col(size) < F.col(target))


def owned_selection(candidates: DataFrame, nodes: list[tuple[str, Column, int]], identity: str, order: list[str], size: str) -> DataFrame:
    """(node, *columns, running): each node in turn takes its prefix of what earlier nodes left.

    A node is (name, which candidates it may take, target). A row that an earlier
    node chose is gone for later ones; a row that it passed over is still there.
    Chosen identities are written to the checkpoint folder after each node.
    """
    taken, out = None, None
    for name, eligible, target in nodes:
        pool = candidates.where(eligible)
        if taken is not None:
            pool = pool.join(taken, identity, "left_anti")
        chosen = prefix_by_quota(pool.withColumn("node", F.lit(name)).withColumn("_t", F.lit(target)), "node", order, size, "_t").drop("_t").checkpoint()
        out = chosen if out is None else out.unionByName(chosen)
        ids = chosen.select(identity)
        taken = ids if taken is None else taken.union(ids)
    return out


def apportion(df: DataFrame, weight: str, total: int, tie: str) -> DataFrame:
    """Whole shares of `total` by largest remainder; equal remainders go to the larger tie-break value."""
    every = Window.partitionBy()
    exact = df.withColumn("_q", F.col(weight) * F.lit(float(total)) / F.sum(weight).over(every)).withColumn("_f", F.floor("_q").cast("long"))
    left = F.lit(total) - F.sum("_f").over(every)
    order = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), F.desc(tie)))
    return exact.withColumn("share", F.col("_f") + F.when(order <= left, 1).otherwise(0)).drop("_q", "_f")


def top_by_hash(df: DataFrame, group: str, key: str, k: int, seed: str) -> DataFrame:
    """`k` rows of each group, in an order that a seed gives and input order doesn't change."""
    w = Window.partitionBy(group).orderBy(F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(key).cast("string")), 256), key)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def hash_share(c: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 12 hex digits of a seeded hash."""
    return F.conv(F.left(F.sha2(F.concat_ws("\x1f", F.lit(seed), c.cast("string")), 256), F.lit(12)), 16, 10).cast("double") / F.lit(float(1 << 48))


def split_groups(groups: DataFrame, family: str, group: str, size: str, shares: dict[str, float]) -> DataFrame:
    """(family, group, split): whole groups, largest first, each to the split that lacks most.

    The greedy pass is sequential, so it runs once per family over the table of
    groups (not rows), whose sizes are summed before.
    """
    names = list(shares)

    def assign(key, frame):
        frame = frame.sort_values([size, group], ascending=[False, True])
        need = {n: shares[n] * frame[size].sum() for n in names}
        out = []
        for s in frame[size]:
            best = max(names, key=lambda n: (need[n], -names.index(n)))
            need[best] -= s
            out.append(best)
        frame["split"] = out
        return frame[[family, group, "split"]]

    kinds = dict(groups.dtypes)
    return groups.groupBy(family).applyInPandas(assign, f"{family} {kinds[family]}, {group} {kinds[group]}, split string")


def capped_choice(rows: DataFrame, total: int, caps: dict[str, int], rank: str, detail: int = 4096) -> DataFrame:
    """`total` rows in order of `rank`, passing over those whose group is full: no value of a column in `caps` has more rows than its cap.

    A row that a full group turns away is replaced by the next one in order whose groups have room, as if rows
    were taken one by one. `rank` is a hex digest, one a row, without nulls. What is taken of a group ends at one rank, so the
    work is to find those ranks: bins of digests, counted by group, are taken whole while all caps hold, and only bins
    in which a group fills up are cut finer, down to `detail` rows that the driver goes through. At most total / cap
    values of a column can fill up, so the number of counts doesn't depend on the table. A group that is too small
    to fill up isn't told apart. ValueError if the caps leave fewer than `total` rows; nulls are a group.
    """
    busy = {}
    for c, cap in caps.items():
        full = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap)
        busy[c] = full.select(c, F.monotonically_increasing_id().alias(f"_g{c}")).checkpoint()
    narrow = rows
    for c, named in busy.items():
        named = named.select(F.col(c).alias("_v"), f"_g{c}")
        narrow = narrow.join(F.broadcast(named), F.col(c).eqNullSafe(F.col("_v")), "left").drop("_v")
    groups = [f"_g{c}" for c in caps]
    narrow = narrow.select(F.col(rank).alias("_rank"), *groups).checkpoint()
    most = dict(zip(groups, caps.values()))
    taken: dict = {}  # (column, group) -> rows; of groups that can fill up
    ends: dict = {}  # (column, group) -> the last rank that may be taken
    state = {"n": 0, "end": None}

    def room(row) -> bool:
        return not any((g, row[g]) in ends for g in groups)

    def add(row, n: int, upto: str) -> None:
        state["n"] += n
        if state["n"] == total:
            state["end"] = upto
        for g in groups:
            if row[g] is not None:
                taken[g, row[g]] = taken.get((g, row[g]), 0) + n

    def close(upto: str) -> None:
        ends.update({k: upto for k, n in taken.items() if n == most[k[0]] and k not in ends})

    def fits(cells) -> bool:
        more: dict = {}
        for row in cells:
            for g in groups:
                if row[g] is not None:
                    more[g, row[g]] = more.get((g, row[g]), 0) + row["n"]
        return state["n"] + sum(row["n"] for row in cells) <= total and all(taken.get(k, 0) + n <= most[k[0]] for k, n in more.items())

    def take(prefix: str, size: int) -> None:
        inside = narrow.where(F.startswith(F.col("_rank"), F.lit(prefix))) if prefix else narrow
        if size <= detail or len(prefix) >= 60:
            for row in sorted(inside.collect(), key=lambda r: r["_rank"]):
                if state["end"] is None and room(row):
                    add(row, 1, row["_rank"])
                    close(row["_rank"])
            return
        digit = F.substring("_rank", len(prefix) + 1, 1)
        cells = inside.groupBy(digit.alias("digit"), *groups).agg(F.count(F.lit(1)).alias("n")).collect()
        for d in sorted({row["digit"] for row in cells}):
            if state["end"] is not None:
                return
            own = [row for row in cells if row["digit"] == d]
            live = [row for row in own if room(row)]
            if fits(live):
                for row in live:
                    add(row, row["n"], prefix + d + "g")  # beyond every digest of the bin
                close(prefix + d + "g")
            else:
                take(prefix + d, sum(row["n"] for row in own))

    if total > 0:
        take("", narrow.count())
    if state["n"] < total:
        raise ValueError(f"the caps leave {state['n']} rows of {total}")
    out = rows.where(F.col(rank) <= (state["end"] if total > 0 else ""))
    for c, named in busy.items():
        session = rows.sparkSession
        last = session.createDataFrame([(g, e) for (col, g), e in ends.items() if col == f"_g{c}"], f"_g{c} long, _end string")
        last = named.join(F.broadcast(last), f"_g{c}").select(F.col(c).alias("_v"), "_end")
        out = out.join(F.broadcast(last), F.col(c).eqNullSafe(F.col("_v")), "left").where("_end is null or " + f"`{rank}` <= _end").drop("_v", "_end")
    return out


def top_up_quotas(families: DataFrame, total: int, family: str = "family", available: str = "n") -> DataFrame:
    """`families` (a row each, with the rows they have) with `quota`: equal shares, and what the small ones lack dealt in rounds.

    Round k gives one more row to each family that has it, in order of family, until `total` is met or no
    family has any left. Rounds have a closed form: all families get K full rounds, as many as fit, and the
    first ones with more to give get one row of round K + 1.
    """
    every = Window.partitionBy()
    base = families.withColumn("_base", F.least(F.col(available), F.expr(f"{int(total)}L div count(1) over ()")))
    spare = base.withColumn("_spare", F.col(available) - F.col("_base")).withColumn("_lack", F.lit(int(total)) - F.sum("_base").over(every))
    up = Window.partitionBy().orderBy("_spare", family).rowsBetween(Window.unboundedPreceding, -1)
    # with families in order of what they can spare: rounds that fit if all before this one are used up
    steps = spare.withColumn("_used", F.coalesce(F.sum("_spare").over(up), F.lit(0))).withColumn("_left", F.count(F.lit(1)).over(every) - F.coalesce(F.count(F.lit(1)).over(up), F.lit(0)))
    steps = steps.withColumn("_level", F.expr("(_lack - _used) div _left"))
    first = F.min(F.when(F.col("_level") < F.col("_spare"), F.struct("_spare", family, "_level"))).over(every)["_level"]
    fits = steps.withColumn("_k", F.coalesce(first, F.max("_spare").over(every)))
    given = fits.withColumn("_given", F.least("_spare", "_k"))
    more = F.row_number().over(Window.partitionBy().orderBy((F.col("_spare") > F.col("_k")).desc(), family))
    rest = F.col("_lack") - F.sum("_given").over(every)
    last = (F.col("_spare") > F.col("_k")) & (more <= rest)
    return given.withColumn("quota", F.col("_base") + F.col("_given") + last.cast("long")).select(*families.columns, "quota")


def proportional_merge(rows: DataFrame, source: str, order: list[str], place: str = "place") -> DataFrame:
    """`rows` with their places, from 1, in a merge of the sources in which every prefix has each source within one row of its share.

    The r-th row of a source with q rows is due at (r - 1/2) / q; equal times go by source. A place is the sum over the
    sources of what is due before, so rows aren't sorted together; the work of a row is the number of
    sources, whose counts are sent to all tasks. `order` is as in `running_total`.
    """
    ranked = running_total(rows.withColumn("_one", F.lit(1)), [source], order, "_one", "_r")
    counts = rows.groupBy(source).agg(F.count(F.lit(1)).alias("q"))
    every = counts.agg(F.sort_array(F.collect_list(F.struct(F.col(source).alias("s"), "q"))).alias("_all"))
    big = ranked.crossJoin(F.broadcast(every))  # one row
    exact = lambda c: c.cast("decimal(20,0)")
    own = F.filter("_all", lambda x: x["s"].eqNullSafe(F.col(source)))[0]["q"]
    due = exact(2 * F.col("_r") - 1)
    big = big.withColumn("_q", own).withColumn("_due", due)

    def before(x: Column) -> Column:
        earlier = F.coalesce(x["s"] < F.col(source), x["s"].isNull() & F.col(source).isNotNull())
        reach = F.col("_due") * exact(x["q"]) + exact(F.col("_q")) - F.when(earlier, 0).otherwise(1)
        return F.call_function("div", reach, exact(2 * F.col("_q")))

    placed = F.aggregate(F.transform("_all", before), F.lit(0).cast("long"), lambda a, b: a + b) + 1
    return big.withColumn(place, placed).drop("_one", "_r", "_all", "_q", "_due")
