"""Components from shared buckets, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import bounded, connected_components, discard, materialise

CROWD = 32  # ids of a bucket beyond which its last pairs are found by their rarest n-grams instead
BROADCAST_GRAMS = 2_000_000  # of a long each, of all centres
SINGLE, KIND = 1, 2  # bits of a bucket if linked ids meet in several: one that is enough by itself; the kind that counts by itself
REFINED = 16  # crowded buckets of an id, up to which pairs of them take their place


def _kind() -> Column:
    return F.col("bucket").bitwiseAND(KIND).alias("kind")


def _single() -> Column:
    return F.col("bucket").bitwiseAND(SINGLE) > 0


def agreeing(rows: DataFrame, agree: int) -> DataFrame:
    """The rows (bucket, id) of ids that can meet another one often enough.

    Linked ids meet in `agree` buckets of a kind, or in one that is marked SINGLE. So an id
    with fewer buckets of a kind is none of their ends there, nor is what is alone in a bucket then.
    """
    several = rows.where(~_single()).groupBy("id", _kind()).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= agree).drop("n")
    left = rows.where(~_single()).withColumn("kind", _kind()).join(several, ["id", "kind"], "left_semi").select(*rows.columns)
    left = left.unionByName(rows.where(_single()))
    met = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return left.join(met, "bucket", "left_semi").select(*rows.columns)


def refined_crowds(crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole, parts) of crowded buckets (bucket, id, component, m) that ids must share two of: those that stay, and pairs of the others, as SINGLE buckets.

    Unrelated ids that share one bucket seldom share two. Buckets of ids with more than
    REFINED of a kind stay, as these would be in too many pairs; if linked ids share a bucket
    that stays, they meet there, and else all that they share are in pairs.
    """
    many = crowd.groupBy("id", _kind()).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REFINED).select("id", "kind")
    stay = crowd.where(~_single()).withColumn("kind", _kind()).join(many, ["id", "kind"], "left_semi").select("bucket")
    stay = materialise(stay.unionByName(crowd.where(_single()).select("bucket")).distinct(), "stay")
    lists = crowd.join(stay, "bucket", "left_anti").groupBy("id", "component", _kind()).agg(F.sort_array(F.collect_list("bucket")).alias("b"))
    pairs = F.flatten(F.transform("b", lambda x, i: F.transform(F.slice("b", i + 2, F.size("b")), lambda y: F.xxhash64(x, y).bitwiseOR(SINGLE))))
    parts = lists.select(F.explode(pairs).alias("bucket"), "id", "component")
    mixed = parts.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")).where("low < high")
    parts = materialise(parts.join(mixed.select("bucket", "m"), "bucket").select("bucket", "id", "component", "m"), "parts")
    return crowd.join(stay, "bucket", "left_semi").select("bucket", "id", "component", "m"), parts


def pivot_pairs(rows: DataFrame, agree: int = 1) -> DataFrame:
    """(a, b): each id of `rows` (bucket, id, k) with one pivot of its buckets.

    A bucket's pivot is the id with the largest k, its number of buckets in all, as
    what is central in a group of near copies agrees with others most often; an id
    goes with the pivot that it shares most buckets with. So a bucket of n near copies
    costs n pairs, not n * n. Pairs that meet in fewer than `agree` of them are left out.
    """
    pivots = rows.groupBy("bucket").agg(F.max(F.struct("k", "id")).alias("p"), F.count(F.lit(1)).alias("m"))
    pivots = materialise(pivots.where("m > 1").select("bucket", F.col("p.id").alias("pivot")), "pivots")
    seen = rows.join(pivots, "bucket").where("id <> pivot")
    if agree > 1:
        seen = seen.groupBy("id", "pivot", _kind()).agg(F.count(F.lit(1)).alias("k"), F.max(_single()).alias("single")).where(F.col("single") | (F.col("k") >= agree))
        seen = seen.groupBy("id", "pivot").agg(F.sum("k").alias("k"))
    else:
        seen = seen.groupBy("id", "pivot").agg(F.count(F.lit(1)).alias("k"))
    best = seen.groupBy("id").agg(F.max(F.struct("k", "pivot")).alias("m")).select("id", "m.pivot")
    return best.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def centred_sets(rows: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(grp, id, n, apart, s, hub_s, hub) of the ids of `rows` (bucket, id, component): each set by what sets it apart from its groups.

    Buckets with the same commonest component are a group; its centre has the n-grams that
    more than half of its sets have. `apart` is the symmetric difference of a set and the
    centre. Sets x and y link if the symmetric difference of theirs has at most
    (100 - percent) (x + y) / (100 + percent) n-grams, and it is that of x.apart and
    y.apart. So with s = (100 + percent) |apart| - (100 - percent) n, sets with
    s_x + s_y <= 0 link for sure, and then both link with `hub`, the set of least s.
    Others link only if x.apart and y.apart have (s_x + s_y) / 2 / (100 + percent) in common.
    """
    most = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top")).select("bucket", F.col("top.component").alias("grp"))
    groups = materialise(rows.select("bucket", "id").join(most, "bucket").select("grp", "id").distinct(), "groups")
    held = materialise(grams.join(groups, "id").select("grp", "id", "gram"), "grams")
    most = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    core = held.groupBy("grp", "gram").agg(F.count(F.lit(1)).alias("df")).join(most, "grp").where("2 * df > m")
    core = materialise(core.groupBy("grp").agg(F.collect_list("gram").alias("core")), "centres")
    sets = held.groupBy("grp", "id").agg(F.collect_list("gram").alias("g")).join(bounded(core, BROADCAST_GRAMS, "core"), "grp", "left")
    core_ = F.coalesce("core", F.array().cast("array<long>"))
    sets = sets.select("grp", "id", F.size("g").cast("long").alias("n"), F.concat(F.array_except("g", core_), F.array_except(core_, "g")).alias("apart"))
    sets = materialise(sets.withColumn("s", (100 + percent) * F.size("apart").cast("long") - (100 - percent) * F.col("n")), "sets")
    hubs = materialise(sets.groupBy("grp").agg(F.min(F.struct("s", "id")).alias("h")).select("grp", F.col("h.s").alias("hub_s"), F.col("h.id").alias("hub")), "hubs")
    out = materialise(sets.join(hubs, "grp"), "apart")
    discard(groups, held, core, sets, hubs)
    return out


def prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that can have a Jaccard similarity of `percent`.

    `sets` are `centred_sets`, `labels` (id, component) after the links with the hubs. The
    order of n-grams is rarest first, and before that those of one component. Of two sets that link the one of smaller s, y, has in
    common with x, (s_x + s_y) / 2 / (100 + percent) of `apart` at least, so the rarest lies
    at that many or more from the end of both. If y's component is its hub's, x's isn't,
    and s_x > -hub_s; else s_x >= s_y. N-grams that one component has to itself take up the
    first places and make no pairs. Of near copies of one base, what sets one apart is mostly its own, so
    those that differ too much drop out however many they are.
    """
    twice = 2 * (100 + percent)
    named = sets.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    home = labels.select(F.col("id").alias("hub"), F.col("component").alias("home"))
    named = named.join(home, "hub", "left").withColumn("home", F.coalesce("home", "hub"))
    # a group whose sets are all linked by now makes no pairs
    mixed = named.groupBy("grp").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("grp")
    named = named.withColumn("d", F.size("apart").cast("long")).drop("hub").join(mixed, "grp", "left_semi")
    # the last places from which a set can meet others, as x and as y below
    last = f"greatest(if(s + hub_s > 0, d - ceil((s + hub_s) / {twice}) + 1, 0), d - greatest(1, ceil(if(component = home, s - hub_s + 1, 2 * s) / {twice})) + 1)"
    # a set that can't meet any other isn't counted either
    named = materialise(named.withColumn("last", F.expr(last)).where("last > 0"), "named")
    rows = named.select("grp", "id", "component", F.explode("apart").alias("gram"))
    spread = rows.groupBy("grp", "gram").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    spread = materialise(spread.where("low < high").select("grp", "gram", "df"), "spread")
    # what isn't spread comes first, so its places needn't be listed
    listed = rows.join(spread, ["grp", "gram"]).groupBy("grp", "id").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    listed = listed.join(named.drop("apart"), ["grp", "id"]).withColumn("alone", F.col("d") - F.size("g"))
    kept = F.filter(F.transform("g", lambda x, i: F.struct((F.col("alone") + i + 1).alias("at"), x["gram"].alias("gram"))), lambda x: x["at"] <= F.col("last"))
    places = materialise(listed.withColumn("g", kept).select(*[c for c in named.columns if c not in ("apart", "last")], F.inline("g")), "places")
    side = lambda p: places.select("grp", "gram", *[F.col(c).alias(p + c) for c in ("id", "component", "n", "d", "s", "hub_s", "home", "at")])
    x = side("x_").where(f"x_s + x_hub_s > 0 and x_at <= x_d - ceil((x_s + x_hub_s) / {twice}) + 1")
    y = side("y_").where(f"y_at <= y_d - greatest(1, ceil(if(y_component = y_home, y_s - y_hub_s + 1, 2 * y_s) / {twice})) + 1")
    need = f"ceil((x_s + y_s) / {twice})"
    met = x.join(y, ["grp", "gram"]).where(
        f"(x_s > y_s or x_s = y_s and x_id > y_id) and x_component <> y_component and 100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n) "
        f"and x_at <= x_d - {need} + 1 and y_at <= y_d - {need} + 1"
    )
    out = materialise(met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct(), "pairs")
    discard(named, spread, places)
    return out


def components_from_buckets(
    shared: DataFrame, grams_of: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], percent: int, agree: int = 1
) -> DataFrame:
    """(id, component) of ids with links: components of the links that lie within buckets.

    `shared` has distinct rows (bucket, id, k), k the number of the id's rows: any two
    linked ids meet in some bucket. `verify` takes pairs (a, b) and returns them with a
    column `linked`; links are Jaccard similarities of at least `percent` of the sets
    (id, gram) that `grams_of` returns for rows (id, ...). Every id is compared with a
    pivot of its buckets, and those of large buckets that have no link with a second one
    among themselves. Then only buckets with several components are left. Ids of large
    ones that are near the centre of their group are linked through its hub
    (`centred_sets`). Of small ones all pairs of different components are compared, of
    larger ones those that `prefix_pairs` leaves. If linked ids meet in `agree` > 1 buckets of a
    kind (`agreeing`), ids and pairs that don't are left out on the way. So no link between components is lost, and no group is
    expanded into all its pairs.
    """
    first = materialise(verify(pivot_pairs(shared, agree)), "verdicts")
    ends = F.explode(F.array("a", "b")).alias("id")
    sizes = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    large = materialise(sizes.where(F.col("m") > CROWD).select("bucket"), "large")
    tried = first
    if not large.isEmpty():
        rows = shared.join(large, "bucket", "left_semi").join(first.where("linked").select(ends).distinct(), "id", "left_anti")
        rows = materialise(rows, "unlinked")
        second = materialise(verify(pivot_pairs(rows, agree).join(first, ["a", "b"], "left_anti")), "verdicts")
        tried = first.unionByName(second)
    labels = connected_components(tried.where("linked"))

    def still_mixed(of: DataFrame, labels: DataFrame) -> DataFrame:
        """(bucket, id, component, m) of the buckets with several components."""
        named = of.select("bucket", "id").join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m"))
        mixed = materialise(mixed.where("low < high").select("bucket", "m"), "mixed")
        rows = materialise(named.join(mixed, "bucket"), "open")
        discard(mixed)
        return rows

    rows = still_mixed(shared, labels)
    if agree > 1:
        before, rows = rows, still_mixed(agreeing(rows.select("bucket", "id"), agree), labels)
        discard(before)
    crowd, few = rows.where(F.col("m") > CROWD), rows.where(F.col("m") <= CROWD)
    crowded = crowds = None
    if agree > 1 and not crowd.isEmpty():
        # ids that meet in a small bucket too are compared there
        crowds = materialise(crowd.groupBy("id", _kind()).agg(F.count(F.lit(1)).alias("c")), "crowds")
        crowd, parts = refined_crowds(agreeing(crowd, agree))
        crowd = crowd.unionByName(parts.where(F.col("m") > CROWD))
        few = few.unionByName(parts.where(F.col("m") <= CROWD))
    if not crowd.isEmpty():
        sets = centred_sets(crowd, grams_of(crowd.select("id").distinct()), percent)
        labels = merged(labels, sets.where("s + hub_s <= 0 and id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
        crowded = prefix_pairs(sets, labels, percent)
        few = still_mixed(few, labels)
        discard(sets)
    side = lambda p: few.select("bucket", F.col("id").alias(p), F.col("component").alias(f"{p}_component"))
    pairs = side("a").join(side("b"), "bucket").where("a < b and a_component <> b_component")
    if agree > 1:
        pairs = pairs.groupBy("a", "b", _kind()).agg(F.count(F.lit(1)).alias("n"), F.max(_single()).alias("single"))
        if crowds is not None:
            both = [crowds.select(F.col("id").alias(p), "kind", F.col("c").alias(f"c_{p}")) for p in "ab"]
            pairs = pairs.join(both[0], ["a", "kind"], "left").join(both[1], ["b", "kind"], "left")
            pairs = pairs.withColumn("n", F.col("n") + F.least(F.coalesce("c_a", F.lit(0)), F.coalesce("c_b", F.lit(0))))
        pairs = pairs.where(F.col("single") | (F.col("n") >= agree))
    pairs = pairs.select("a", "b").distinct()
    if crowded is not None:
        pairs = pairs.unionByName(crowded).distinct()
    last = materialise(verify(pairs.join(tried, ["a", "b"], "left_anti")), "verdicts")
    out = merged(labels, last.where("linked"))
    discard(first, large, rows, few, last, *([crowded] if crowded is not None else []))
    return out


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links; `labels` itself if there is none, and else it is discarded."""
    if links.isEmpty():
        return labels
    out = connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b")))
    discard(labels)
    return out
