"""Orders by arithmetic, caps with replacement, rounds and merges against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import permutation as P
from millrace.operators import select as S

H = lambda s: hashlib.sha256(str(s).encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_epochs(spark, n):
    """Each epoch has every place once, epochs differ, and the way back is the inverse; no exchange in the plan."""
    plan = P.Plan(n, 5, 0, 0, 3 * n)
    rows = P.planned_rows(spark, plan)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    by = {}
    for r in rows.collect():
        by.setdefault(r["epoch"], []).append((r["position"], r["place"]))
    assert [sorted(p for _, p in by[e]) for e in range(3)] == [list(range(n))] * 3
    if n >= 64:
        assert by[0] != [(p - n, x) for p, x in by[1]] and sum(p == x for p, x in by[0]) < n / 4
    back = P.positions_of(spark.range(n).withColumnRenamed("id", "place"), "place", n, 5, 2)
    assert {(r["position"], r["place"]) for r in back.collect()} == set(by[2])
    # a run that begins anywhere goes on as one that began at 0
    rest = P.planned_rows(spark, plan.commit(n + n // 2)).collect()
    assert [tuple(r) for r in rest] == [tuple(r) for r in rows.collect()][n + n // 2 :]


def test_permutation_mixes(spark):
    """Places of neighbours are spread: mean distance near n/3, as of random places."""
    n = 4000
    places = [r["place"] for r in P.planned_rows(spark, P.Plan(n, 9, 0, 0, n)).orderBy("position").collect()]
    mean = sum(abs(a - b) for a, b in zip(places, places[1:])) / n
    assert 0.9 * n / 3 < mean < 1.1 * n / 3


def test_plans_and_log(spark, tmp_path):
    for faulty in ((0, 0, 0, 0), (5, 3, 2, 9), (5, 0, 4, 3), (5, -1, 0, 3)):
        with pytest.raises(ValueError):
            P.Plan(faulty[0], 1, *faulty[1:])
    path = f"file://{tmp_path}/log"
    log = P.PositionLog(spark, path)
    assert log.latest() is None
    plan = P.Plan(10, 1, 4, 4, 30)
    log.append(plan)
    log.append(plan.commit(7))
    assert P.PositionLog(spark, path).latest() == P.Plan(10, 1, 4, 11, 30)
    with pytest.raises(ValueError):
        log.append(plan.commit(3))  # back
    with pytest.raises(ValueError):
        log.append(P.Plan(11, 1, 4, 12, 30))  # another table
    with pytest.raises(ValueError):
        plan.commit(27)
    # a commit that broke off before its success mark counts for nothing
    (tmp_path / "log" / "000000000002").mkdir()
    (tmp_path / "log" / "000000000002" / "part-0.json").write_text("{")
    assert log.latest().committed == 11
    log.append(plan.commit(9))
    assert log.latest().committed == 13


def test_fixed_subset(spark):
    for n, k in ((100, 7), (5, 5), (9, 0), (1, 1)):
        rows = P.fixed_subset(spark, n, k, 3).collect()
        assert [r["stratum"] for r in rows] == list(range(k)) and all(i * n // k <= r["place"] < (i + 1) * n // k for i, r in enumerate(rows))
    with pytest.raises(ValueError):
        P.fixed_subset(spark, 3, 4, 1)


def greedy(rows, total, caps):
    taken, counts = [], {}
    for row in sorted(rows, key=lambda r: r[-1]):
        keys = [(c, row[k + 1]) for k, c in enumerate(caps)]
        if len(taken) < total and all(counts.get(k, 0) < caps[k[0]] for k in keys):
            taken.append(row[0])
            for k in keys:
                counts[k] = counts.get(k, 0) + 1
    return taken


@pytest.mark.parametrize("detail", [4096, 20, 1])
def test_capped_choice(spark, detail):
    """Row by row; a hot group, nulls, groups that never fill up, caps that only just suffice, and too tight ones."""
    rnd = random.Random(detail)
    rows = [(i, rnd.choice(["hot"] * 6 + ["b", "c", None, f"x{i % 40}"]), rnd.choice(["en", "en", "de", None]), H(i)) for i in range(700)]
    frame = spark.createDataFrame(rows, "id long, source string, lang string, h string")
    for total, caps in ((200, {"source": 60, "lang": 90}), (300, {"source": 120, "lang": 300}), (0, {"source": 1, "lang": 1}), (700, {"source": 700, "lang": 700}), (50, {"source": 20, "lang": 17})):
        expected = greedy(rows, total, caps)
        assert len(expected) == total
        assert sorted(r["id"] for r in S.capped_choice(frame, total, caps, "h", detail).collect()) == sorted(expected)
    with pytest.raises(ValueError, match="of 300"):
        S.capped_choice(frame, 300, {"source": 5, "lang": 90}, "h", detail)


def test_top_up_quotas(spark):
    rnd = random.Random(6)
    for _ in range(6):
        sizes = {f"f{i}": rnd.choice([0, 1, 2, 9, 40]) for i in range(rnd.randint(1, 7))}
        total = rnd.randint(0, sum(sizes.values()) + 5)
        quotas = {f: min(n, total // len(sizes)) for f, n in sizes.items()}
        while sum(quotas.values()) < total and any(quotas[f] < n for f, n in sizes.items()):
            for f in sorted(sizes):
                if quotas[f] < sizes[f] and sum(quotas.values()) < total:
                    quotas[f] += 1
        frame = spark.createDataFrame(list(sizes.items()), "family string, n long")
        assert {r["family"]: r["quota"] for r in S.top_up_quotas(frame, total).collect()} == quotas


def test_proportional_merge(spark):
    """Every prefix within one row of each share; ties by source; nulls are a source."""
    from fractions import Fraction

    rows = [(s, H(f"{s}{i}")) for s, n in (("a", 40), ("b", 40), ("c", 7), (None, 13), ("d", 1)) for i in range(n)]
    got = S.proportional_merge(spark.createDataFrame(rows, "source string, h string"), "source", ["h"]).collect()
    rank = {}
    for s in {r[0] for r in rows}:
        rank.update({(s, h): k for k, h in enumerate(sorted(h for t, h in rows if t == s), 1)})
    size = {s: sum(r[0] == s for r in rows) for s, _ in rows}
    expected = sorted(rows, key=lambda r: (Fraction(2 * rank[r] - 1, size[r[0]]), r[0] is not None, r[0] or ""))
    assert [(r["source"], r["h"]) for r in sorted(got, key=lambda r: r["place"])] == expected
    assert sorted(r["place"] for r in got) == list(range(1, len(rows) + 1))
    assert S.proportional_merge(spark.createDataFrame([], "source string, h string"), "source", ["h"]).collect() == []
