"""Stages of the matcher on hand-made cases."""

import datetime
import itertools
import random

from pyspark.sql import functions as F

from ledgerloom.operators import claim, linkage, pool, reference_match, subset_sum
from ledgerloom.plans.reconcile import keep, tier1

DAY = datetime.date(2026, 8, 10)
S = "settlement_id string, amount_minor long, currency string, settled_at date, utr string, end_to_end_id string, invoice_id string, order_id string, payment_id string"
C = "credit_id string, amount_minor long, currency string, value_date date, booking_date date, narration string"


def settled(spark, *rows):
    return spark.createDataFrame([(i, a, c, d, u, None, inv, None, None) for i, a, c, d, u, inv in rows], S)


def credit(spark, *rows):
    return spark.createDataFrame([(i, a, c, d, d, n) for i, a, c, d, n in rows], C)


def test_reference_stage(spark):
    s = settled(spark, ("s1", 1000, "INR", DAY, "UTRAAAA1", "INV-1001"), ("s2", 2000, "INR", DAY, "UTRBBBB2", "INV-1002"), ("s3", 500, "INR", DAY, "SHARED99", None), ("s4", 500, "INR", DAY, "SHARED99", None))
    c = credit(
        spark, ("exact", 1000, "INR", DAY, "pay utraaaa1"), ("near", 990, "INR", DAY, "inv-1001"), ("part", 500, "INR", DAY, "x UTRBBBB2"), ("over", 9000, "INR", DAY, "UTRBBBB2"), ("money", 1000, "USD", DAY, "UTRAAAA1"),
        ("two", 1000, "INR", DAY, "UTRAAAA1 UTRBBBB2"), ("shared", 500, "INR", DAY, "SHARED99"), ("longer", 1000, "INR", DAY, "XUTRAAAA1X"),
    )
    got = {r["bank_txn_id"]: (r["resolution"], float(r["confidence"])) for r in reference_match.match_by_reference(c, s).collect()}
    assert got == {"exact": ("MATCHED", 0.99), "near": ("MATCHED", 0.93), "part": ("PARTIAL", 0.89), "over": ("UNMATCHED", 0.20), "money": ("UNMATCHED", 0.10), "two": ("AMBIGUOUS", 0.30)}


def test_pool_rules(spark):
    day = datetime.timedelta(days=1)
    s = settled(spark, ("ok", 50, "INR", DAY, "u1", None), ("old", 50, "INR", DAY - 31 * day, "u2", None), ("edge", 50, "INR", DAY - 30 * day, "u3", None), ("soon", 50, "INR", DAY + day, "u4", None), ("later", 50, "INR", DAY + 2 * day, "u5", None), ("big", 300, "INR", DAY, "u6", None), ("usd", 50, "USD", DAY, "u7", None), ("none", 50, "INR", None, "u8", None), ("zero", 0, "INR", DAY, "u9", None))
    got = pool.candidate_pool(credit(spark, ("c", 100, "INR", DAY, "")), s).orderBy("pool_rank").collect()
    assert [r["settlement_id"] for r in got] == ["ok", "soon", "edge", "none"] and not got[0]["truncated"]
    many = settled(spark, *[(f"s{i:03d}", 10, "INR", DAY, f"u{i}", None) for i in range(84)])
    got = pool.candidate_pool(credit(spark, ("c", 100, "INR", DAY, "")), many).collect()
    assert len(got) == 64 and all(r["truncated"] for r in got)


def test_search_finds_all_best_subsets():
    assert subset_sum.search([700, 600, 400, 300], 1000, 0)[:2] == (0, [(0, 3), (1, 2)])
    best, kept, _, nodes, spent, _ = subset_sum.search(list(range(1200, 1000, -1)), 5005, 0, budget=50_000)
    assert spent and nodes == 50_001
    rng = random.Random(5)
    for _ in range(60):
        a = sorted((rng.randint(1, 400) for _ in range(rng.randint(1, 10))), reverse=True)
        target, tol = rng.randint(1, 900), rng.choice([0, 5, 100])
        all_ = [(abs(sum(a[i] for i in s) - target), s) for k in range(1, 9) for s in itertools.combinations(range(len(a)), k)]
        near = sorted(g for g, _ in all_ if g <= tol)
        best, kept, second, _, _, after = subset_sum.search(a, target, tol)
        assert best == (near[0] if near else None)
        if near:
            assert kept == sorted(s for g, s in all_ if g == best)[: subset_sum.RIVALS]
            assert second == next((g for g in near if g > best), None)
            assert after == (None if second is None else min(s for g, s in all_ if g == second))


def slow_search(amounts, target, tolerance, cardinality, budget):
    """The tree walked node by node, in order, up to the budget."""
    hits, nodes = [], 0

    def walk(start, sum_, path):
        nonlocal nodes
        nodes += 1
        if nodes > budget:
            return False
        if path and abs(sum_ - target) <= tolerance:
            hits.append((abs(sum_ - target), path))
        room = cardinality - len(path)
        for i in range(start, len(amounts) if room else start):
            if sum_ + sum(amounts[i : i + room]) < target - tolerance:
                break
            if sum_ + amounts[i] <= target + tolerance and not walk(i + 1, sum_ + amounts[i], (*path, i)):
                return False
        return True

    spent = not walk(0, 0, ())
    gaps = sorted({g for g, _ in hits})
    of = lambda k: sorted(p for g, p in hits if g == gaps[k])
    return (gaps[0], of(0)[: subset_sum.RIVALS], gaps[1] if gaps[1:] else None, nodes, spent, of(1)[0] if gaps[1:] else None) if hits else (None, [], None, nodes, spent, None)


def test_search_equals_the_ordered_walk_within_any_budget():
    rng = random.Random(4)
    for _ in range(300):
        a = sorted((rng.randint(1, rng.choice([30, 400])) for _ in range(rng.randint(0, 22))), reverse=True)
        args = a, rng.randint(1, 900), rng.choice([0, 5, 100]), rng.randint(1, 8), rng.choice([1, 2, 7, 50, 500, 10**6])
        assert subset_sum.search(*args) == slow_search(*args)


def test_tie_is_not_a_match(spark):
    s = settled(spark, *[(f"s{a}", a, "INR", DAY, f"u{a}", None) for a in (300, 700, 400, 600)])
    row = tier1(credit(spark, ("c", 1000, "INR", DAY, "")), s, tolerance=0).first()
    assert row["resolution"] == "TIE_AMBIGUOUS" and float(row["confidence"]) == 0.20


def fold(credits, settlements, tolerance=100):
    """The sequential reading: oldest credit first, each match takes its settlements."""
    free, out = dict(settlements), {}
    for cid, amount, day in sorted(credits, key=lambda c: (c[2], c[0])):
        near = sorted((abs((day - d).days), s) for s, (a, d) in free.items() if 0 < a <= amount + tolerance and -1 <= (day - d).days <= 30)[:64]
        ids = [s for _, s in near]
        r = subset_sum.solve(ids, [free[s][0] for s in ids], amount, False, tolerance=tolerance)
        out[cid] = (r[0], tuple(r[1]))
        if r[0] == "MATCHED":
            for s in r[1]:
                del free[s]
    return out


def test_parallel_rounds_equal_the_fold(spark):
    rng = random.Random(11)
    rows = [(f"s{i:03d}", rng.randint(1, 30) * 1000, DAY + datetime.timedelta(days=rng.randint(0, 60))) for i in range(60)]
    asked = [(f"c{i:02d}", rng.randint(5, 60) * 1000, DAY + datetime.timedelta(days=rng.randint(0, 70))) for i in range(25)]
    s = settled(spark, *[(i, a, "INR", d, "u" + i, None) for i, a, d in rows])
    c = credit(spark, *[(i, a, "INR", d, "") for i, a, d in asked])
    got = {r["credit_id"]: (r["resolution"], tuple(r["settlement_ids"])) for r in subset_sum.match_subsets(c, s, cardinality=8, keep=keep).collect()}
    assert got == fold(asked, {i: (a, d) for i, a, d in rows})


def test_one_currency_with_many_waiting_credits(spark):
    """A chain of claims in one hot currency: every settlement is wanted by some thirty credits."""
    rng = random.Random(12)
    rows = [(f"s{i:05d}", rng.randint(1, 4_000_000), DAY + datetime.timedelta(days=i % 700)) for i in range(3_000)]
    asked = []
    for i in range(20_000):
        k = rng.randrange(len(rows))
        exact = rng.random() < 0.1
        asked.append((f"c{i:05d}", rows[k][1] if exact else rng.randint(1, 900_000), rows[k][2] + datetime.timedelta(days=rng.randint(0, 20))))
    s = settled(spark, *[(i, a, "INR", d, "u" + i, None) for i, a, d in rows])
    c = credit(spark, *[(i, a, "INR", d, "") for i, a, d in asked])
    got = {r["credit_id"]: (r["resolution"], tuple(r["settlement_ids"])) for r in subset_sum.match_subsets(c, s, cardinality=2, keep=keep).collect()}
    assert got == quick_fold(asked, rows)


def quick_fold(asked, rows, tolerance=100):
    """:func:`fold` with the free settlements by day."""
    by_day = {}
    for s, a, d in rows:
        by_day.setdefault(d, {})[s] = a
    out = {}
    for cid, amount, day in sorted(asked, key=lambda c: (c[2], c[0])):
        near = sorted((abs(k), s, a, day - datetime.timedelta(days=k)) for k in range(-1, 31) for s, a in by_day.get(day - datetime.timedelta(days=k), {}).items() if a <= amount + tolerance)[:64]
        r = subset_sum.solve([s for _, s, _, _ in near], [a for _, _, a, _ in near], amount, False, tolerance=tolerance, cardinality=2)
        out[cid] = (r[0], tuple(r[1]))
        if r[0] == "MATCHED":
            for _, s, _, d in near:
                if s in r[1]:
                    del by_day[d][s]
    return out


def test_each_settlement_is_claimed_once(spark):
    rng = random.Random(3)
    rows = [(f"c{rng.randint(0, 30):02d}", f"s{rng.randint(0, 30):02d}", round(rng.random(), 2)) for _ in range(300)]
    rows = list({(a, b): (a, b, s) for a, b, s in rows}.values())
    got = sorted(map(tuple, claim.greedy_claim(spark.createDataFrame(rows, "credit_id string, settlement_id string, score double")).collect()))
    left, right, want = set(), set(), []
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.append((a, b, s))
    assert got == sorted(want)


def test_fill_untrained():
    got = dict((k, (m, u)) for k, m, u in linkage.fill_untrained({4: 0.8, 2: 0.2}, {3: 0.1, 2: 0.3, 1: 0.4}, 5))
    assert got[4] == (0.8, 0.8) and abs(got[3][0] - 0.4) < 1e-12 and got[1] == (0.4, 0.4) and got[0] == (1e-3, 1e-3)


def test_confidence_penalties(spark):
    f = lambda *a: float(spark.range(1).select(subset_sum.stage2_confidence(*map(F.lit, a)).alias("c")).first()["c"])
    assert [f(0, None, 1, False), f(5, None, 1, False), f(0, 0, 1, False), f(0, 100, 8, True)] == [0.90, 0.85, 0.65, 0.56]
