"""What goes wrong on larger tables only."""

import datetime
import random

from pyspark.sql import functions as F

from ledgerloom.operators import grading, ledger, linkage, pool, subset_sum
from ledgerloom.plans import catalog
from ledgerloom.plans.reconcile import keep, named_pairs, scored_pairs

from .test_matching import slow_search


def test_sequence_is_gapless_over_many_ranges(spark):
    """The ranges are cut from a sample and merged by size: once for the offsets, and not again for the rows."""
    n = 200_000
    rows = spark.range(0, n, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("transfer_id"), "id", *[F.sha2((F.col("id") + i).cast("string"), 256).alias(f"note{i}") for i in range(1, 6)]).checkpoint()
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = ledger.sequenced(rows.withColumn("note1", F.when(F.col("id") % 17 == 0, "9").otherwise(F.col("note1")))).checkpoint().agg(F.count("*"), F.count_distinct("sequence"), F.min("sequence"), F.max("sequence")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(found) == (n, n, 1, n)


def test_search_without_a_budget_visits_the_whole_tree_in_blocks(monkeypatch):
    rng = random.Random(9)
    for block in (1, 7, 300, 2_000_000):
        monkeypatch.setattr(subset_sum, "BLOCK", block)
        for _ in range(60):
            a = sorted((rng.randint(1, rng.choice([30, 400])) for _ in range(rng.randint(0, 14))), reverse=True)
            args = a, rng.randint(1, 900), rng.choice([0, 5, 100]), rng.randint(1, 8)
            assert subset_sum.search(*args, None) == slow_search(*args, 10**9)


def test_search_goes_beyond_the_default_budget():
    amounts = list(range(1300, 1255, -1))
    assert subset_sum.search(amounts, 6 * 1280, 0)[3:5] == (subset_sum.NODE_BUDGET + 1, True)
    _, kept, _, nodes, spent, _ = subset_sum.search(amounts, 6 * 1280, 0, budget=None)
    assert nodes > subset_sum.NODE_BUDGET and not spent and len(kept) == subset_sum.RIVALS


def _books(spark, n=60):
    rng, day = random.Random(2), datetime.date(2026, 8, 10)
    name = lambda: rng.choice([None, "", "ACME", "ACME LTD", "ACMEE", "ZEBRA"])
    some = lambda p, k: [(f"{p}{i:03d}", rng.choice([100, 101, 5000, 9000]), rng.choice(["INR", "USD"]), rng.choice([None, day + datetime.timedelta(days=rng.randint(0, 80))]) if i % 9 == 0 else day + datetime.timedelta(days=rng.randint(0, 80)), name()) for i in range(k)]
    c = spark.createDataFrame([(a, b, d, e, e, "x", f) for a, b, d, e, f in some("c", n)], "credit_id string, amount_minor long, currency string, value_date date, booking_date date, narration string, credit_name string")
    return c, spark.createDataFrame(some("s", n), "settlement_id string, amount_minor long, currency string, settled_at date, settlement_name string")


def test_totals_of_blocked_pairs_need_no_pairs(spark):
    c, s = _books(spark)
    want = pool.blocked_pairs(c, s).groupBy("credit_id").agg(F.count("*"), F.sum("days"), F.sum("amount_minor"))
    assert sorted(map(tuple, pool.blocked_totals(c, s).collect())) == sorted(map(tuple, want.collect())) != []


def test_totals_of_pools_need_no_pairs(spark, sf, monkeypatch):
    dated, settled = _books(spark)[0].where("value_date is not null"), _books(spark)[1].where("settled_at is not null and amount_minor <> 101")
    for size in (16_384, 3):
        monkeypatch.setattr(pool, "GROUP_CREDITS", size)
        for c, s in (_books(spark), (dated, settled)):
            for limit in (64, 3, 1):
                want = pool.candidate_pool(c, s, limit=limit).groupBy("credit_id").agg(F.count("*"), F.max("truncated"), F.sum("days"), F.sum("amount_minor"))
                assert sorted(map(tuple, pool.pool_totals(c, s, limit=limit).collect())) == sorted(map(tuple, want.collect())) != []
    monkeypatch.setattr(pool, "candidate_pairs", None)  # no pairs where all dates are known
    assert pool.pool_totals(dated, settled).count() and catalog.QUERIES["q06_candidate_pool"](spark, sf).count()


def test_pairs_are_not_shuffled_for_names(spark):
    plan = named_pairs(*_books(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_scored_pairs_equal_the_posterior_of_all(spark):
    c, s = _books(spark)
    loose = catalog.MODEL | {"amount": [(4, 0.9, 0.0001), (3, 0.5, 0.0001), (2, 0.5, 0.0001), (1, 0.02, 0.02), (0, 0.01, 0.9)]}
    for model in (catalog.MODEL, loose):
        want = {tuple(r) for r in linkage.posterior(keep(linkage.compare(named_pairs(c, s))), model).select("credit_id", "settlement_id", "weight", "score").collect()}
        for least in (None, 0.25, 0.01):
            found = [tuple(r) for r in scored_pairs(c, s, model, least).select("credit_id", "settlement_id", "weight", "score").collect()]
            assert len(found) == len(set(found)) and set(found) == {r for r in want if least is None or r[3] >= least} and found


def test_a_threshold_rests_on_the_counts_of_scores(spark):
    rows = spark.range(0, 3000).select((F.col("id") % 7 == 0).alias("positive"), (F.col("id") % 13 / 20 + F.when(F.col("id") % 7 == 0, 0.2).otherwise(0.0)).alias("score"))
    few = grading.counted(rows)
    assert few.count() < 30
    one, other = grading.derive_threshold(rows).first().asDict(), grading.derive_threshold(few, weight="n").first().asDict()
    assert one == other and one["positive_n"] + one["negative_n"] == 3000
