"""Scoring decisions against labelled truth."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSERTED = ("MATCHED", "PARTIAL")
REJECTED = ("UNMATCHED", "AMBIGUOUS", "TIE_AMBIGUOUS")


def classify(results: DataFrame, truth: DataFrame, on: tuple[str, ...] = ("bank_txn_id",), also: tuple[str, ...] = ()) -> DataFrame:
    """Truth cases with the verdict on them.

    ``truth``: bank_txn_id, defect_class, true_ids, true_resolution (null: no link).  A
    case without a result asserts nothing.  ``also``: further columns of the results.
    """
    r = results.select(*on, *also, F.col("resolution").alias("got"), F.col("settlement_ids").alias("got_ids"), "confidence")
    asserted = F.coalesce(F.col("got").isin(*ASSERTED), F.lit(False))
    linked = F.coalesce(F.col("true_resolution").isin(*ASSERTED), F.lit(False))
    right = (F.array_sort(F.array_distinct("got_ids")) == F.array_sort(F.array_distinct("true_ids"))) & (F.col("got") == F.col("true_resolution"))
    verdict = (
        F.when(~asserted & ~linked, "correct").when(~asserted & (F.col("got") == "TIE_AMBIGUOUS"), "tie_ambiguous").when(~asserted, "false_clear")
        .when(~linked, "false_match").when(F.coalesce(right, F.lit(False)), "correct").otherwise("false_match")
    )
    return truth.join(r, list(on), "left").withColumns({"asserted": asserted, "linked": linked, "verdict": verdict})


def _share(n: Column, of: Column, empty: float | None) -> Column:
    return F.when(of > 0, F.round(n / of, 6)).otherwise(F.lit(empty).cast("double"))


def metrics(classified: DataFrame) -> DataFrame:
    """Counts and rates by defect class and, under ``(all)``, over all.

    Precision and recall divide all correct cases, right abstentions included, as the
    match rate does; ``link_precision`` and ``link_recall`` divide right links only.
    """
    n = lambda v: F.count_if(F.col("verdict") == v)
    sets = classified.rollup("defect_class").agg(
        F.grouping("defect_class").alias("all"), F.count("*").alias("total"), F.count_if("linked").alias("true_link"), F.count_if("asserted").alias("asserted"),
        n("correct").alias("correct"), n("false_match").alias("false_match"), n("false_clear").alias("false_clear"), n("tie_ambiguous").alias("tie_ambiguous"),
        F.count_if((F.col("verdict") == "correct") & F.col("asserted")).alias("right_links"),
    )
    return sets.select(
        F.when(F.col("all") == 1, "(all)").otherwise(F.col("defect_class")).alias("defect_class"), "total", "true_link", "asserted", "correct", "false_match", "false_clear", "tie_ambiguous",
        _share(F.col("false_match"), F.col("total"), 0.0).alias("false_match_rate"), _share(F.col("false_clear"), F.col("true_link"), 0.0).alias("false_clear_rate"),
        _share(F.col("tie_ambiguous"), F.col("true_link"), 0.0).alias("tie_rate"), _share(F.col("correct"), F.col("total"), 0.0).alias("match_rate"),
        _share(F.col("correct"), F.col("asserted"), None).alias("precision"), _share(F.col("correct"), F.col("true_link"), None).alias("recall"),
        _share(F.col("right_links"), F.col("asserted"), None).alias("link_precision"), _share(F.col("right_links"), F.col("true_link"), None).alias("link_recall"),
    )


def threshold_sweep(results: DataFrame, truth: DataFrame, steps: int = 10) -> DataFrame:
    """(threshold, false_match, false_clear, correct): assertions below a threshold are withheld."""
    spark = results.sparkSession
    grid = spark.range(steps + 1).select((F.col("id") / steps).cast("decimal(4,2)").alias("threshold"))  # eleven rows
    base = classify(results, truth)
    withheld = base.crossJoin(F.broadcast(grid)).withColumn("kept", ~F.col("asserted") | (F.col("confidence") >= F.col("threshold")))
    verdict = F.when(F.col("kept"), F.col("verdict")).when(F.col("linked"), "false_clear").otherwise("correct")
    n = lambda v: F.count_if(F.col("v") == v)
    return withheld.withColumn("v", verdict).groupBy("threshold").agg(n("false_match").alias("false_match"), n("false_clear").alias("false_clear"), n("correct").alias("correct"))


def _chosen(percent: Column) -> Column:
    """Whether a credit is among about ``percent`` in a hundred, by a hash of its id."""
    return F.conv(F.substring(F.md5(F.col("bank_txn_id").cast("binary")), 1, 8), 16, 10).cast("long") % 100 < percent


def mutate(results: DataFrame, right: DataFrame, percent: Column) -> DataFrame:
    """``results`` in which about ``percent`` in a hundred of the ``right`` credits name as many wrong settlements, and ``mutated``.

    The same credits are chosen at every run, and those of a lower share at every higher one.
    """
    known = results.join(right.select("bank_txn_id", F.lit(True).alias("right")), "bank_txn_id", "left")
    hit = F.coalesce("right", F.lit(False)) & _chosen(percent)
    wrong = F.transform("settlement_ids", lambda x: F.concat(F.lit("not "), x))
    return known.withColumn("mutated", hit).withColumn("settlement_ids", F.when(hit, wrong).otherwise(F.col("settlement_ids"))).drop("right")


def mutation_sweep(results: DataFrame, truth: DataFrame, percents: tuple[int, ...] = (0, 5, 20, 50)) -> DataFrame:
    """(percent, mutated, total, false_match, false_match_rate): the metric must move with what was spoiled.

    Rightly asserted results are spoiled and all are classified again.
    """
    grid = results.sparkSession.createDataFrame([(p,) for p in percents], "percent int")  # four rows
    right = classify(results, truth).where("verdict = 'correct' and asserted")
    spoiled = mutate(results.crossJoin(F.broadcast(grid)), right, F.col("percent"))
    judged = classify(spoiled, truth.crossJoin(F.broadcast(grid)), ("bank_txn_id", "percent"), ("mutated",))
    out = judged.groupBy("percent").agg(F.count_if("mutated").alias("mutated"), F.count("*").alias("total"), F.count_if(F.col("verdict") == "false_match").alias("false_match"))
    return out.withColumn("false_match_rate", _share(F.col("false_match"), F.col("total"), 0.0))


def mutate_bundles(results: DataFrame, truth: DataFrame, decoys: DataFrame) -> DataFrame:
    """(bank_txn_id, true_ids, wrong_ids, verdict_before, verdict_after): bundles that were right, with their labelled decoys put in.

    ``decoys``: bank_txn_id, decoy_ids; decoys that are the bundle itself are left out.
    """
    before = classify(results, truth).where("verdict = 'correct' and asserted").join(decoys, "bank_txn_id")
    before = before.where(F.array_sort("decoy_ids") != F.array_sort("got_ids")).select("bank_txn_id", F.col("verdict").alias("verdict_before"), F.array_sort("decoy_ids").alias("wrong_ids"))
    spoiled = results.join(before, "bank_txn_id").withColumn("settlement_ids", F.col("wrong_ids"))
    after = classify(spoiled, truth.join(before.select("bank_txn_id"), "bank_txn_id", "left_semi")).select("bank_txn_id", "true_ids", F.col("verdict").alias("verdict_after"))
    return before.join(after, "bank_txn_id").select("bank_txn_id", F.array_sort("true_ids").alias("true_ids"), "wrong_ids", "verdict_before", "verdict_after")


def throughput(match: Callable[[DataFrame, DataFrame], DataFrame], scales: dict[str, tuple[DataFrame, DataFrame]]) -> list[dict]:
    """A row per named (credits, settlements): their numbers, the seconds that ``match`` takes on them, and credits a second."""
    rows = []
    for name, (credits, settlements) in scales.items():
        n, m = credits.count(), settlements.count()
        began = time.perf_counter()
        match(credits, settlements).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
        rows.append({"scale": name, "settlements": m, "credits": n, "seconds": round(took, 3), "credits_per_sec": round(n / took, 1)})
    return rows


def no_match_control(results: DataFrame) -> DataFrame:
    """(resolution, n, rejected) over credits that no settlement covers: abstaining is right."""
    return results.groupBy("resolution").agg(F.count("*").alias("n"), F.count_if(F.col("resolution").isin(*REJECTED)).alias("rejected"))


def tier_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of correct, false_match and false_clear by defect class between two metrics frames."""
    cols = ("correct", "false_match", "false_clear")
    a = before.select("defect_class", *[F.col(c).alias(f"{c}_before") for c in cols])
    b = after.select("defect_class", *[F.col(c).alias(f"{c}_after") for c in cols])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "defect_class", "full").select("defect_class", *[zero(f"{c}_before").alias(f"{c}_before") for c in cols], *[zero(f"{c}_after").alias(f"{c}_after") for c in cols], *[(zero(f"{c}_after") - zero(f"{c}_before")).alias(f"{c}_delta") for c in cols])


def overlay(earlier: DataFrame, later: DataFrame, key: str = "bank_txn_id") -> DataFrame:
    """A later stage's row where it matched, else the earlier one."""
    won = later.where("resolution = 'MATCHED'")
    return earlier.join(won, key, "left_anti").unionByName(won)


def largest_gap(scores: DataFrame, score: str = "score") -> DataFrame:
    """(low, high, gap): the widest gap between neighbouring distinct scores in [0, 1] of six decimals.

    Scores are sorted per bin of the range; a bin is bordered by the extremes of its neighbours.
    """
    binned = scores.select(F.round(score, 6).alias("s")).where("s is not null").distinct().withColumn("bin", F.floor(F.col("s") * 1000).cast("int"))
    edges = binned.groupBy("bin").agg(F.min("s").alias("least"))
    after = edges.withColumn("next", F.lead("least").over(Window.orderBy("bin"))).select("bin", "next")  # 1001 rows at most
    own = binned.withColumn("up", F.lead("s").over(Window.partitionBy("bin").orderBy("s"))).join(F.broadcast(after), "bin")
    gaps = own.select(F.col("s").alias("low"), F.coalesce("up", "next").alias("high")).where("high is not null")
    return gaps.withColumn("gap", F.round(F.col("high") - F.col("low"), 6)).orderBy(F.desc("gap"), "low").limit(1)


def midpoint(scored: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """(negative_max, positive_min, threshold): midway from the highest negative to the next positive above it."""
    top = scored.where(~F.col(positive)).agg(F.max(score).alias("negative_max"))
    above = scored.where(F.col(positive)).crossJoin(F.broadcast(top)).where(F.col(score) > F.col("negative_max"))  # one row
    return top.crossJoin(above.agg(F.min(score).alias("positive_min"))).withColumn("threshold", F.round((F.col("negative_max") + F.col("positive_min")) / 2, 6))
