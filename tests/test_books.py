"""Generated books through the whole of the library: feeds to decisions, grades, ledger."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, explain, fx, grading, ledger, linkage, names, ranking, receivables
from ledgerloom.plans import catalog
from ledgerloom.plans.reconcile import deferred, derive_gates, in_input_order, keep, match_with_linkage, ranked_pairs, reconcile, tier1
from ledgerloom.sources import csv_feeds, generate


def inputs(made):
    """What the matcher wants, from a book."""
    settled = names.matcher_settlements(csv_feeds.settlements_of(made["settlement_rows"]), made["invoices"])
    return names.matcher_credits(made["credits"], F.col("position")), settled


@pytest.fixture(scope="module")
def main(spark):
    made = {k: keep(v) for k, v in generate.book(spark, 150, 7).items()}
    credit, settled = map(keep, inputs(made))
    return made, credit, settled, keep(tier1(credit, settled))


def test_a_book_is_the_same_at_every_run(spark):
    one, two = generate.book(spark, 60, 3), generate.book(spark, 60, 3)
    for k in one:
        assert sorted(map(str, one[k].collect())) == sorted(map(str, two[k].repartition(3).collect())), k
    other = generate.book(spark, 60, 4)
    assert sorted(map(str, one["credits"].collect())) != sorted(map(str, other["credits"].collect()))
    kinds = {r["defect_class"] for r in generate.book(spark, 400, 3)["truth"].collect()}
    assert kinds == set(generate.MAIN) - {"timing_pending"}


def test_main_book_has_no_false_match(main):
    made, _, _, decisions = main
    rows = {r["defect_class"]: r for r in evaluate.metrics(evaluate.classify(decisions, made["truth"])).collect()}
    assert rows["(all)"]["false_match"] == 0 and rows["(all)"]["match_rate"] > 0.9
    assert rows["clean_match"]["correct"] == rows["clean_match"]["total"] and rows["partial_payment"]["correct"] == rows["partial_payment"]["total"]


def test_strangers_are_rejected(spark, main):
    _, _, settled, _ = main
    odd = names.matcher_credits(generate.strangers(spark, 30, 5), F.col("position"))
    found = evaluate.no_match_control(tier1(odd, settled)).collect()
    assert sum(r["rejected"] for r in found) >= 28


def test_stress_book_is_told_by_names(spark):
    made = generate.book(spark, 60, 11, generate.STRESS)
    credit, settled = map(keep, inputs(made))
    first = keep(tier1(credit, settled))
    truth = keep(made["truth"])
    before = evaluate.metrics(evaluate.classify(first, truth)).where("defect_class = '(all)'").first()
    after = {r["defect_class"]: r for r in evaluate.metrics(evaluate.classify(match_with_linkage(credit, settled, model=catalog.MODEL), truth)).collect()}
    assert before["correct"] < 6 and after["(all)"]["correct"] > before["correct"] + 20
    assert after["legal_vs_trading"]["correct"] <= after["abbreviation"]["correct"]
    # ranks and gates, derived on the labelled pairs of this very book
    pairs = keep(ranked_pairs(keep(deferred(credit, first)), settled))
    labelled = pairs.join(truth.select(F.col("bank_txn_id").alias("credit_id"), F.element_at("true_ids", 1).alias("true_id")), "credit_id").withColumn("positive", F.col("settlement_id") == F.col("true_id"))
    gates = derive_gates(keep(labelled))
    above = labelled.where(~F.col("positive")).agg(F.max("rrf"), F.max("primary")).first()
    assert gates["rrf_gate"] >= float(above[0]) and gates["primary_gate"] >= float(above[1])
    strict = evaluate.metrics(evaluate.classify(reconcile(credit, settled, model=catalog.MODEL, gates=gates), truth)).where("defect_class = '(all)'").first()
    assert strict["correct"] >= after["(all)"]["correct"]


def test_stage4_against_brute_force(spark):
    """Both signals, ranks with ties by place, gates and claims, in plain Python (the dense one by a full SVD)."""
    import numpy as np

    made = generate.book(spark, 25, 21, generate.STRESS)
    credit, settled = map(keep, inputs(made))
    got = {(r["credit_id"], r["settlement_id"]): r for r in ranked_pairs(credit, settled).collect()}
    people, money = {r["credit_id"]: r for r in credit.collect()}, {r["settlement_id"]: r for r in settled.collect()}
    pairs = [(c, s) for c, p in people.items() for s, m in money.items() if p["currency"] == m["currency"] and abs((p["value_date"] - m["settled_at"]).days) <= 30]
    assert set(got) == set(pairs)
    used = sorted({s for _, s in pairs})
    docs = {("c", c): f"{p['credit_name']} {p['narration']}" for c, p in people.items()} | {("s", s): money[s]["settlement_text"] for s in used}
    chars = lambda t: [t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)]

    def words(t):
        w = [x for x in __import__("re").findall(r"\w+", t) if len(x) > 1]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    def matrix(grams):
        bags = {k: grams(" ".join(t.lower().split())) for k, t in docs.items()}
        terms = sorted({g for b in bags.values() for g in b})
        at = {g: i for i, g in enumerate(terms)}
        x = np.zeros((len(docs), len(terms)))
        for r, b in enumerate(bags.values()):
            for g in b:
                x[r, at[g]] += 1
        x *= np.log((1 + len(docs)) / (1 + (x > 0).sum(axis=0))) + 1
        return x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-300)

    row = {k: i for i, k in enumerate(docs)}
    lexical, semantic = matrix(chars), matrix(words)
    u, d, _ = np.linalg.svd(semantic, full_matrices=False)
    k = min(64, len(docs) - 1)  # as many directions as the operator keeps
    z = u[:, :k] * d[:k]
    for (c, s), r in got.items():
        a, b = row["c", c], row["s", s]
        assert abs(r["cosine"] - lexical[a] @ lexical[b]) < 1e-6
        norm = np.linalg.norm(z[a]) * np.linalg.norm(z[b])
        assert abs(r["dense"] - (z[a] @ z[b] / norm if norm else 0.0)) < 0.02
    for c in people:
        mine = [s for x, s in pairs if x == c]
        for rank, score in (("primary_rank", "primary"), ("dense_rank", "dense")):
            want = sorted(mine, key=lambda s: (-got[c, s][score], tuple(money[s]["position"]), s))
            assert [got[c, s][rank] for s in want] == list(range(1, len(mine) + 1))
    assert all(r["accepted"] == (r["rrf"] >= ranking.RRF_GATE and r["primary"] >= ranking.PRIMARY_GATE) for r in got.values())


def test_decisions_carry_evidence_and_order(main):
    _, credit, settled, decisions = main
    rows = in_input_order(decisions, credit).collect()
    assert [r["bank_txn_id"] for r in rows] == [r["credit_id"] for r in sorted(credit.collect(), key=lambda r: r["position"])]
    for r in rows:
        if r["stage"] == "deterministic":
            assert r["evidence"]["field"] in ("utr", "invoice_id")
        else:
            assert int(r["evidence"]["subsets_examined"]) >= 1 and r["evidence"]["truncated"] in ("true", "false")


def test_ledger_sees_edited_evidence(spark, main, tmp_path):
    decisions = main[3]
    posted = keep(ledger.postings(decisions))
    ledger.append(spark, str(tmp_path / "l"), posted)
    held = spark.read.parquet(str(tmp_path / "l"))
    assert ledger.verify_log(posted, held).count() == 0
    edited = ledger.postings(decisions.withColumn("evidence", F.map_concat("evidence", F.create_map(F.lit("zz"), F.lit("1")))))
    assert {r["error"] for r in ledger.verify_log(edited, held).collect()} == {"evidence_digest differs"}
    one = posted.first()["bank_txn_id"]
    assert [r["bank_txn_id"] for r in ledger.lookup(held, one).collect()] == [one] and ledger.lookup(held, "nobody").count() == 0
    bent = held.withColumn("credit_account", F.when(F.col("sequence") == 1, 9).otherwise(F.col("credit_account")))
    errors = [r["error"] for r in ledger.verify_log(posted, bent).collect()]
    assert len(errors) == 2 and any(e.startswith("out of balance") for e in errors)
    errors = [r["error"] for r in ledger.verify_log(posted, held.withColumn("sequence", F.greatest("sequence", F.lit(2)))).collect()]
    assert "sequence repeats" in errors


def test_bundles_with_decoys_become_false(main):
    made, _, _, decisions = main
    rows = evaluate.mutate_bundles(decisions, made["truth"], made["decoys"]).collect()
    assert rows and all((r["verdict_before"], r["verdict_after"]) == ("correct", "false_match") and r["wrong_ids"] != r["true_ids"] for r in rows)
    sweep = sorted(map(tuple, evaluate.mutation_sweep(decisions, made["truth"]).collect()))
    assert [r[1] for r in sweep] == [r[3] for r in sweep] and sweep[0][1] == 0 < sweep[1][1] < sweep[3][1]


def test_names_fall_back_to_the_order(spark):
    settled = spark.createDataFrame([("a", "I1", "O1"), ("b", "I9", "O2"), ("c", "I3", "O3"), ("d", None, None)], "record_id string, invoice_id string, order_id string")
    bills = spark.createDataFrame([("I1", "O7", "old", None, 1), ("I1", "O8", "Ann", "n", 2), ("I2", "O2", "Bob", None, 3), ("I3", "O3", "", None, 4), ("I4", "O3", "Cid", None, 5)], "invoice_id string, order_id string, customer_name string, notes string, position int")
    got = {r["record_id"]: r["settlement_name"] for r in names.name_settlements(settled, bills).collect()}
    assert got == {"a": "Ann", "b": "Bob", "c": None, "d": None}


def test_a_scorer_of_ones_own(spark):
    pairs = spark.createDataFrame([("c1", "s1", "acme ltd", "acme"), ("c1", "s2", "acme ltd", "bolt"), ("c2", "s1", "acme", "acme"), ("c3", "s2", "zz", "bolt")], "credit_id string, settlement_id string, credit_text string, settlement_text string")

    def share(a, b):
        return pd.Series([len(set(x) & set(y)) / len(set(x) | set(y)) for x, y in zip(a, b, strict=True)])

    scored = keep(grading.score_texts(pairs, share))
    got = {r["credit_id"]: r for r in grading.propose(scored, 0.3, keep).collect()}
    assert got["c2"]["accepted"] and got["c2"]["settlement_id"] == "s1" and not got["c1"]["accepted"] and got["c1"]["rank"] == 1 and got["c1"]["candidates"] == 2 and not got["c3"]["accepted"]
    truth = spark.createDataFrame([("c1", "x", "s1"), ("c2", "x", "s2")], "credit_id string, defect_class string, true_id string")
    assert sorted(map(tuple, grading.grade(grading.propose(scored, 0.3, keep), truth).collect())) == [("(all)", 3, 0, 1, 2), ("unknown", 1, 0, 0, 1), ("x", 2, 0, 1, 1)]
    assert sorted(map(tuple, grading.grade_ranking(scored, truth).collect())) == [("(all)", 3, 1, 2), ("unknown", 1, 0, 1), ("x", 2, 1, 1)]


def test_variance_and_receipts_of_a_book(main):
    made = main[0]
    sums = {r["settlement_id"]: r for r in fx.settlement_sums(made["settlement_rows"]).collect()}
    for r in made["settlement_rows"].where("type = 'refund'").collect():
        assert sums[r["settlement_id"]]["refund_minor"] == r["base_amount_minor"] and sums[r["settlement_id"]]["gross_minor"] != r["base_amount_minor"]
    aged = receivables.age_receipts(csv_feeds.export_receipts(made["invoices"]), F.lit(datetime.date(2026, 8, 31)))
    assert {r["status"] for r in aged.collect()} <= {"REALISED", "OPEN_EDPMS_LINKAGE", "AGING"}
    verdicts = explain.verdicts_of_matches(main[3].withColumn("seen", F.lit("correct")), "seen")
    prompt = explain.verdict_prompts(verdicts).first()
    assert "(correct)" in prompt["prompt"] and "\n" not in prompt["prompt"] and '"kind":"match"' in prompt["verdict_json"]


def test_throughput_rows(spark, main):
    _, credit, settled, _ = main
    rows = evaluate.throughput(lambda c, s: linkage.compare(catalog.named_pairs(c, s)), {"book": (credit, settled)})
    assert rows[0]["credits"] == credit.count() and rows[0]["credits_per_sec"] > 0
