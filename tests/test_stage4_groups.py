"""Stage 4 by groups against the ranks of all pairs."""

from ledgerloom.operators import ranking
from ledgerloom.plans import reconcile
from ledgerloom.plans.reconcile import accepted_pairs, keep, ranked_pairs
from ledgerloom.sources import generate

from .test_books import inputs


def test_accepted_pairs_equal_those_of_all_ranks(spark, monkeypatch):
    credit, settled = map(keep, inputs(generate.book(spark, 40, 21, generate.STRESS)))
    vectors = {}
    latent = reconcile.latent
    monkeypatch.setattr(reconcile, "latent", lambda corpus: vectors.setdefault("found", keep(latent(corpus))))
    every = keep(ranked_pairs(credit, settled)).collect()
    monkeypatch.setattr(ranking, "GROUP_CREDITS", 3)
    monkeypatch.setattr(ranking, "TOGETHER", 5)
    names = ["credit_id", "settlement_id", "credit_minor", "amount_minor", "primary_rank", "dense_rank", "rrf", "primary", "similarity", "dense", "credit_position", "settlement_position"]
    for gates in ((ranking.RRF_GATE, ranking.PRIMARY_GATE), (0.03, 0.2)):
        want = [r for r in every if r["rrf"] >= gates[0] and r["primary"] >= gates[1]]
        found = accepted_pairs(credit, settled, *gates).collect()
        assert sorted(tuple(r[c] for c in names) for r in found) == sorted(tuple(r[c] for c in names) for r in want) != []
        cosine = {(r["credit_id"], r["settlement_id"]): r["cosine"] for r in want}
        assert all(abs(r["cosine"] - cosine[r["credit_id"], r["settlement_id"]]) < 1e-9 for r in found)


def test_stage4_makes_no_row_for_each_pair(spark, monkeypatch):
    credit, settled = map(keep, inputs(generate.book(spark, 25, 21, generate.STRESS)))
    monkeypatch.setattr(reconcile, "ranked_pairs", None)
    monkeypatch.setattr(ranking, "sparse_cosine", None)
    none = spark.createDataFrame([], "bank_txn_id string, stage string, resolution string, settlement_ids array<string>, credit_minor long, net_minor long, residual_minor long, confidence decimal(4,2), reason string, evidence map<string,string>")
    first = none.unionByName(credit.selectExpr("credit_id as bank_txn_id", "'x' as stage", "'UNMATCHED' as resolution", "cast(array() as array<string>) as settlement_ids", "amount_minor as credit_minor", "0L as net_minor", "0L as residual_minor", "cast(0 as decimal(4,2)) as confidence", "'' as reason", "cast(map() as map<string,string>) as evidence"))
    assert reconcile.stage4(credit, settled, keep(first)).where("stage = 'fuzzy'").count() > 0
