"""The whole reconciliation: four stages, each on what the ones before it left open."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, jaro_winkler, word_ngrams
from ..operators import comparison, linkage, ranking
from ..operators.evaluate import ASSERTED
from ..operators.grading import counted, derive_threshold
from ..operators.pool import WINDOW_DAYS, blocked_pairs, blocked_totals, credit_date
from ..operators.reference_match import match_by_reference
from ..operators.subset_sum import match_subsets, stage2_confidence

DECISION = ("bank_txn_id", "stage", "resolution", "settlement_ids", "credit_minor", "net_minor", "residual_minor", "confidence", "reason", "evidence")


def evidence(**values: Column) -> Column:
    """What a decision rests on, as a map of names to text."""
    return F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value.cast("string"))])


def _shared_folder(frame: DataFrame) -> str:
    """The shared checkpoint folder; on a single machine without one, a temporary folder."""
    context = frame.sparkSession.sparkContext
    if not (frame.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        import tempfile

        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return context.getCheckpointDir() or frame.sparkSession.conf.get("spark.checkpoint.dir")


def keep(frame: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    _shared_folder(frame)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame) -> DataFrame:
    """As :func:`keep`, in compressed columns: for frames as long as the input."""
    path = f"{_shared_folder(frame)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def open_settlements(settlements: DataFrame, decisions: DataFrame) -> DataFrame:
    used = decisions.where(F.col("resolution").isin(*ASSERTED)).select(F.explode("settlement_ids").alias("settlement_id"))
    return settlements.join(used, "settlement_id", "left_anti")


def tier1(credits: DataFrame, settlements: DataFrame, **limits) -> DataFrame:
    """Stages 1 and 2 for every credit (columns ``DECISION``)."""
    found = match_by_reference(credits, settlements, keep=keep).withColumn("stage", F.lit("deterministic"))
    first = keep(found.withColumn("evidence", evidence(field=F.col("field"), rivals=F.when(F.col("resolution") == "AMBIGUOUS", F.array_join("settlement_ids", ",")))).select(*DECISION))
    waiting = credits.join(first.select(F.col("bank_txn_id").alias("credit_id")), "credit_id", "left_anti")
    found = match_subsets(waiting, keep(open_settlements(settlements, first)), keep=keep, **limits)
    trust = F.when(F.col("resolution") == "MATCHED", stage2_confidence(F.col("residual_minor"), F.col("margin_minor"), F.size("settlement_ids"), F.col("truncated"))).when(F.col("resolution") == "TIE_AMBIGUOUS", F.lit("0.20").cast("decimal(4,2)")).otherwise(F.lit("0.00").cast("decimal(4,2)"))
    reason = F.when(F.col("resolution") == "MATCHED", "one subset comes closest").when(F.col("resolution") == "TIE_AMBIGUOUS", "several subsets come as close").otherwise("no subset comes close")
    second = found.select(
        F.col("credit_id").alias("bank_txn_id"), F.lit("subset_sum").alias("stage"), "resolution", "settlement_ids", (F.col("net_minor") - F.col("residual_minor")).alias("credit_minor"),
        "net_minor", "residual_minor", trust.alias("confidence"), reason.alias("reason"),
        evidence(
            pool_size=F.col("pool_size"), subsets_examined=F.col("subsets_examined"), truncated=F.col("truncated"), margin_minor=F.col("margin_minor"), runner_up=F.array_join("runner_up", ","),
            rivals=F.nullif(F.array_join(F.transform("rivals", lambda r: F.array_join(r, ",")), ";"), F.lit("")),
        ).alias("evidence"),
    )
    return keep(first.unionByName(second))


def _later(won: DataFrame, stage: str, score: str, reason: str, why: Column) -> DataFrame:
    return won.select(
        F.col("credit_id").alias("bank_txn_id"), F.lit(stage).alias("stage"), F.lit("MATCHED").alias("resolution"), F.array("settlement_id").alias("settlement_ids"), "credit_minor", F.col("amount_minor").alias("net_minor"),
        (F.col("amount_minor") - F.col("credit_minor")).alias("residual_minor"), F.col(score).cast("decimal(4,2)").alias("confidence"), F.lit(reason).alias("reason"), why.alias("evidence"),
    )


def _overlay(decisions: DataFrame, later: DataFrame) -> DataFrame:
    return keep(decisions.join(later.select("bank_txn_id"), "bank_txn_id", "left_anti").unionByName(later))


def deferred(credits: DataFrame, decisions: DataFrame) -> DataFrame:
    left = decisions.where(~F.col("resolution").isin(*ASSERTED)).select(F.col("bank_txn_id").alias("credit_id"))
    return credits.join(left, "credit_id", "left_semi")


#: Places in the input, which settle ties where both sides have them.
PLACES = ("credit_position", "settlement_position")


def named_pairs(credits: DataFrame, settlements: DataFrame, on: tuple[str, ...] = ("currency",)) -> DataFrame:
    """Blocked pairs with names, narration and, where both sides have a ``position``, those; and the credits' ``true_id``, if they have one."""
    placed = "position" in credits.columns and "position" in settlements.columns
    place = lambda n: [F.col("position").alias(PLACES[n])] if placed else []
    extra = lambda frame: [F.col(c) for c in on if c != "currency"]
    return blocked_pairs(credits, settlements, on=on, left_also=(F.col("credit_name"), F.col("narration"), *place(0), *([F.col("true_id")] if "true_id" in credits.columns else []), *extra(credits)), right_also=(F.col("settlement_name"), *place(1), *extra(settlements)))


def _named(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _equal_names(credits: DataFrame, settlements: DataFrame) -> DataFrame:
    """Blocked pairs of equal names, compared."""
    key = lambda frame, c: frame.withColumn("name_key", F.when(_named(c), F.col(c)))
    return linkage.compare(named_pairs(key(credits, "credit_name"), key(settlements, "settlement_name"), ("currency", "name_key")).drop("name_key"))


def _all_pairs(credits: DataFrame, settlements: DataFrame) -> DataFrame:
    return blocked_totals(credits, settlements).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("name_all"))


def equal_scores(credits: DataFrame, settlements: DataFrame, model: dict) -> DataFrame:
    """The rows of :func:`scored_pairs` whose names are equal."""
    return linkage.posterior_of_equal(written(_equal_names(credits, settlements)), keep(_all_pairs(credits, settlements)), model)


def every_score(credits: DataFrame, settlements: DataFrame, model: dict) -> DataFrame:
    """(credit_id, settlement_id, weight, score) of all blocked pairs: those of :func:`scored_pairs`, made and compared by groups."""
    columns = ["credit_id", "settlement_id", "weight", "score"]
    other = comparison.unlike_scores(credits, settlements, comparison.score_table(credits.sparkSession, model), written)
    return equal_scores(credits, settlements, model).select(*columns).unionByName(other)


def best_scores(credits: DataFrame, settlements: DataFrame, model: dict) -> DataFrame:
    """Rows (credit_id, settlement_id, score) of :func:`every_score` among which each credit has its best pair, of the smaller id where scores are equal; few of the others."""
    other = comparison.unlike_best(credits, settlements, comparison.score_table(credits.sparkSession, model), written)
    return equal_scores(credits, settlements, model).select("credit_id", "settlement_id", "score").unionByName(other)


def score_counts(credits: DataFrame, settlements: DataFrame, model: dict) -> DataFrame:
    """(positive, score, n): how many pairs of labelled ``credits``, whose ``true_id`` is the pair's settlement or not, have each score.

    Unlike names are counted by their levels, all and the positive ones, and the others are
    the rest; rareness is among the pairs of all credits.
    """
    labelled = written(credits.where("true_id is not null"))
    table = comparison.score_table(credits.sparkSession, model)
    every = comparison.unlike_codes(labelled, settlements, written)
    own = named_pairs(labelled.withColumn("link", F.col("true_id")), settlements.withColumn("link", F.col("settlement_id")), ("currency", "link"))
    own = linkage.compare(own).where("name_level < 4")
    own = own.groupBy(comparison.code_of(own).alias("code")).agg(F.count("*").alias("own"))
    both = keep(every.join(own, "code", "left").withColumn("own", F.coalesce("own", F.lit(0))))  # a row a code
    scores = F.broadcast(credits.sparkSession.createDataFrame([(i, s) for i, (_, s) in enumerate(table)], "code int, score double"))
    sides = [both.select("code", F.lit(flag).alias("positive"), n.alias("n")) for flag, n in ((True, F.col("own")), (False, F.col("n") - F.col("own")))]
    other = sides[0].unionByName(sides[1]).where("n > 0").join(scores, "code")
    equal = equal_scores(credits, settlements, model).where("true_id is not null").withColumn("positive", F.col("settlement_id") == F.col("true_id"))
    parts = counted(equal).unionByName(other.select("positive", "score", "n"))
    return parts.groupBy("positive", "score").agg(F.sum("n").alias("n"))


def scored_pairs(credits: DataFrame, settlements: DataFrame, model: dict, least: float | None = None) -> DataFrame:
    """Blocked pairs with the posterior of stage 3: all of them or, with ``least``, exactly those of that score or more.

    Pairs of equal names come from a join on the name.  How rare a name is, and how many
    pairs there are, is counted without making the others; these are made once and are not
    shuffled.  With ``least``, of the others only those are made whose amounts leave the
    score within reach: by a join on the amount if it must be equal.
    """
    named = _named
    equal, total = keep(_equal_names(credits, settlements)), _all_pairs(credits, settlements)
    both = named("credit_name") & named("settlement_name")
    unlike = F.coalesce(F.col("credit_name") != F.col("settlement_name"), F.lit(True)) | ~both
    if least is None:
        return linkage.posterior_of_parts(equal, linkage.compare(named_pairs(credits, settlements).where(unlike)), keep(total), model)
    levels = {flag: linkage.reachable(model, least, flag) for flag in (True, False)}
    level = linkage.amount_level(F.col("credit_minor"), F.col("amount_minor"))
    if levels[True] | levels[False] <= {4}:
        exact = lambda frame: frame.withColumn("same_minor", F.col("amount_minor"))
        # credits and settlements without a name, or all, as far as an equal amount can do
        parts = [named_pairs(exact(credits), exact(settlements), ("currency", "same_minor")).drop("same_minor").where(unlike)] if levels[True] | levels[False] else [named_pairs(credits, settlements).where("false")]
    else:
        parts = [named_pairs(credits, settlements).where(unlike)]
    within = F.when(both, level.isin(*levels[False]) if levels[False] else F.lit(False)).otherwise(level.isin(*levels[True]) if levels[True] else F.lit(False))
    return linkage.posterior_of_parts(equal, linkage.compare(parts[0].where(within)), keep(total), model).where(F.col("score") >= least)


def _ties(pairs: DataFrame) -> tuple[str, ...]:
    return PLACES if PLACES[0] in pairs.columns else ()


def latent(corpus: DataFrame) -> DataFrame:
    """The second signal of stage 4: latent vectors of words and word pairs, apart from the character n-grams of the first."""
    return ranking.latent_vectors(keep(ranking.tfidf(corpus, word_ngrams(F.col("text")))), docs=corpus, keep=keep)


def train(credits: DataFrame, settlements: DataFrame, decisions: DataFrame) -> dict:
    """The model of stage 3: m from what stage 1 matched, u from all blocked pairs."""
    sure = decisions.where("stage = 'deterministic' and resolution = 'MATCHED' and size(settlement_ids) = 1").select(F.col("bank_txn_id").alias("credit_id"), F.element_at("settlement_ids", 1).alias("settlement_id"))
    told = credits.join(sure.withColumnRenamed("settlement_id", "sure_id"), "credit_id")
    positives = linkage.compare(named_pairs(told, settlements.withColumn("sure_id", F.col("settlement_id")), ("currency", "sure_id")))
    return linkage.train(linkage.level_shares(positives), linkage.shares(comparison.level_counts(credits, settlements, written)))


def stage3(credits: DataFrame, settlements: DataFrame, decisions: DataFrame, model: dict) -> DataFrame:
    """``decisions`` with what linkage matches among the credits and settlements they leave open."""
    waiting = keep(deferred(credits, decisions))
    scored = scored_pairs(waiting, keep(open_settlements(settlements, decisions)), model, linkage.THRESHOLD)
    why = evidence(**{c: F.col(c) for c in ("bf_amount", "bf_date", "bf_name", "tf_adjustment", "weight")})
    return _overlay(decisions, _later(linkage.link(scored, keep=keep, tie=_ties(scored)), "probabilistic", "score", "linkage score above the threshold", why))


def _texts(credits: DataFrame, met: DataFrame) -> DataFrame:
    """The corpus of stage 4: credits, and the settlements that any of them meets."""
    said = "settlement_text" if "settlement_text" in met.columns else "settlement_name"
    text = credits.select(F.concat(F.lit("c"), "credit_id").alias("doc_id"), F.concat_ws(" ", "credit_name", "narration").alias("text"))
    return text.unionByName(met.select(F.concat(F.lit("s"), "settlement_id").alias("doc_id"), F.coalesce(said, F.lit("")).alias("text")))


def ranked_pairs(credits: DataFrame, settlements: DataFrame, rrf_gate: float = ranking.RRF_GATE, primary_gate: float = ranking.PRIMARY_GATE) -> DataFrame:
    """Blocked pairs with both signals of stage 4, their ranks and whether they pass the gates."""
    pairs = keep(named_pairs(credits, settlements))
    met = settlements.join(pairs.select("settlement_id").distinct(), "settlement_id", "left_semi")
    corpus = _texts(credits, met)
    weights = keep(ranking.tfidf(corpus, char_ngrams(F.col("text"))))
    left, right = (weights.where(F.col("doc_id").startswith(p)).withColumn("doc_id", F.substring("doc_id", 2, 1000)) for p in "cs")
    lexical = ranking.sparse_cosine(pairs, left, right, "credit_id", "settlement_id")
    vectors = keep(latent(corpus))
    v = lambda p, i, n: vectors.where(F.col("doc_id").startswith(p)).select(F.substring("doc_id", 2, 1000).alias(i), F.col("vector").alias(n))
    scored = lexical.join(v("c", "credit_id", "va"), "credit_id", "left").join(v("s", "settlement_id", "vb"), "settlement_id", "left")
    scored = scored.withColumn("dense", F.round(F.coalesce(ranking.cosine(F.col("va"), F.col("vb")), F.lit(0.0)), 6)).drop("va", "vb")
    scored = scored.withColumn("similarity", jaro_winkler(F.coalesce("credit_name", F.lit("")), F.coalesce("settlement_name", F.lit(""))))
    scored = scored.withColumn("primary", ranking.primary_score(F.col("cosine"), F.col("similarity")))
    return ranking.fuse(scored, "credit_id", "settlement_id", tie=_ties(scored)[1:], rrf_gate=rrf_gate, primary_gate=primary_gate)


def accepted_pairs(credits: DataFrame, settlements: DataFrame, rrf_gate: float = ranking.RRF_GATE, primary_gate: float = ranking.PRIMARY_GATE) -> DataFrame:
    """The accepted rows of :func:`ranked_pairs`, without a row for each pair or for each term of it.

    Texts and vectors travel with the credits and settlements, which meet by currency and
    bucket of days; a bucket of very many credits is dealt over several groups.
    """
    placed = "position" in credits.columns and "position" in settlements.columns
    place = (F.col("position") if placed else F.lit(0)).alias("place")
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    width = 2 * WINDOW_DAYS + 1
    bucket = lambda d: F.floor(d / width).cast("int")
    dates = credits.select("currency", credit_date().alias("settled_at"), "amount_minor")
    reached = blocked_totals(settlements.select(F.col("settlement_id").alias("credit_id"), "currency", F.col("settled_at").alias("value_date"), F.col("settled_at").alias("booking_date")), dates)
    met = keep(settlements.join(reached.select(F.col("credit_id").alias("settlement_id")), "settlement_id", "left_semi"))
    corpus = keep(_texts(credits, met))
    weights = ranking.tfidf(corpus, char_ngrams(F.col("text"))).groupBy("doc_id").agg(F.collect_list(F.struct("term", "weight")).alias("pairs"))
    vectors = latent(corpus)
    docs = keep(vectors.join(weights, "doc_id", "left").select("doc_id", "vector", F.coalesce(F.col("pairs.term"), F.expr("cast(array() as array<string>)")).alias("terms"), F.coalesce(F.col("pairs.weight"), F.expr("cast(array() as array<double>)")).alias("weights")))

    def side(rows: DataFrame, p: str, id_: str, date: Column, name: str) -> DataFrame:
        own = rows.select(F.concat(F.lit(p), id_).alias("doc_id"), F.col(id_).alias("id"), "currency", number(date).alias("day"), F.col("amount_minor").alias("minor"), F.col(name).alias("name"), place)
        return own.where("day is not null and currency is not null").join(docs.select(*[F.col(c).alias(c) for c in docs.columns]), "doc_id").drop("doc_id")  # names of its own on each side

    left = side(credits, "c", "credit_id", credit_date(), "credit_name").withColumn("bucket", bucket(F.col("day")))
    right = side(met, "s", "settlement_id", F.col("settled_at"), "settlement_name").withColumn("bucket", F.explode(F.sequence(bucket(F.col("day") - WINDOW_DAYS), bucket(F.col("day") + WINDOW_DAYS))))
    large = credits.select("currency", bucket(number(credit_date())).alias("bucket")).groupBy("currency", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > ranking.GROUP_CREDITS)
    large = F.broadcast(keep(large.select("currency", "bucket", F.ceil(F.col("n") / ranking.GROUP_CREDITS).cast("int").alias("parts"))))  # at most one for so many credits
    parts = F.coalesce("parts", F.lit(1))
    key = ["currency", "bucket", "part"]
    left = left.join(large, ["currency", "bucket"], "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    right = right.join(large, ["currency", "bucket"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).drop("parts")

    def run(key, some, reach):
        return ranking.accepted_of(some, reach, WINDOW_DAYS, rrf_gate, primary_gate)

    found = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, ranking.accepted_form(*(f.schema["place"].dataType for f in (left, right))))
    return found if placed else found.drop(*PLACES)


def stage4(credits: DataFrame, settlements: DataFrame, decisions: DataFrame, **gates) -> DataFrame:
    """``decisions`` with what fused ranks match among the credits and settlements they leave open."""
    fused = keep(accepted_pairs(keep(deferred(credits, decisions)), keep(open_settlements(settlements, decisions)), **gates))
    why = evidence(**{c: F.col(c) for c in ("cosine", "similarity", "dense", "primary_rank", "dense_rank", "rrf")})
    return _overlay(decisions, _later(linkage.greedy_claim(fused, score="rrf", keep=keep, tie=_ties(fused)), "fuzzy", "primary", "first by text and by meaning", why))


def derive_gates(ranked: DataFrame, positive: str = "positive") -> dict[str, float]:
    """Both gates of stage 4 from labelled pairs: midway above the highest negative of each score."""
    out = {}
    for gate, score in (("rrf_gate", "rrf"), ("primary_gate", "primary")):
        out[gate] = float(derive_threshold(ranked, score, positive).first()["threshold"])
    return out


def match_with_linkage(credits: DataFrame, settlements: DataFrame, model: dict | None = None, **limits) -> DataFrame:
    """Stages 1 to 3: (``DECISION``) for every credit."""
    decisions = tier1(credits, settlements, **limits)
    return stage3(credits, settlements, decisions, train(credits, settlements, decisions) if model is None else model)


def reconcile(credits: DataFrame, settlements: DataFrame, model: dict | None = None, gates: dict[str, float] | None = None, **limits) -> DataFrame:
    """All four stages: (``DECISION``) for every credit.

    ``credits`` need credit_name, ``settlements`` settlement_name and may have a
    settlement_text for the texts of stage 4.  Without a ``model`` the third stage is
    trained on what the first matched; ``gates`` as :func:`derive_gates` gives them.  Ties
    of later stages go by ``position`` where both have it, else by id.
    """
    return stage4(credits, settlements, match_with_linkage(credits, settlements, model, **limits), **(gates or {}))


def in_input_order(decisions: DataFrame, credits: DataFrame) -> DataFrame:
    """The decisions in the order in which their credits came (``position``)."""
    place = credits.select(F.col("credit_id").alias("bank_txn_id"), "position")
    return decisions.join(place, "bank_txn_id").orderBy("position", "bank_txn_id")
