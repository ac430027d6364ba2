"""Language identification and toxicity: held-out accuracy and edge cases."""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.llm import langid, queries, toxicity
from ledgerloom.llm.common import id_bucket

EDGES = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of " * 20_000), (5, "İstanbul Σίσυφος 中文 é"), (5, "İstanbul Σίσυφος 中文 é"), (None, "the and of the"), (7, "\x00 ퟿\n\t")]


def edges(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in EDGES], "doc_id long, text string, id string, score int")


def test_bucket_is_crc32_of_the_id(spark):
    got = spark.range(50).select("id", id_bucket(F.col("id"), 5).alias("b")).collect()
    assert all(r["b"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(got) > 100 and (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all() and got.rejected.mean() < 0.1


def test_kneser_ney_is_a_distribution():
    model = langid.fit({"a": ["abc abd abe bca", "bad cab"] * 3, "b": ["xyz yzx", "zzz xyx"] * 3})
    n = len(model.alphabet)
    for context in (0, 1, 2, 3):
        grams = np.array([(context << langid._BITS) | s for s in range(n + 2)], dtype=np.int64)
        total = np.exp(model.blocks[0]._look_up(grams, 2).astype(float)).sum(axis=0)
        assert np.allclose(total, 1, atol=1e-5)


def slow_kneser_ney(texts, alphabet, order):
    """The probability of a symbol after a context, from the formula and with dictionaries."""
    strings = []
    for text in texts:
        symbols, gap = [], True
        for c in text.lower():
            if c.isalpha():
                symbols.append(1 + alphabet.index(c) if c in alphabet else len(alphabet) + 1)
                gap = False
            elif not gap:
                symbols.append(0)
                gap = True
        strings.append([0] * (order - 1) + symbols + ([] if gap else [0]))
    counts = [Counter() for _ in range(order + 1)]
    for s in strings:
        counts[order].update(tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s)))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])

    def p(gram):
        if not gram:
            return 1 / (len(alphabet) + 2)
        seen = counts[len(gram)]
        ones, twos = sum(n == 1 for n in seen.values()), sum(n == 2 for n in seen.values())
        d = min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))
        after = [n for g, n in seen.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return max(seen[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * p(gram[1:])

    return p


def test_kneser_ney_against_the_formula():
    texts = {x: [f"{a}{b} {c}a" for a in "abx" for b in "cd" for c in part] for x, part in (("a", "abc"), ("b", "yz"), *((f"l{i}", "pq"[: 1 + i % 2]) for i in range(9)))}
    model = langid.fit(texts)
    assert len(model.blocks) == 2 and len(model.langs) == 11
    alphabet = [chr(c) for c in model.alphabet]
    for x in ("a", "b", "l4"):
        kept = [t for i, t in enumerate(texts[x]) if i % langid.CALIBRATION_SHARE != langid.CALIBRATION_SHARE - 1]
        p = slow_kneser_ney(kept, alphabet, langid.ORDER)
        for text in ("ac ba", "xyz", "q ca", "ü a"):
            codes = langid.encode([text], model.alphabet)[0].tolist()
            padded = [0] * (langid.ORDER - 1) + codes
            want = -sum(np.log(p(tuple(padded[i : i + langid.ORDER]))) for i in range(len(codes))) / len(codes)
            assert abs(model.cross_entropy([text])[0][0, model.langs.index(x)] - want) < 1e-4


def test_texts_do_not_change_each_other():
    model = langid.fit({"a": ["abc abd abe bca"] * 6, "b": ["xyz yzx xxy"] * 6})
    texts = ["abc", "xyz abc", None, "", "zzz", "ABC abd!"]
    together, _ = model.cross_entropy(texts)
    alone = np.concatenate([model.cross_entropy([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-9)


def test_language_edges(spark):
    model = langid.fit({"en": ["the and of with"] * 10, "fr": ["les une des pour"] * 10})
    got = langid.identify(edges(spark), model).collect()
    assert len(got) == len(EDGES)
    by = {r["doc_id"]: r for r in got}
    assert [(by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) for i in (1, 2, 3, 7)] == [("und", 0.0, True)] * 4
    assert by[5]["lang_pred"] in ("en", "fr")
    assert by[4]["lang_pred"] == "en" and by[None]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(edges(spark).limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edges(spark), langid.fit({})).collect()} == {"und"}
    assert langid.sample_texts(edges(spark).withColumn("lang", F.lit(None).cast("string")), F.lit(True)) == {}


def toy(n=400, seed=1):
    rng = np.random.default_rng(seed)
    clean = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(clean, rng.integers(5, 120)))
        if i % 6 == 0:
            words.insert(int(rng.integers(len(words))), ["scoundrel", "scoundrels", "villainous", "villain"][i % 4])
            words.insert(int(rng.integers(len(words))), ["villainy", "scoundrel", "villain", "scoundrel"][i % 4])
        texts.append(" ".join(words))
        labels.append(int(i % 6 == 0))
    return texts, labels


def test_toxicity_learns_and_takes_misspellings():
    model = toxicity.fit(*toy())
    texts, labels = toy(seed=2)
    found = model.score(texts) >= 0.3
    assert (found == np.array(labels, bool)).mean() > 0.98
    plain, bad, spelt = model.score(["abcde fghij aabbc ddeef"] * 1 + ["abcde scoundrel villain ddeef"] + ["abcde scoundrelx viillain ddeef"])
    assert plain < 0.3 <= bad and spelt > plain + 0.1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() / (got.toxic == 1).sum() > 0.85 and hit.sum() / (got.predicted == 1).sum() > 0.85


def test_toxicity_edges(spark):
    model = toxicity.fit(*toy())
    got = toxicity.score_documents(edges(spark), model)
    assert got.columns == ["doc_id", "score"] and got.count() == len(EDGES)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    kept = toxicity.drop_toxic(edges(spark).withColumn("toxicity_score", F.lit(9)), model, 1.1)
    assert kept.columns == ["doc_id", "text", "id", "score", "toxicity_score"] and kept.count() == len(EDGES)
    assert toxicity.score_documents(edges(spark).limit(0), model).count() == 0
    assert toxicity.fit([], []).score(["a", None])[0] < 0.3
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.sample_labelled(edges(spark), none, F.lit(True)) == ([], [], [])
    assert 0 <= toxicity.fit(["a b", "c d"], [0, 0]).score(["a"])[0] <= 1


def test_platt_keeps_order():
    x = np.array([-3.0, -2, -1, 1, 2, 3])
    a, b = toxicity.platt(x, np.array([0, 0, 0, 1, 1, 1.0]), np.ones(6))
    assert a > 0 and abs(b) < 1e-3
    assert pd.Series(x * a + b).is_monotonic_increasing


def test_toxicity_scores_against_the_definition():
    model = toxicity.fit(*toy())
    for text in (*toy(seed=3)[0][:20], "Scoundrel", "a b", "", None):
        words = sorted(set(re.findall(r"\w+", (text or "").lower())))
        scores = []
        for w in words:
            grams, _ = toxicity.subwords([w], toxicity.BUCKETS)
            vector = np.mean([model.embeddings[g] for g in grams], axis=0) if len(grams) else np.zeros(toxicity.DIM)
            scores.append(float(vector @ (model.softmax[:, 1] - model.softmax[:, 0])))
        top = max(scores, default=0.0)
        weights = [np.exp(toxicity.FOCUS * (s - top)) for s in scores]
        mean = sum(w * s for w, s in zip(weights, scores, strict=True)) / sum(weights) if scores else 0.0
        assert abs(model.raw([text])[0] - mean) < 1e-5
        assert abs(model.score([text])[0] - 1 / (1 + np.exp(-(model.scale * mean + model.shift)))) < 1e-4
