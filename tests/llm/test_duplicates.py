"""Near duplicates, repeats, decontamination and vectors against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import components, decontaminate, embeddings, minhash, substrings

EXTRA = "doc_id long, text string, node string, kept int, chunk int, raw_text string, n_words int, matches int, id long, key int"


def with_extras(spark, rows):
    return spark.createDataFrame([(i, t, "n", 0, 1, "r", 2, 3, 4, 5) for i, t in rows], EXTRA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, key = [], 0
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((key, " ".join(copy)))
            key += 1
    return rows + [(key, ""), (key + 1, None), (key + 2, "same words again"), (key + 3, "same words  again"), (key + 4, "x " * 3000)]


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def classes(rows, threshold=0.8):
    bags = {k: bag(t) for k, t in rows}
    up = {k: k for k, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(bags)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= threshold - 1e-12:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: root(k) for k in keys}


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(0)
    miss = []
    for _ in range(200):
        a = rng.integers(0, 12, 60) * (rng.random(60) < 0.6)
        b = np.where(rng.random(60) < 0.7, a, rng.integers(0, 12, 60))
        h = rng.integers(1, 2**63, 60).astype(np.uint64)
        both = np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = minhash.signatures(*both, 2)
        miss.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(miss)) < 0.012 and np.std(miss) < 0.06


@pytest.mark.parametrize("paired", [minhash.PAIRED, 1])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, paired):
    monkeypatch.setattr(minhash, "PAIRED", paired)
    monkeypatch.setattr(minhash, "BLOCK_NODES", 512 if paired > 1 else 3)
    rows = corpus()
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.near_duplicates(with_extras(spark, rows)).collect()}
    want = classes(rows)
    assert {k: c for k, (c, _) in got.items()} == want
    assert {k for k, (_, kept) in got.items() if kept} == set(want.values())


def test_one_row_of_each_class_stays(spark):
    rows = [(2, "a b c d e f g"), (1, "A b c d e  f g"), (1, "A b c d e  f g"), (None, "a b c d e f g"), (3, None), (4, ""), (None, "quite another text than the first one")]
    got = minhash.drop_near_duplicates(with_extras(spark, rows))
    assert got.columns == [c.split()[0] for c in EXTRA.split(", ")]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == [("1", "A b c d e  f g"), ("3", ""), ("4", ""), ("None", "quite another text than the first one")]
    assert minhash.drop_near_duplicates(with_extras(spark, rows).limit(0)).count() == 0


def test_shared_overlaps():
    rows = [t for _, t in corpus(3, 30) if t]
    h, w, d = minhash.shingles([minhash.words_of(t.encode()) for t in rows])
    table = minhash.shared(h, w, d, len(rows))
    for i in range(0, len(rows), 5):
        for j in range(len(rows)):
            assert i == j or table[i, j] == sum((bag(rows[i]) & bag(rows[j])).values())


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {x: root(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        cover = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                cover[i : i + window] = [True] * window
        kept = " ".join(x for x, c in zip(w, cover, strict=True) if not c)
        out.append((key, len(w), sum(cover), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "chunk_bytes", "fan"), [(35, 8 << 20, 4096), (35, 2000, 4096), (7, 1500, 4096), (2, 3000, 4096), (35, 2000, 3), (2, 3000, 1)])
def test_repeats_equal_brute_force(spark, window, chunk_bytes, fan):
    rng = random.Random(window)
    passage = " ".join(rng.choice("pqrs") + str(i) for i in range(60))
    rows = [(i, " ".join(f"u{i}_{j}" for j in range(rng.randint(0, 90))) + (" " + passage if i % 3 == 0 else "") + f" t{i} x") for i in range(40)]
    rows += [(100, "z " * 80), (101, None), (102, ""), (103, rows[0][1]), (103, rows[0][1]), (None, "  \n\t\x0b "), (105, "long " + " ".join(map(str, range(30_000))))]
    found, names = substrings.find_repeats(with_extras(spark, rows), window, chunk_bytes=chunk_bytes, fan=fan)
    got = [(r["doc_id"], r[names[0]], r[names[1]], r[names[3]]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(repeats(rows, window), key=str)


def test_remove_repeats_keeps_columns(spark):
    rows = [(1, "a b c d e f"), (2, "x\na b c d y"), (3, "keeps   its\n blanks"), (4, None)]
    got = substrings.remove_repeats(with_extras(spark, rows), 4)
    assert got.columns == [c.split()[0] for c in EXTRA.split(", ")]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "e f", 2: "x y", 3: "keeps   its\n blanks", 4: None}
    assert substrings.remove_repeats(with_extras(spark, rows).limit(0)).count() == 0


def test_pack_numbers():
    x = np.sort(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    assert (substrings.unpack(substrings.pack(x)) == x).all() and len(substrings.unpack(b"")) == 0


def hits(text, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w, hit, found = pattern.findall((text or "").translate(fold)), set(), set()
    for name, item in items:
        x = pattern.findall((item or "").translate(fold))
        n = min(window, len(x))
        for i in range(len(x) - n + 1 if x else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[i : i + n]:
                    hit.update(range(p, p + n))
                    if name is not None:
                        found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 150])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(6)
    items = [(i, " ".join(f"{rng.choice('ABCdé')}{rng.randint(0, 9)}" for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "?!"), (None, "nameless item words here that are ten or more in count"), (3, items[3][1])]
    rows = []
    for i in range(60):
        name, text = rng.choice(items)
        parts = (text or "").split()
        cut = rng.randint(0, max(0, len(parts) - 1))
        rows.append((i, f"Pre{i}, " + " ".join(rng.choice([parts, parts[cut:], parts[: cut + 1]])).upper() + f". {rng.choice(['A1', 'post'])} {text if i % 7 == 0 else ''}"))
    rows += [(100, None), (101, ""), (102, "A1 " * 2000), (103, rows[0][1]), (103, rows[0][1]), (None, rows[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(with_extras(spark, rows), bench, block_bytes=block_bytes).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got), key=str) == sorted(((k, *hits(t, items)) for k, t in rows), key=str)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    left = decontaminate.remove_contaminated(with_extras(spark, rows), bench, block_bytes=block_bytes)
    assert left.columns == [c.split()[0] for c in EXTRA.split(", ")]
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(str(k) for k, t in rows if hits(t, items)[1] == 0)
    assert decontaminate.contamination(with_extras(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(with_extras(spark, rows).limit(0), bench).count() == 0


def test_longest_match_and_place(spark):
    item = " ".join(f"b{i}" for i in range(30))
    docs = with_extras(spark, [(1, "x y " + " ".join(f"b{i}" for i in range(5, 22)) + " z")])
    found, (_, spans, matches) = decontaminate.annotate(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    row = found.first()
    assert [tuple(s) for s in row[spans]] == [(2, 19)] and [tuple(m) for m in row[matches]] == [("9", 5, 2, 17)]


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(20):
        s = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 60))])
        order = decontaminate.suffix_array(s, len(s)).tolist()
        assert order == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(40):
        base = rng.normal(size=16)
        rows += [base + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.3]) for _ in range(int(rng.integers(1, 9)))]
    out = [(i, r.astype(np.float32).tolist()) for i, r in enumerate(rows)]
    n = len(out)
    return out + [(n, out[0][1]), (n + 1, [2 * x for x in out[0][1]]), (n + 2, None), (n + 3, [0.0] * 16), (n + 4, [float("nan")] * 16), (n + 5, [1.0, None]), (n + 6, []), (n + 7, [float("inf")] * 16), (n + 8, [1.0, 2.0]), (n + 8, [1.0, 2.0])]


@pytest.mark.parametrize("block", [256, 3])
def test_vectors_against_brute_force(spark, block):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("id", F.lit(2))
    got = embeddings.near_duplicates(frame, block=block).collect()
    scaled = embeddings.units(pa.array([v for _, v in rows], pa.list_(pa.float64())))
    units = [(k, None if u is None else np.frombuffer(u)) for (k, _), u in zip(rows, scaled, strict=True)]
    link = lambda a, b: a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.95
    want = sorted((k, sum(link(u, x) for j, (_, x) in enumerate(units) if j != i)) for i, (k, u) in enumerate(units))
    found, true = sum(r["n_links"] for r in got), sum(n for _, n in want)
    assert found <= true and found >= 0.99 * true
    assert sorted((r["vec_id"], r["n_links"]) for r in got)[-10:] == want[-10:]
    up = {k: k for k, _ in rows}
    for _ in rows:
        for i, (a, x) in enumerate(units):
            for b, y in units[:i]:
                if link(x, y):
                    up[a] = up[b] = min(up[a], up[b])
    assert {r["vec_id"]: r["component_id"] for r in got} == up and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_found(spark):
    """With the recall as shipped: 500 pairs whose cosine is 0.9505."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(500):
        a, b = rng.normal(size=64), rng.normal(size=64)
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.9505 * a + np.sqrt(1 - 0.9505**2) * b / np.linalg.norm(b)).tolist())]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] >= 2 * 0.99 * 500
