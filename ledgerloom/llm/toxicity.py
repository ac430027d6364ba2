"""Toxicity from averaged subword bags under a linear softmax.

A word is the bag of its character n-grams, its edges marked, hashed into buckets.  A
document's vector is the average of the subword embeddings over all of its distinct words,
and a linear softmax scores it.  Embeddings and softmax are trained jointly in numpy.  A
misspelling shares most n-grams, and so most of its vector, with words seen in training.

An insult is one of hundreds of words, and an even average drowns it.  So the average is a
weighted one: a word weighs ``exp(focus * s)``, with ``s`` its own score under the same
softmax, so the weights need no parameters of their own.  ``focus`` grows from 0, the even
average, to ``FOCUS`` while training.  Platt scaling on scores of rows that were kept from
the fit, in ``FOLDS`` turns, makes the score a probability at the base rate of the labels.

The model is a classifier fitted on a bounded sample of labelled rows (``MAX_ROWS`` a
class, the smallest hashes first, ``MAX_CHARS`` in all).  Scoring covers whole texts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fresh, slices, worker_cache

MAX_ROWS = (1800, 1200)  # of label 0 and of label 1
MAX_CHARS = 8_000_000
BUCKETS = 1 << 18
DIM = 12
GRAMS = (3, 4)  # longer ones break with any misspelling
FOCUS = 16.0
EPOCHS, RISE = 90, 36  # the focus is whole from epoch RISE on
STEP, DECAY = 20.0, 3e-3
FOLDS = 3
CACHE_LIMIT = 400_000
_WORD = re.compile(r"\w+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all subwords, and for each the index of its word."""
    marked = "".join([f"<{w}>" for w in words])
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # symbols from here to the word's end
    found, of = [], []
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, GRAMS[-1] + 1):
        h = h * _MULTIPLY
        h[: max(0, len(points) - n + 1)] += points[n - 1 :] + np.uint64(1)
        if n >= GRAMS[0]:
            ok = left >= n
            found.append(h[ok] + np.uint64(n))
            of.append(owner[ok])
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    h = (h ^ (h >> np.uint64(31))) * _MULTIPLY
    return (h >> np.uint64(64 - int(np.log2(buckets)))).astype(np.int64), np.concatenate(of) if of else np.zeros(0, np.int64)


def _averages(scores: np.ndarray, sizes: np.ndarray, focus: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean score of each run of ``scores``, 0 for an empty run, and the weight of each member."""
    mean, weight = np.zeros(len(sizes)), np.zeros(len(scores))
    full = np.flatnonzero(sizes)
    if len(full):
        many = sizes[full]
        start = np.cumsum(many) - many
        weight = np.exp(focus * (scores - np.repeat(np.maximum.reduceat(scores, start), many)))
        weight /= np.repeat(np.add.reduceat(weight, start), many)
        mean[full] = np.add.reduceat(weight * scores, start)
    return mean, weight


@dataclass
class Model:
    embeddings: np.ndarray
    softmax: np.ndarray  # a column per class
    scale: float  # Platt scaling of the logit
    shift: float

    def __post_init__(self):
        self.name = uuid.uuid4().hex
        self.weight = self.embeddings @ (self.softmax[:, 1] - self.softmax[:, 0])

    def word_scores(self, words: list[str]) -> np.ndarray:
        grams, of = subwords(words, len(self.weight))
        return np.bincount(of, self.weight[grams], len(words)) / np.maximum(np.bincount(of, minlength=len(words)), 1)

    def raw(self, texts: list[str | None], known: dict[str, float] | None = None) -> np.ndarray:
        """The weighted mean of the word scores of each text; 0 without words.  ``known``: scores of words so far."""
        known = {} if known is None else known
        bags = [words_of(t) for t in texts]
        missing = list(set().union(*bags).difference(known)) if bags else []
        if len(known) + len(missing) > CACHE_LIMIT:
            known.clear()
            missing = list(set().union(*bags))
        for i in range(0, len(missing), 50_000):
            part = missing[i : i + 50_000]
            known.update(zip(part, self.word_scores(part).tolist(), strict=True))
        sizes = np.array([len(b) for b in bags], dtype=np.int64)
        flat = np.fromiter((known[w] for bag in bags for w in bag), dtype=float, count=int(sizes.sum()))
        return _averages(flat, sizes, FOCUS)[0]

    def score(self, texts: list[str | None], known: dict[str, float] | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(texts, known) + self.shift, -40, 40)))


@dataclass
class _Words:
    """The distinct words of a sample: which of them each text has, and their subwords."""

    flat: np.ndarray
    sizes: np.ndarray
    grams: np.ndarray
    many: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> _Words:
        vocabulary: dict[str, int] = {}
        bags = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in sorted(words_of(t))], dtype=np.int32) for t in texts]
        known, grams, many = list(vocabulary), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(known), 20_000):
            part = known[i : i + 20_000]
            found, of = subwords(part, BUCKETS)
            grams.append(found[np.argsort(of, kind="stable")].astype(np.int32))
            many.append(np.bincount(of, minlength=len(part)))
        return cls(np.concatenate(bags), np.array([len(b) for b in bags], dtype=np.int64), np.concatenate(grams), np.concatenate(many))

    def scores(self, weight: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weight[self.grams], np.cumsum(self.many) - self.many) / self.many if len(self.many) else np.zeros(0)

    def members(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of some of the texts, in rising order of ``rows``, and how many each has."""
        use = np.zeros(len(self.sizes), dtype=bool)
        use[rows] = True
        return self.flat[np.repeat(use, self.sizes)], self.sizes[rows]


def _train(words: _Words, rows: np.ndarray, y: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and softmax from the chosen rows, both classes weighing the same."""
    flat, sizes = words.members(rows)
    doc, n, y = np.repeat(np.arange(len(sizes)), sizes), len(words.many), y[rows]
    balance = np.where(y > 0, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum()))
    rng = np.random.default_rng(seed)
    table, soft = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 1.0, (DIM, 2))
    bias, past, past_soft, past_bias = 0.0, 1e-6, 1e-3, 1e-3
    for epoch in range(EPOCHS if n else 0):
        side = soft[:, 1] - soft[:, 0]
        focus = FOCUS * min(1.0, epoch / RISE)
        score = words.scores(table @ side)[flat]
        mean, weight = _averages(score, sizes, focus)
        error = (1 / (1 + np.exp(-np.clip(mean + bias, -40, 40))) - y) * balance
        on_word = np.bincount(flat, weight * (1 + focus * (score - mean[doc])) * error[doc], n) / words.many
        on_gram = np.bincount(words.grams, np.repeat(on_word, words.many), BUCKETS)
        live = np.flatnonzero(on_gram)
        step = on_gram[live] * 1e3
        past += (step**2).sum()
        on_side = step @ table[live]
        table[live] -= (STEP * step / np.sqrt(past))[:, None] * side[None, :] / max(1.0, np.linalg.norm(side))
        table *= 1 - DECAY
        past_soft += (on_side**2).sum()
        move = 0.3 * on_side / np.sqrt(past_soft)
        soft[:, 1] -= move / 2
        soft[:, 0] += move / 2
        past_bias += (b := error.sum() * 10) ** 2
        bias -= 0.3 * b / np.sqrt(past_bias)
    return table, soft


def fit(texts: list[str], labels: list[int], weights: list[float] | None = None, seed: int = 7) -> Model:
    """Fit on texts with labels 0 and 1; ``weights`` restore the base rate of a sample.

    Without any text the score is 0.007 for all; with one class only, its smoothed share.
    """
    y = np.array(labels, dtype=float)
    weight = np.ones(len(y)) if weights is None else np.array(weights, dtype=float)
    if not len(y):
        return Model(np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 2)), 1.0, -5.0)
    words, rows = _Words.of(texts), np.arange(len(y))
    unseen, place = np.zeros(len(y)), np.where(y > 0, np.cumsum(y > 0), np.cumsum(y <= 0)).astype(int)  # each class is dealt in turn
    for turn in range(FOLDS):
        hidden = rows[place % FOLDS == turn]
        table, soft = _train(words, rows[place % FOLDS != turn], y, seed)
        flat, sizes = words.members(hidden)
        unseen[hidden] = _averages(words.scores(table @ (soft[:, 1] - soft[:, 0]))[flat], sizes, FOCUS)[0]
    table, soft = _train(words, rows, y, seed)
    return Model(table.astype(np.float32), soft, *platt(unseen, y, weight))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve, by Newton steps on smoothed targets."""
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(x.std()), 1e-6)
    z = (x - x.mean()) / spread
    best = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(t):
        q = t[0] * z + t[1]
        return (weight * (np.logaddexp(0, q) - target * q)).sum() + 5e-3 * t[0] ** 2

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(best[0] * z + best[1], -40, 40)))
        d, s = weight * (p - target), weight * p * (1 - p) + 1e-9
        h = np.array([[(s * z * z).sum() + 1e-2, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        move = np.linalg.solve(h, [(d * z).sum() + 1e-2 * best[0], d.sum()])
        step = 1.0
        while step > 1e-6 and loss(best - step * move) > loss(best):
            step /= 2
        best = best - step * move
        if np.abs(step * move).max() < 1e-7:
            break
    a, b = best[0] / spread, best[1] - best[0] * x.mean() / spread
    return (float(a), float(b)) if a > 0 else (0.0, float(np.log((n1 + 1) / (n0 + 1))))


def sample_labelled(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: tuple[int, int] = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[list[str], list[int], list[float]]:
    """Texts, labels and weights of a bounded sample of the labelled rows.

    Rows with a null id, label or text teach nothing; an id with both labels counts as 1,
    one with several texts as its shortest.
    """
    h = F.pmod(F.xxhash64(labels[id_col].cast("string")), F.lit(1 << 40))
    known = labels.where(usable & labels[id_col].isNotNull() & labels[label_col].isin(0, 1)).select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label"), h.alias("h"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(_share(max_rows[1], counts.get(1, 0)))).otherwise(F.lit(_share(max_rows[0], counts.get(0, 0))))
    picked: dict = {}
    for r in known.where(F.col("h") < share).collect():
        picked[r["id"]] = (max(r["label"], picked.get(r["id"], (0,))[0]), r["h"])
    order = sorted(picked, key=lambda k: picked[k][1])
    chosen = [k for c in (0, 1) for k in [k for k in order if picked[k][0] == c][: max_rows[c]]]
    if not chosen:
        return [], [], []
    text = docs[text_col].cast("string")
    own = docs.where(docs[id_col].isin(chosen) & text.isNotNull()).select(docs[id_col].alias("id"), F.length(text).alias("n"), text.alias("text"))
    rows = own.groupBy("id").agg(F.min("n").alias("n")).collect()
    size, kept, total = {r["id"]: r["n"] for r in rows}, [], 0
    for k in sorted(size, key=lambda k: picked[k][1]):
        if total + size[k] <= max_chars or not kept:
            kept.append(k)
            total += size[k]
    if not kept:
        return [], [], []
    # of the texts of a repeated id the shortest, then the smallest; merged before they come here
    one = own.where(F.col("id").isin(kept)).groupBy("id").agg(F.min(F.struct("n", "text")).alias("t"))
    found = {r["id"]: r["text"] for r in one.select("id", "t.text").collect()}
    keys = sorted(found, key=lambda k: picked[k][1])
    y = [picked[k][0] for k in keys]
    weights = [counts.get(c, 0) / max(1, y.count(c)) for c in y]
    mean = sum(weights) / len(weights)
    return [found[k] for k in keys], y, [w / mean for w in weights]


def _share(rows: int, count: int) -> int:
    return int((1 << 40) * min(1.0, 1.2 * rows / count)) + 1 if count else 0


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, score) of each row, or with ``keep`` all columns of ``docs`` and ``toxicity_score``.

    Null and empty texts get the score of a text without any word.  Repeated rows are
    scored each; other columns are ignored (or kept); an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers
    schema = docs.schema if keep else docs.select(docs[id_col].alias("id")).schema
    source = docs.select(docs[text_col].cast("string").alias(fresh("_text", docs.columns)), *([docs[c] for c in docs.columns] if keep else [docs[id_col].alias("id")]))
    name = fresh("toxicity_score", docs.columns) if keep else "score"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        for batch in batches:
            texts, known = batch.column(0).to_pylist(), worker_cache(("toxicity", fitted.name), dict)
            score = np.concatenate([np.zeros(0), *(fitted.score(texts[a:b], known) for a, b in slices(texts, 1 << 20))])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], names=[*batch.schema.names[1:], name])

    out = source.mapInArrow(run, T.StructType([*schema.fields, T.StructField(name, T.DoubleType())]))
    return out if keep else out.withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns.

    Null and empty texts have the score of a text without any word; repeated rows stay or
    go together; an empty table stays empty.
    """
    scored = score_documents(docs, model, id_col, text_col, keep=True)
    return scored.where(F.col(scored.columns[-1]) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
