"""Language identification by interpolated Kneser-Ney character models.

One model per language; up to ``LANGS_PER_BLOCK`` of them share sorted arrays of n-gram
hashes with a row of log-probabilities, one column per language, so tables grow with the
number of languages and not with its square.  Every language that the sample has is
learned.  A text gets the language of the lowest cross-entropy per character.  Two things are calibrated on training rows that the counts
leave out: the temperature that turns cross-entropies into a score, and, per language,
the cross-entropy above which a text is rejected, the ``REJECT_QUANTILE`` of those rows.

The models are a classifier fitted on a bounded sample: at most ``MAX_ROWS`` rows and
``MAX_CHARS`` characters a language, the rows with the smallest hashes of their ids; rows
longer than ``MAX_CHARS`` teach nothing.  A hash has room for 32,765 different letters, the
most frequent ones of the sample; any rarer one is counted as one more letter.
Prediction covers every character of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

ORDER = 4
MAX_ROWS = 400  # sample rows a language
LANGS_PER_BLOCK = 8
MAX_CHARS = 1_500_000  # sample characters a language
CALIBRATION_SHARE = 5  # every fifth sample row is kept from the counts
REJECT_QUANTILE = 0.995
_BITS = 15
_WORK = 1 << 20
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts and the number in each."""
    low = [t.lower() if t else "" for t in texts]
    sizes = np.array([len(t) for t in low], dtype=np.int64)
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4"), sizes


def encode(texts: list[str | None], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts and the number of symbols of each.

    0 is a gap: any run of characters that aren't letters; a text starts and ends with
    one.  The letters of ``alphabet`` follow, then one symbol for all other letters.  A
    text without letters has no symbol.
    """
    points, sizes = _points(texts)
    symbol = np.zeros(0x110000, dtype=np.int16)
    symbol[letter_table()] = len(alphabet) + 1
    symbol[alphabet] = np.arange(1, len(alphabet) + 1)
    codes = symbol[points]
    doc = np.repeat(np.arange(len(texts)), sizes)
    letter = codes > 0
    before = np.zeros(len(codes), dtype=bool)
    before[1:] = letter[:-1] & (doc[1:] == doc[:-1])
    keep = letter | before
    codes, doc, letter = codes[keep], doc[keep], letter[keep]
    last = np.ones(len(codes), dtype=bool)
    last[:-1] = doc[1:] != doc[:-1]
    gaps = np.flatnonzero(last & letter) + 1  # a text that ends with a letter gets its closing gap
    codes, doc = np.insert(codes, gaps, 0), np.insert(doc, gaps, doc[gaps - 1])
    return codes.astype(np.int64), np.bincount(doc, minlength=len(texts))


def _grams(codes: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each symbol; gaps stand before a text."""
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = codes.copy()
    for k in range(1, order):
        back = np.zeros_like(codes)
        back[k:] = codes[:-k]
        back[at < k] = 0
        key |= back << (_BITS * k)
    return key


@dataclass
class Block:
    """Some languages: sorted hash arrays by order: n-grams with log-probabilities, contexts with log back-off weights."""

    langs: list[str]
    alphabet: np.ndarray
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]

    def _look_up(self, grams: np.ndarray, order: int) -> np.ndarray:
        keys = self.keys[order - 1]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        out = self.logp[order - 1][at]
        miss = np.flatnonzero(keys[at] != grams)
        if len(miss):
            if order == 1:
                out[miss] = self.backoff[0][0] - np.log(len(self.alphabet) + 2.0)
            else:
                part = grams[miss]
                lower = self._look_up(part & ((1 << (_BITS * (order - 1))) - 1), order - 1)
                context, known = part >> _BITS, self.contexts[order - 1]
                at = np.minimum(np.searchsorted(known, context), len(known) - 1)
                lower += np.where((known[at] == context)[:, None], self.backoff[order - 1][at], 0)
                out[miss] = lower
        return out

    def add(self, codes: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """Add the log-probabilities of the texts' symbols to ``out``, a row per text and a column per language."""
        some, starts = size > 0, (np.cumsum(size) - size)[size > 0]
        rows = self._look_up(_grams(codes, size, len(self.keys)), len(self.keys))
        for k in range(len(self.langs)):
            out[some, k] += np.add.reduceat(rows[:, k], starts, dtype=np.float64)


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray
    blocks: list[Block]
    temperature: float
    reject_above: np.ndarray

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol, a row per text and a column per language; symbols of each text."""
        total, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        for a, b in slices(texts, _WORK):
            codes, size = encode(texts[a:b], self.alphabet)
            sizes[a:b] = size
            if len(codes):
                for i, block in enumerate(self.blocks):
                    block.add(codes, size, total[a:b, i * LANGS_PER_BLOCK : (i + 1) * LANGS_PER_BLOCK])
        return -total / np.maximum(sizes, 1)[:, None], sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, lowest cross-entropy and rejection of each text."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
        bits, sizes = self.cross_entropy(texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        score = 1 / np.exp(-self.temperature * (bits - low[:, None])).sum(axis=1)
        none = sizes == 0
        score[none], low[none] = 0.0, 0.0
        names = ["und" if n else self.langs[k] for k, n in zip(best, none, strict=True)]
        return names, score, low, none | (low > self.reject_above[best])


def _merge(keys: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)


def _block(train: dict[str, list[str]], alphabet: np.ndarray, order: int) -> Block:
    """The models of some languages, from their training texts."""
    langs = sorted(train)
    counts: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(order)]
    for x in langs:
        codes, sizes = encode(train[x], alphabet)
        counts[order - 1][x] = np.unique(_grams(codes, sizes, order), return_counts=True)
        for k in range(order - 1, 0, -1):  # lower orders count the different symbols before
            counts[k - 1][x] = np.unique(counts[k][x][0] & ((1 << (_BITS * k)) - 1), return_counts=True)
    model = Block(langs, alphabet, [], [], [np.zeros(0, np.int64)], [np.zeros((0, len(langs)), np.float32)])
    uniform = 1.0 / (len(alphabet) + 2)
    for k in range(1, order + 1):
        keys = _merge([counts[k - 1][x][0] for x in langs])
        contexts = _merge([counts[k - 1][x][0] >> _BITS for x in langs]) if k > 1 else np.zeros(1, np.int64)
        seen = np.zeros((len(keys), len(langs)))
        for j, x in enumerate(langs):
            grams, n = counts[k - 1][x]
            seen[np.searchsorted(keys, grams), j] = n
        of = np.searchsorted(contexts, keys >> _BITS) if k > 1 else np.zeros(len(keys), np.int64)
        n1, n2 = (seen == 1).sum(axis=0), (seen == 2).sum(axis=0)
        discount = np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.9)
        total = np.zeros((len(contexts), len(langs)))
        kinds = np.zeros_like(total)
        np.add.at(total, of, seen)
        np.add.at(kinds, of, seen > 0)
        gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        if k == 1:
            model.contexts[0], model.backoff[0] = contexts, np.log(gamma).astype(np.float32)
            lower = np.full((len(keys), len(langs)), uniform)
        else:
            lower = np.exp(model._look_up(keys & ((1 << (_BITS * (k - 1))) - 1), k - 1).astype(float))
            model.contexts.append(contexts)
            model.backoff.append(np.log(gamma).astype(np.float32))
        p = np.maximum(seen - discount, 0) / np.maximum(total[of], 1) + gamma[of] * lower
        model.keys.append(keys)
        model.logp.append(np.log(p).astype(np.float32))
    return model


def fit(samples: dict[str, list[str]], order: int = ORDER) -> Model:
    """Fit the models on texts by language; without any, every text is ``und`` and rejected."""
    langs = sorted(samples)
    if not langs:
        return Model([], np.zeros(0, np.int64), [], 1.0, np.zeros(0))
    often = np.zeros(0x110000, dtype=np.int64)
    for x in langs:
        often += np.bincount(_points(samples[x])[0], minlength=0x110000)
    often[~letter_table()] = 0
    letters = np.flatnonzero(often)
    alphabet = np.sort(letters[np.argsort(-often[letters], kind="stable")][: (1 << _BITS) - 3])
    train, rest = {}, {}
    for x in langs:
        held = [t for i, t in enumerate(samples[x]) if i % CALIBRATION_SHARE == CALIBRATION_SHARE - 1]
        train[x] = [t for i, t in enumerate(samples[x]) if i % CALIBRATION_SHARE != CALIBRATION_SHARE - 1]
        rest[x] = held or train[x]
    blocks = [_block({x: train[x] for x in langs[i : i + LANGS_PER_BLOCK]}, alphabet, order) for i in range(0, len(langs), LANGS_PER_BLOCK)]
    model = Model(langs, alphabet, blocks, 1.0, np.full(len(langs), np.inf))
    bits, truth = [], []
    for j, x in enumerate(langs):
        found, sizes = model.cross_entropy(rest[x])
        found = found[sizes > 0]
        if len(found):
            model.reject_above[j] = np.quantile(found[:, j], REJECT_QUANTILE)
            bits.append(found)
            truth += [j] * len(found)
    if bits:
        h = np.concatenate(bits)
        grid = 2.0 ** np.arange(0, 8)
        loss = [(np.log(np.exp(-t * (h - h.min(axis=1, keepdims=True))).sum(axis=1)) + t * (h[np.arange(len(h)), truth] - h.min(axis=1))).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def sample_texts(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> dict[str, list[str]]:
    """Texts by language from a bounded sample of the usable rows.

    Rows are taken by the hash of their id until a language has ``max_rows`` rows or
    ``max_chars`` characters.  The share of a language's rows that may come is set from its
    count and lengths are looked at first, so no more text than that reaches the driver,
    and the table is not shuffled.  Rows with a null text or language teach nothing.
    """
    text, lang = docs[text_col].cast("string"), docs[lang_col].cast("string")
    h = F.pmod(F.xxhash64(F.coalesce(docs[id_col].cast("string"), F.lit("")), text), F.lit(1 << 40))
    known = docs.where(usable & lang.isNotNull() & text.isNotNull()).select(h.alias("h"), lang.alias("lang"), F.length(text).alias("n"), text.alias("text"))
    known = known.where(F.col("n").between(1, max_chars))
    counts = known.groupBy("lang").count().collect()  # a row per language
    if not counts:
        return {}
    below = lambda cut: F.element_at(F.create_map(*[F.lit(x) for item in cut.items() for x in item]), F.col("lang"))
    share = {r["lang"]: int((1 << 40) * min(1.0, 1.3 * max_rows / r["count"])) + 1 for r in counts}
    rows, cut, used = known.where(F.col("h") < below(share)).select("h", "lang", "n").collect(), {}, {}
    for r in sorted(rows, key=lambda r: r["h"]):
        n, chars = used.get(r["lang"], (0, 0))
        if n < max_rows and chars + r["n"] <= max_chars:
            used[r["lang"]], cut[r["lang"]] = (n + 1, chars + r["n"]), r["h"] + 1
        else:
            used[r["lang"]] = (max_rows, max_chars)
    if not cut:
        return {}
    out: dict[str, list[str]] = {}
    for r in sorted(known.where(F.col("h") < below(cut)).select("h", "lang", "text").distinct().collect(), key=lambda r: (r["h"], r["text"])):
        if any(map(str.isalpha, r["text"])):
            out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) of each row.

    ``lang_pred`` is ``und`` for null texts and texts without a letter, with score 0 and
    rejected; otherwise the learned language of the lowest cross-entropy (ties: the first
    by name).  ``score`` is the calibrated probability of that language, ``rejected``
    says that the text is unlike what was learned.  Repeated rows are judged each; other
    columns are ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        for batch in batches:
            names, score, low, far = fitted.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(low), pa.array(far)], names=["id", "lang_pred", "score", "cross_entropy", "rejected"])

    out = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
