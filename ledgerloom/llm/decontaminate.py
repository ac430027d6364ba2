"""Benchmark decontamination with suffix arrays of the training text.

Each batch of documents is a shard.  Its words become numbers of the benchmark's
vocabulary; words outside it can be part of no match, so only stretches of known words
as long as the shortest window enter the shard's suffix array.  Every benchmark suffix
is looked up by binary search; the interval found gives all verbatim occurrences of its
first ``window`` words, and occurrences on one diagonal add up to the longest matches.

The benchmark is dealt into blocks of at most ``BLOCK_BYTES`` of text by a hash.  One
block is broadcast at a time; with more than one, the findings so far are checkpointed
between passes, so neither driver nor executors hold the whole benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, durable, fresh

WINDOW = 10
BLOCK_BYTES = 16 << 20
_SHARD = 1 << 22
# ASCII capitals become small; other ASCII characters that are no letter or digit become blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType()), T.StructField("doc_start", T.LongType()), T.StructField("length", T.LongType())]))


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: runs of small ASCII letters (after folding), digits and other scripts."""
    return text.translate(_FOLD).split() if text else []


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``s`` ordered by their suffixes, compared over ``depth`` symbols at least (prefix doubling)."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.zeros(n + 1, dtype=np.int64)
    k = 1
    rank[order] = np.cumsum(np.concatenate([[1], s[order][1:] != s[order][:-1]]))
    while k < depth and rank.max() < n:
        second = np.zeros(n, dtype=np.int64)
        second[: max(0, n - k)] = rank[k:n] if k < n else 0
        key = rank[:n] * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[1], key[order][1:] != key[order][:-1]]))
        k *= 2
    return order


class TestSet:
    """A block of benchmark items: vocabulary, and the suffixes that have room for a window."""

    __test__ = False

    def __init__(self, items: list[tuple[list[str], bytes | None]], window: int):
        """``items``: the names that share a text, and the text."""
        self.window, self.vocabulary = window, {}
        rows, self.names = [], []
        for name, text in sorted(items, key=lambda x: (x[0], x[1] or b"")):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                rows.append(ids)
                self.names.append(name or [None])
        self.shortest = min([window, *map(len, rows)])
        heads, self.item, self.start, self.width = [], [], [], []
        for i, ids in enumerate(rows):
            w = min(window, len(ids))
            for p in range(len(ids) - w + 1):
                heads.append(ids[p : p + w] + [0] * (window - w))
                self.item.append(i)
                self.start.append(p)
                self.width.append(w)
        self.heads = np.array(heads, dtype=np.int64).reshape(len(heads), window)
        self.item, self.start, self.width = (np.array(x, dtype=np.int64) for x in (self.item, self.start, self.width))

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (suffix, position) with the suffix's window verbatim at that position of ``codes``."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.heads) or not len(codes):
            return none
        known = np.concatenate([[False], codes > 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        if not len(begin):
            return none
        size = end - begin + 1  # each stretch and a gap
        where = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        s = np.where(where < np.repeat(end, size), codes[np.minimum(where, len(codes) - 1)], 0)
        order = suffix_array(s, min(int(size.max()), len(s)))
        padded = np.concatenate([s, np.zeros(self.window, np.int64)])
        tests = np.flatnonzero(np.isin(self.heads[:, 0], s))
        low, high = self._bound(padded, order, tests, False), self._bound(padded, order, tests, True)
        n = high - low
        at = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return np.repeat(tests, n), where[at]

    def _bound(self, s: np.ndarray, order: np.ndarray, tests: np.ndarray, after: bool) -> np.ndarray:
        """Binary search, all tests at once: the first suffix not below (or above) the test's window."""
        low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(order), np.int64)
        heads, width = self.heads[tests], self.width[tests]
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            sign = np.zeros(len(tests), np.int64)
            for k in range(self.window):
                live = (sign == 0) & (k < width)
                sign[live] = np.sign(s[at[live] + k] - heads[live, k])
            up = open_ & ((sign < 0) | (after & (sign == 0)))
            low = np.where(up, mid + 1, low)
            high = np.where(open_ & ~up, mid, high)
        return low

    def scan(self, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[tuple]]]:
        """Words, hit spans and the longest match with each item, of each text."""
        n_words, codes = [], []
        for text in texts:
            found = words(text)
            n_words.append(len(found))
            codes.append(np.fromiter(map(self.vocabulary.get, found, repeat(0)), dtype=np.int64, count=len(found)))
            codes.append(np.zeros(1, dtype=np.int64))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        matches: list[list[tuple]] = [[] for _ in texts]
        test, at = self.occurrences(np.concatenate(codes) if codes else np.zeros(0, np.int64))
        if len(test):
            first = np.cumsum([0, *(n + 1 for n in n_words)])
            doc = np.searchsorted(first, at, side="right") - 1
            at = at - first[doc]
            item, start, width = self.item[test], self.start[test], self.width[test]
            order = np.lexsort((at, doc))
            d, a, e = doc[order], at[order], (at + width)[order]
            reach = np.maximum.accumulate(d * (1 << 40) + e)
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (a[1:] + d[1:] * (1 << 40) > reach[:-1])
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(d)) - 1
            for i, b, f in zip(d[heads], a[heads], reach[tails] - d[heads] * (1 << 40), strict=True):
                spans[i].append((int(b), int(f)))
            order = np.lexsort((start, at - start, item, doc))
            d, m, g, p = doc[order], item[order], (at - start)[order], start[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (m[1:] != m[:-1]) | (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(d)) - 1
            length = p[tails] - p[heads] + width[order][heads]
            order = np.lexsort((g[heads], -length, m[heads], d[heads]))
            last = (-1, -1)
            for k in order:
                h = heads[k]
                if (d[h], m[h]) != last:
                    last = (d[h], m[h])
                    matches[d[h]] += [(name, int(p[h]), int(p[h] + g[h]), int(length[k])) for name in self.names[m[h]]]
        return n_words, spans, matches


def merge_spans(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _pass(state: DataFrame, tests: TestSet, text: str, names: list[str]) -> DataFrame:
    """Add a block's findings; ``names`` are the columns of words, spans and matches."""
    held = state.sparkSession.sparkContext.broadcast(tests)  # at most BLOCK_BYTES of text
    carried = [c for c in state.columns if c not in names]
    at, old = carried.index(text), [c in state.columns for c in names]
    schema = T.StructType([*(state.schema[c] for c in carried), T.StructField(names[0], T.LongType()), T.StructField(names[1], SPANS), T.StructField(names[2], MATCHES)])

    def shard(block: TestSet, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, spans, matches = block.scan(batch.column(at).to_pylist())
        if all(old):
            before = [[(x["start"], x["end"]) for x in s] for s in batch.column(len(carried) + 1).to_pylist()]
            spans = [merge_spans(a, b) for a, b in zip(before, spans, strict=True)]
            matches = [[tuple(x.values()) for x in a] + b for a, b in zip(batch.column(len(carried) + 2).to_pylist(), matches, strict=True)]
        span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        match_type = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())]))
        spans = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], span_type)
        keys = ("item_id", "item_start", "doc_start", "length")
        matches = pa.array([[dict(zip(keys, m, strict=True)) for m in x] for x in matches], match_type)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(n, pa.int64()), spans, matches], names=[*batch.schema.names[: len(carried)], *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, step := max(1, batch.num_rows * _SHARD // max(1, batch.nbytes))):
                yield shard(block, batch.slice(i, step))

    return state.select(*carried, *[c for c, there in zip(names, old, strict=True) if there]).mapInArrow(run, schema)


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """``docs`` with three columns added, and their names: n_words, hit spans, matches.

    Spans are half-open word ranges, merged; matches hold the longest verbatim match with
    each item.  A null text has no words; a null item id marks words but is not listed as
    an item; repeated items count once; clashing names get underscores; an empty benchmark
    finds nothing.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.select(benchmark[id_col].cast("string").alias("id"), benchmark[item_text].cast("string").cast("binary").alias("text"))
    items = items.groupBy("text").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # equal texts are searched once
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    names = [fresh(c, docs.columns) for c in ("n_words", "hit_spans", "matches")]
    raw = fresh("raw_text", docs.columns)
    state = docs.withColumn(raw, docs[text_col].cast("string").cast("binary"))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        tests = TestSet([(r["ids"], bytes(r["text"]) if r["text"] is not None else None) for r in part.collect()], window)
        state = _pass(state, tests, raw, names)
        if b < blocks - 1:
            state = durable(state)
    return state.drop(raw), names


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, items) of each row of ``docs``."""
    found, (n_words, spans, matches) = annotate(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), benchmark, window, **options)
    items = F.array_sort(F.array_distinct(F.filter(F.transform(F.col(matches), lambda m: m["item_id"]), lambda x: x.isNotNull())))
    n_hit = F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias(id_col), F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform(F.col(matches), lambda m: m["length"])), F.lit(0)).cast("long").alias("longest_match"), items.alias("items"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with their columns.

    Null and empty texts have no window and stay; repeated rows stay or go together; an
    empty table stays empty, and an empty benchmark removes nothing.
    """
    found, (_, spans, _) = annotate(docs, benchmark, window, **options)
    return found.where(F.size(F.col(spans)) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
