"""Near-duplicate documents by BagMinHash over five-word shingles.

A document is the multiset of its shingles.  BagMinHash draws, for each shingle, Poisson
processes over the levels of its weight: one process for each of the level ranges [0,1),
[1,2), [2,4), [4,8) and so on, of which each point falls by halving into one level and
counts if the weight reaches above it.  A point carries a signature component at random;
the first point of a component wins it.  Points come in order of time, so a document
stops as soon as every component is won: long texts cost one draw a shingle and a fixed
number more.  Two signatures agree in a component with probability equal to the weighted
Jaccard similarity, without bias.

Documents of equal word sequences are one node.  Nodes that agree in a band of the
signature meet in a bucket.  Each node is verified against the bucket's head, the member
that meets most others; what is then still outside the head's component is verified
against all bucket members of other components.  So no link that could join two
components is skipped, and members that already hang together are not paired.  In buckets
of at most ``PAIRED`` nodes the second step lists pairs, each once for all its buckets;
larger buckets are dealt into blocks, and a task compares two blocks by one table of
shared shingles and sends back only the links.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import bound_batches, durable, fresh, slices, split_join
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
#: Nodes of a pair list up to which it may be broadcast (24 bytes each).
BROADCAST_NODES = 200_000
#: Nodes of a bucket up to which its remaining pairs are listed.
PAIRED = 48
#: Nodes and words of a block of a larger bucket.
BLOCK_NODES, BLOCK_WORDS = 512, 400_000
#: Rounding of the quotient of two whole numbers.
CLOSE = 1e-12
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, ASCII capitals made small."""
    return text.lower().split() if text else []


def shingles(docs: list[list[bytes]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the documents, their weights, and the document of each.

    A text of fewer words than a shingle, but some, is one shingle.
    """
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    w = np.fromiter((xxh3_64_intdigest(x) for d in docs for x in d), dtype=_U, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(docs)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(w))
    first = left == np.repeat(sizes, sizes)
    at = np.flatnonzero((left >= size) | first)
    h = np.zeros(len(at), dtype=_U)
    padded = np.concatenate([w, np.zeros(size, _U)])
    for k in range(size):
        h = (h ^ np.where(left[at] > k, padded[at + k], _U(k + 1))) * _BASE
        h ^= h >> _U(29)
    order = np.lexsort((h, doc[at]))
    h, d = h[order], doc[at][order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    heads = np.flatnonzero(new)
    return h[heads], np.diff(np.append(heads, len(h))), d[heads]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def signatures(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, length: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures, a row per document; documents without weight get zeros."""
    out = np.zeros((docs, length), dtype=_U)
    total = np.bincount(doc, weight, docs)
    todo = np.flatnonzero(total > 0)
    horizon = np.zeros(docs)
    horizon[todo] = (np.log(length) + 4) / total[todo]
    # one process per shingle and level range that its weight reaches into
    levels = np.zeros(len(weight), dtype=np.int64)
    levels[weight > 1] = np.ceil(np.log2(weight[weight > 1])).astype(np.int64)
    entry = np.repeat(np.arange(len(h)), levels + 1)
    k = np.arange(len(entry)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    low = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0))
    wide = np.where(k == 0, 1, 1 << np.maximum(k - 1, 0))
    seed, of, top = _mix(h[entry] + _U(0x9E37) * (k.astype(_U) + _U(1))), doc[entry], weight[entry]
    while len(todo):
        wanted = np.zeros(docs, bool)
        wanted[todo] = True
        live = np.flatnonzero(wanted[of])
        time, i = np.zeros(len(live)), 0
        when, who, what, point = [], [], [], []
        while len(live):
            i += 1
            r = _mix(seed[live] + np.array([i], _U) * _BASE)
            time = time - np.log((r >> _U(11)).astype(float) * 2.0**-53 + 2.0**-54) / (wide[live] * float(length))
            keep = time <= horizon[of[live]]
            live, time, r = live[keep], time[keep], r[keep]
            s = _mix(r ^ _U(0xA5A5A5A5A5A5A5A5))
            level = low[live] + ((s >> _U(32)).astype(np.int64) & (wide[live] - 1))  # the halvings, from the top down
            hit = level < top[live]
            when.append(time[hit])
            who.append(of[live[hit]])
            what.append(((s & _U(0xFFFFFFFF)) % _U(length)).astype(np.int64)[hit])
            point.append(s[hit])
        when, who, what, point = (np.concatenate(x) if x else np.zeros(0) for x in (when, who, what, point))
        cell = (who * length + what).astype(np.int64)
        order = np.lexsort((when, cell))
        cell = cell[order]
        heads = np.ones(len(cell), bool)
        heads[1:] = cell[1:] != cell[:-1]
        out.reshape(-1)[cell[heads]] = point[order][heads]
        filled = np.bincount(cell[heads] // length, minlength=docs)
        todo = todo[filled[todo] < length]
        horizon[todo] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket key for each band of each signature."""
    keys = np.zeros((len(signature), bands), dtype=_U)
    for b in range(bands):
        h = np.full(len(signature), _U(b + 1))
        for r in range(rows):
            h = _mix(h * _BASE ^ signature[:, b * rows + r])
        keys[:, b] = h
    return keys


def node_of(text: bytes | None) -> bytes | None:
    """A 128-bit key of the word sequence; none without words."""
    found = words_of(text)
    return xxh3_128_digest(b" ".join(found)) if found else None


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, n, bands) of each row; node is null for texts without words."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 1 << 20):
                found = [words_of(t) for t in texts[a:b]]
                h, weight, doc = shingles(found)
                keys = band_keys(signatures(h, weight, doc, b - a)).view(np.int64)
                n = np.bincount(doc, weight, b - a).astype(np.int64)
                nodes = pa.array([xxh3_128_digest(b" ".join(f)) if f else None for f in found], pa.binary())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), nodes, pa.array(n), bands], names=["id", "node", "n", "bands"])

    return docs.select(docs[id_col], docs[text_col].cast("string").cast("binary")).mapInArrow(run, f"id {kind}, node binary, n long, bands array<long>")


def node_texts(docs: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, text) of the wanted nodes, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [node_of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column(0)], names=["node", "text"])

    keyed = docs.select(docs[text_col].cast("string").cast("binary").alias("text")).mapInArrow(run, "node binary, text binary")
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    return keyed.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def _overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    same = np.minimum(a[1][i], b[1][j]).sum()
    return same / max(1, a[1].sum() + b[1].sum() - same)


def verify(pairs: DataFrame, docs: DataFrame, threshold: float, text_col: str = "text") -> DataFrame:
    """The pairs (a, b) of nodes whose shingle multisets overlap by the threshold or more."""
    wanted = durable(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"))
    texts = durable(node_texts(docs, wanted, text_col))
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    joined = joined.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict = OrderedDict()

        def bag(node: bytes, text: bytes):
            if node not in recent:
                h, weight, _ = shingles([words_of(text)])
                recent[node] = h, weight
                if len(recent) > 64:
                    recent.popitem(last=False)
            recent.move_to_end(node)
            return recent[node]

        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            keep = [_overlap(bag(*x), bag(*y)) >= threshold - CLOSE for x, y in zip(zip(a, ta, strict=True), zip(b, tb, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return durable(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary"))


def shared(h: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """For each two of some documents, the size of the overlap of their multisets."""
    copies = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    h, doc = _mix(np.repeat(h, weight) + copies.astype(_U) * _BASE), np.repeat(doc, weight)  # a copy more is an element more
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    often = np.diff(np.append(heads, len(h)))
    out = np.zeros(docs * docs)  # whole numbers
    for k in np.unique(often[(often > 1) & (often < 12)]):
        members = doc[heads[often == k][:, None] + np.arange(k)]
        for a in range(0, len(members), 1 << 15):
            m = members[a : a + (1 << 15)]
            out += np.bincount((m[:, :, None] * docs + m[:, None, :]).reshape(-1), minlength=docs * docs)
    out = out.reshape(docs, docs)
    many = np.flatnonzero(often >= 12)
    for a in range(0, len(many), 4096):
        part = many[a : a + 4096]
        x = np.zeros((docs, len(part)), dtype=np.float32)
        for c, i in enumerate(part):
            x[doc[heads[i] : heads[i] + often[i]], c] = 1
        out += x @ x.T
    return out


def _block_links(placed: DataFrame, docs: DataFrame, threshold: float, text_col: str) -> DataFrame:
    """Links in large buckets between nodes of different components, one of them outside the main one.

    ``placed``: (bucket, node, n, component, main).
    """
    size = placed.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_WORDS)).cast("int").alias("blocks"))
    rows = placed.join(size, "bucket").withColumn("side", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ("bucket", "i", "j")
    rows = rows.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "component", (F.col("component") != F.col("main")).alias("outside"))
    texts = durable(node_texts(docs, durable(placed.select("node").distinct()), text_col))
    rows = rows.join(texts, "node").repartition(*group).sortWithinPartitions(*group)

    def compare(rows: list[tuple]) -> tuple[list[bytes], list[bytes]]:
        side, node, component, outside, text = zip(*rows, strict=True)
        if not any(outside):
            return [], []
        h, weight, doc = shingles([words_of(t) for t in text])
        same = shared(h, weight, doc, len(rows))
        total = np.bincount(doc, weight, len(rows))
        _, part = np.unique(np.array(component, dtype=object), return_inverse=True)
        out, side = np.array(outside), np.array(side)
        close = same / (total[:, None] + total[None, :] - same) >= threshold - CLOSE
        close &= (part[:, None] != part[None, :]) & (out[:, None] | out[None, :])
        if len(set(side)) > 1:
            close &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(close, 1))
        return [node[k] for k in i], [node[k] for k in j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        key = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*group, "side", "node", "component", "outside", "text")]
            for bucket, i, j, *rest in zip(*columns, strict=True):
                if (bucket, i, j) != key:
                    if len(waiting) > 1:
                        yield built(compare(waiting))
                    waiting, key = [], (bucket, i, j)
                waiting.append(tuple(rest))
        if len(waiting) > 1:
            yield built(compare(waiting))

    def built(links: tuple[list[bytes], list[bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in links], names=["a", "b"])

    return durable(rows.mapInArrow(run, "a binary, b binary"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, class_id, kept) of each row: the least id of its class, and whether it is that.

    Two texts are linked if their multisets of five-word shingles overlap by ``threshold``
    or more (weighted Jaccard); a class is what links reach.  Equal texts are always in one
    class.  Texts without words, null or empty, are classes of their own, all kept.  A null
    id is the least only where a class has no other.  Repeated rows share class and fate.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = durable(sketch(docs, id_col, text_col))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    met = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = durable(met.join(sizes, "bucket"))
    score = met.groupBy("node").agg(F.sum("size").alias("score"))
    met = met.join(score, "node")
    heads = met.groupBy("bucket").agg(F.max(F.struct("score", "node")).getField("node").alias("head"))
    met = durable(met.drop("score").join(heads, "bucket"))
    ratio = F.least("n", "m") >= threshold * F.greatest("n", "m")
    pair = (F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
    head_n = met.where("node = head").select("bucket", F.col("n").alias("m"))
    first = durable(met.join(head_n, "bucket").where((F.col("node") != F.col("head")) & ratio).withColumn("other", F.col("head")).select(*pair).distinct())
    links = verify(first, docs, threshold, text_col)
    part = durable(components(links))
    placed = met.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_head = part.select(F.col("node").alias("head"), F.col("component").alias("main"))
    placed = placed.join(of_head, "head", "left").withColumn("main", F.coalesce("main", "head"))
    mixed = placed.groupBy("bucket").agg(F.max(F.col("component") != F.col("main")).alias("mixed")).where("mixed").select("bucket")
    placed = durable(placed.join(mixed, "bucket"))
    small = placed.where(F.col("size") <= PAIRED)
    outside = small.where("component != main").select("bucket", "node", "n", "component")
    inside = small.select("bucket", F.col("node").alias("other"), F.col("n").alias("m"), F.col("component").alias("there"))
    second = outside.join(inside, "bucket").where((F.col("component") != F.col("there")) & ratio).select(*pair).distinct()
    second = durable(second.join(first, ["a", "b"], "left_anti"))
    large = placed.where(F.col("size") > PAIRED).select("bucket", "node", "n", "component", "main")
    links = links.union(verify(second, docs, threshold, text_col)).union(_block_links(large, docs, threshold, text_col))
    part = components(links)
    classed = nodes.select("node", "least", "copies").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classed.groupBy("component").agg(F.min("least").alias("class_id"))
    classed = durable(classed.join(least, "component").select("node", "copies", "class_id", "component"))
    # a text may have very many copies
    known = split_join(rows.where("node is not null").select("id", "node"), classed, ["node"], "copies", rows.count())
    bare = rows.where("node is null").select("id", "node", F.lit(None).cast("binary").alias("component"), F.col("id").alias("class_id"))
    out = known.select(*bare.columns).unionByName(bare)
    return out.select(F.col("id").alias(id_col), "node", "component", "class_id").withColumn("kept", F.col("class_id").eqNullSafe(F.col(id_col)))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate class, that of the smallest id, with its columns.

    Rows without words all stay, but for rows repeated under one id.
    """
    found = near_duplicates(docs, threshold, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), F.col("node").alias("key")).distinct()
    raw, node = fresh("raw_text", docs.columns), fresh("node", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [node_of(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(nodes, pa.binary())], names=[*batch.schema.names[1:], node])

    keyed = docs.select(docs[text_col].cast("string").cast("binary").alias(raw), *[docs[c] for c in docs.columns])
    keyed = keyed.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(node, T.BinaryType())]))
    kept = keyed.join(found, keyed[id_col].eqNullSafe(found["id"]) & keyed[node].eqNullSafe(found["key"]), "left_semi")
    return kept.dropDuplicates([id_col, node]).select(*[F.col(f"`{c}`") for c in docs.columns])
