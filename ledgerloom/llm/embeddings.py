"""Near-duplicate embeddings by Euclidean p-stable hashing, verified by exact cosine.

Vectors are scaled to length one, so a cosine of ``c`` is a distance of ``sqrt(2 - 2c)``.
A table hashes a vector by ``depth`` Gaussian projections, shifted at random and cut into
cells of ``WIDTH``; vectors that fall into one cell of any table are compared exactly.  The
depth grows with the logarithm of the number of vectors, so a bucket holds few strangers,
and the number of tables follows from the recall wanted at the threshold itself; closer
pairs are found more surely.  Every vector is indexed; nothing is fitted.

Equal vectors are one node.  A bucket of more than ``BLOCK`` nodes is dealt into blocks and
each pair of blocks is a task's group, so no bucket is ever in one task whole.  A pair that
meets in several tables counts in the first of them, which its keys tell.  A group sends
back a sum of links and one anchor a node, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import bound_batches, durable, split_join
from .components import components

THRESHOLD = 0.95
RECALL = 0.999  # expected at the threshold; closer pairs are found more surely
WIDTH = 2.0
BLOCK = 256
SEED = 20240607


def cell_probability(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors at a distance share a cell of one projection."""
    x = width / max(distance, 1e-9)
    tail = 0.5 * math.erfc(x / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(depth, tables): strangers, at a right angle, share a bucket with 0.1 others on average."""
    depth = max(4, math.ceil(math.log(10 * max(n, 2)) / -math.log(cell_probability(math.sqrt(2)))))
    near = cell_probability(math.sqrt(max(0.0, 2 - 2 * threshold))) ** depth
    return depth, max(4, math.ceil(math.log(1 - recall) / math.log1p(-min(near, 1 - 1e-9))))


def table_keys(units: np.ndarray, depth: int, tables: int, seed: int = SEED) -> np.ndarray:
    """A 32-bit bucket key of each vector in each table."""
    rng = np.random.default_rng([seed, units.shape[1]])
    out = np.zeros((len(units), tables), np.int32)
    for t in range(tables):
        cells = np.floor((units @ rng.normal(size=(units.shape[1], depth)) + rng.uniform(0, WIDTH, depth)) / WIDTH).astype(np.int64)
        h = np.full(len(units), units.shape[1], np.uint64)
        for k in range(depth):
            h = (h ^ cells[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        out[:, t] = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return out


def units(vectors: pa.ListArray) -> list[bytes | None]:
    """Each vector at length one, as the bytes of its doubles; None if it can't link with anything."""
    out: list[bytes | None] = [None] * len(vectors)
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    start = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        x = flat[start[rows][:, None] + np.arange(size)]
        top = np.abs(x).max(axis=1)
        sound = np.isfinite(top) & (top > 0)
        x = x[sound] / top[sound][:, None]
        x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0  # a row at a time, so equal vectors stay equal
        for r, v in zip(rows[sound].tolist(), x, strict=True):
            out[r] = v.tobytes()
    return out


def _nodes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, node, unit): the node is a 128-bit key of the unit vector, null if it links with nothing."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = units(batch.column(1))
            keys = [None if d is None else xxh3_128_digest(d) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["id", "node", "unit"])

    return vectors.select(vectors[id_col], vectors[vector_col].cast("array<double>")).mapInArrow(run, f"id {kind}, node binary, unit binary")


def _hashed(nodes: DataFrame, depth: int, tables: int) -> DataFrame:
    """``nodes`` with the keys of all tables added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit").to_pylist()
            keys: list = [None] * len(units)
            by_size: dict[int, list[int]] = {}
            for i, u in enumerate(units):
                by_size.setdefault(len(u), []).append(i)
            for rows in by_size.values():
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096]
                    found = table_keys(np.stack([np.frombuffer(units[r]) for r in part]), depth, tables)
                    for r, k in zip(part, found, strict=True):
                        keys[r] = k.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, "keys"])

    return nodes.mapInArrow(run, "node binary, unit binary, size long, keys binary")


def _buckets(hashed: DataFrame, tables: int) -> DataFrame:
    """(node, tab, key): a row for each node and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32)
            node = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), tables)))
            tab = np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([node, pa.array(tab), pa.array(keys)], names=["node", "tab", "key"])

    return hashed.select("node", "keys").mapInArrow(run, "node binary, tab int, key int")


def _group_links(tab: int, across: bool, side: np.ndarray, units: list[bytes], keys: list[bytes], size: np.ndarray, threshold: float):
    """Links and anchors within a group; ``across`` compares its two blocks only."""
    x = np.stack([np.frombuffer(u) for u in units])
    close = np.triu(x @ x.T >= threshold, 1)
    if across:
        close &= side[:, None] != side[None, :]
    i, j = np.nonzero(close)
    if len(i) and tab:
        k = np.stack([np.frombuffer(b, np.int32) for b in keys])[:, :tab]
        new = np.concatenate([~(k[i[a : a + 65536]] == k[j[a : a + 65536]]).any(axis=1) for a in range(0, len(i), 65536)])
        i, j = i[new], j[new]
    if not len(i):
        return None
    links = np.zeros(len(units), np.int64)
    np.add.at(links, i, size[j])
    np.add.at(links, j, size[i])
    anchor = np.arange(len(units))
    while True:
        before = anchor.copy()
        np.minimum.at(anchor, i, anchor[j])
        np.minimum.at(anchor, j, anchor[i])
        anchor = anchor[anchor]
        if (anchor == before).all():
            return links, anchor


def _compare(groups: DataFrame, threshold: float) -> DataFrame:
    """(node, links, anchor) from rows sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        key = None

        def close() -> list[tuple]:
            out = []
            for width in {len(w[1]) for w in waiting}:  # one, but for chance collisions
                mine = [w for w in waiting if len(w[1]) == width]
                if len(mine) > 1:
                    nodes, units, sizes, keys, side = zip(*mine, strict=True)
                    found = _group_links(key[0], key[2] != key[3], np.array(side), list(units), list(keys), np.array(sizes), threshold)
                    out += [] if found is None else [(nodes[a], int(n), nodes[b]) for a, (n, b) in enumerate(zip(*found, strict=True)) if n]
            return out

        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("tab", "key", "i", "j", "node", "unit", "size", "keys", "side")]
            for tab, bucket, i, j, *rest in zip(*columns, strict=True):
                if (tab, bucket, i, j) != key:
                    rows += close()
                    waiting, key = [], (tab, bucket, i, j)
                waiting.append(tuple(rest))
            if rows:
                yield built(rows)
        if rows := close():
            yield built(rows)

    def built(rows: list[tuple]) -> pa.RecordBatch:
        node, links, anchor = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(links, pa.int64()), pa.array(anchor, pa.binary())], names=["node", "links", "anchor"])

    return groups.mapInArrow(run, "node binary, links long, anchor binary")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of each row of ``vectors``.

    ``n_links`` counts the other rows found at a cosine of ``threshold`` or more, in double
    precision; ``component_id`` is the smallest id that links reach.  Vectors that are null,
    empty, zero, or hold a null, NaN or infinite component link with nothing; vectors of
    different lengths don't link.  Repeated rows are other rows.  An empty table gives an
    empty result.
    """
    bound_batches(vectors.sparkSession)
    rows = _nodes(vectors, id_col, vector_col)
    nodes = durable(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.first("unit").alias("unit"), F.count("*").alias("size")))
    total = nodes.count()
    depth, tables = plan(total, threshold, recall)
    hashed = durable(_hashed(nodes.select("node", "unit", "size"), depth, tables))
    met = _buckets(hashed, tables)
    full = met.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = split_join(met, full, ["tab", "key"], "n", total * tables).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("side", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", "tab", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")
    group = ("tab", "key", "i", "j")
    placed = met.join(hashed, "node").repartition(*group).sortWithinPartitions(*group)
    found = durable(_compare(placed, threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("node").alias("a"), F.col("anchor").alias("b")).distinct())
    known = nodes.select("node", "least", "size").join(links, "node", "left").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    known = split_join(known, least, ["component"], "members", total)
    known = durable(known.select("node", "size", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"))
    ids = durable(rows.select("id", "node"))
    linked = split_join(ids.where("node is not null"), known, ["node"], "size", ids.count()).select("id", "n_links", "component_id")
    alone = ids.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id").withColumn("kept", F.col("component_id").eqNullSafe(F.col(id_col)))
