"""Packing tokenised examples into sequences: vector bin packing by dot products.

An example is cut into pieces of at most one sequence; whole sequences are closed at
once.  The pieces left over are placed by the dot-product heuristic: among the open
sequences that can take a piece under all three limits (tokens, segments, loss-bearing
tokens), the one whose remaining capacities have the largest inner product with the
piece's demands gets it.  If none can take it whole, the fullest open sequence is filled
to the brim and the rest is placed again.  At the end of a partition each open sequence
is cut down to powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .tokens import PieceEncoder

CAPACITY = 4096
MAX_SEGMENTS = 64
OPEN_SEQUENCES = 32


class VectorPacker:
    """Packs a stream of examples under limits of tokens, segments and loss-bearing tokens.

    Sequences hold ``[pieces, tokens, loss]``; a piece is ``(key, start, length, ids, total, loss)``.
    """

    def __init__(self, first_id: int = 0, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, open_limit: int = OPEN_SEQUENCES):
        self.capacity, self.segments = capacity, max_segments
        self.loss = capacity if max_loss is None else max_loss
        if min(self.capacity, self.segments, self.loss, open_limit) < 1:
            raise ValueError("each limit must be 1 at least")
        self.next_id, self.open_limit = first_id, open_limit
        self.pieces: list[list[tuple]] = [[] for _ in range(open_limit)]
        self.free = np.tile(np.array([self.capacity, self.segments, self.loss], dtype=float), (open_limit, 1))
        self.scale = np.array([self.capacity, self.segments, self.loss], dtype=float)

    def _close(self, slot: int) -> Iterator[tuple]:
        yield from self._emit(self.pieces[slot])
        self.pieces[slot] = []
        self.free[slot] = self.scale

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, total, _ in pieces:
            yield key, start, len(ids) // 4, crc32(ids), total, self.next_id, offset
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, key, ids: bytes, loss: np.ndarray | None = None) -> Iterator[tuple]:
        """Rows of the sequences that this example closes; ``loss``: which ids bear loss (all, if None)."""
        total, start = len(ids) // 4, 0
        borne = None if loss is None else np.concatenate([[0], np.cumsum(loss)])
        while start < total:
            if borne is None and total - start >= self.capacity <= self.loss:
                yield from self._emit([(key, start, ids[4 * start : 4 * (start + self.capacity)], total, self.capacity)])
                start += self.capacity
                continue
            start += yield from self._place(key, ids, start, total, borne)

    def _place(self, key, ids, start, total, borne):
        """Place the rest from ``start``, or as much as fits; return how many ids were placed."""
        want = min(total - start, self.capacity)
        cost = want if borne is None else int(borne[start + want] - borne[start])
        demand = np.array([want, 1, min(cost, self.loss)])
        fits = (self.free >= demand).all(axis=1)
        if fits.any():
            slot = int(np.where(fits, (self.free / self.scale) @ (demand / self.scale), -1.0).argmax())
        else:
            slot = int(np.where((self.free >= 1).all(axis=1), -self.free[:, 0], -np.inf).argmax())
        take = min(want, int(self.free[slot, 0]))
        if borne is None:
            cost = take = min(take, int(self.free[slot, 2]))
        else:
            take = min(take, int(np.searchsorted(borne, borne[start] + self.free[slot, 2], side="right")) - 1 - start)
            cost = int(borne[start + take] - borne[start])
        if take <= 0:
            yield from self._close(slot)
            return 0
        self.pieces[slot].append((key, start, ids[4 * start : 4 * (start + take)], total, None if borne is None else borne[start : start + take + 1] - borne[start]))
        self.free[slot] -= (take, 1, cost)
        if (self.free[slot] < 1).any():
            yield from self._finish(slot)
        return take

    def _finish(self, slot: int) -> Iterator[tuple]:
        """Close a sequence; one that a limit other than tokens has ended is cut to powers of two."""
        pieces, self.pieces[slot] = self.pieces[slot], []
        self.free[slot] = self.scale
        left = sum(len(p[2]) // 4 for p in pieces)
        while pieces:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= size
            now = []
            while size:
                key, start, ids, total, loss = pieces.pop(0)
                n = len(ids) // 4
                if n > size:
                    pieces.insert(0, (key, start + size, ids[4 * size :], total, loss))
                    ids, n = ids[: 4 * size], size
                now.append((key, start, ids, total, loss))
                size -= n
            yield from self._emit(now)

    def flush(self) -> Iterator[tuple]:
        for slot in range(self.open_limit):
            if self.pieces[slot]:
                yield from self._finish(slot)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None) -> DataFrame:
    """One row per piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document is its ids followed by ``end_id``.  All of them bear loss, or, with a
    ``loss_col`` of spans (start, end) of characters, those that start within a span, and
    the end id if a span reaches the end of the text; null spans are none.  Null and empty
    texts are the end id alone, repeated rows are packed each, other columns are ignored,
    and an empty table gives no piece.  Each input partition packs its own documents, so
    nothing is shuffled and a lost task is redone alone; the sequence id holds the
    partition in its upper bits.  Memory: one batch and ``OPEN_SEQUENCES`` sequences.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    end = np.array([end_id], dtype="<u4").tobytes()
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = PieceEncoder.of(tokenizer_path), None
        id_type = None

        def built(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type=id_type), *(pa.array(c, type=pa.int64()) for c in columns[1:])], names=names)

        for batch in batches:
            keys, texts, parts, spans = (batch.column(i).to_pylist() for i in range(4))
            id_type = batch.column(0).type
            rows: list[tuple] = []
            found = zip(encoder.encode(texts), [None] * len(texts), strict=True) if loss_col is None else map(encoder.masked, texts, spans)
            for key, (ids, loss), part in zip(keys, found, parts, strict=True):
                if packer is None:
                    packer = VectorPacker(part << 40, capacity, max_segments, max_loss)
                rows.extend(packer.add(key, ids + end, loss))
            if rows:
                yield built(rows)
        if packer is not None and (rows := list(packer.flush())):
            yield built(rows)

    out = docs.select(docs[id_col], docs[text_col].cast("string").cast("binary"), F.spark_partition_id().cast("long"), (docs[loss_col] if loss_col else F.lit(None)).cast("array<struct<start:long,end:long>>")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
