"""Exact-substring dedup with fixed-block anchors.

A repeated window of ``window`` words holds, wherever it stands, one whole block of its
document's grid of non-overlapping blocks, if a block has ``(window + 1) // 2`` words.  So
three passes over the documents find every repeat:

1. index the grid blocks of all documents and probe them with every rolling window of a
   block's length; a hit is a block that stands somewhere else;
2. extend: each stretch around hits is rolled with full windows, and windows that occur
   twice or more are the repeats; runs of them are the maximal exact repeats;
3. drop every word that a repeated window covers.

Documents are grouped into chunks by a hash.  A chunk sends each distinct fingerprint
once, as sorted and packed numbers, to the part of the hash range it falls in, and gets
back those that hit.  A passage in a third of all documents therefore costs a number a
chunk, not one an occurrence, and no pair of documents is ever built.  Probes are short
fingerprints, for false hits only cost time: pass 2 decides by 128-bit fingerprints.

Chunks and parts both grow with the input.  Up to ``FAN`` parts a chunk writes to each of
them.  Beyond, messages go by way of a square of relays, as in a radix sort of two digits:
a relay takes one coarse range from one team of chunks and deals it to the fine parts of
that range, and answers come back the same way.  Messages then grow with the power 1.5 of
the input and not with its square, and a relay holds about as much as a chunk.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import fresh

WINDOW = 35
CHUNK_BYTES = 8 << 20
FAN = 4096
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def pack(sorted_numbers: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, each in as many bytes as the largest needs."""
    if not len(sorted_numbers):
        return b""
    steps = np.diff(sorted_numbers, prepend=_U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, _U)
    width = data[0]
    planes = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    planes[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(planes.reshape(-1).view("<u8"), dtype=_U)


class Chunk:
    """The words of some documents and the fingerprints of their windows."""

    def __init__(self, texts: list[bytes | None]):
        self.docs = [t.split() if t else [] for t in texts]  # bytes split at \\x20 and \\x09-\\x0D
        self.sizes = np.array([len(d) for d in self.docs], dtype=np.int64)
        self.words = np.fromiter((xxh3_64_intdigest(w) for d in self.docs for w in d), dtype=_U, count=int(self.sizes.sum()))
        self.ends = np.cumsum(self.sizes)

    def windows(self, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a window of ``n`` words starts, and its 64-bit fingerprint."""
        left = np.repeat(self.ends, self.sizes) - np.arange(len(self.words))
        at = np.flatnonzero(left >= n)
        if not len(at):
            return at, np.zeros(0, _U)
        b = int(_BASES[base])
        powers = np.cumprod(np.concatenate([[_U(1)], np.full(len(self.words) - 1, _BASES[base])]), dtype=_U)
        inverse = np.cumprod(np.concatenate([[_U(1)], np.full(len(self.words) - 1, _U(pow(b, -1, 1 << 64)))]), dtype=_U)
        total = np.concatenate([[_U(0)], np.cumsum((self.words ^ _U(base)) * powers, dtype=_U)])
        h = (total[at + n] - total[at]) * inverse[at]  # as if the window stood first
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return at, h ^ (h >> _U(29))

    def grid(self, at: np.ndarray, block: int) -> np.ndarray:
        """Whether each position is one of its document's grid."""
        first = np.repeat(self.ends - self.sizes, self.sizes)
        return (at - first[at]) % block == 0


def _split(numbers: np.ndarray, bits: int, parts: int, first: int = 0, last: int | None = None):
    """Runs of sorted ``bits``-bit numbers by part of the range, from part ``first`` to before ``last``: (part, slice)."""
    last = parts if last is None else last
    bounds = np.searchsorted(numbers, [_U((p << bits) // parts) for p in range(first + 1, last)])
    for p, (a, b) in enumerate(zip([0, *bounds], [*bounds, len(numbers)], strict=True), first):
        if b > a:
            yield p, slice(int(a), int(b))


#: Added to the number of a chunk's own blocks where the chunk has several such windows.
_SEVERAL = 4
#: Bytes of a chunk's place in its team, before each record that goes by way of relays.
_PLACE = 2
#: To or from a part: sorted numbers, packed, and in ``more`` a record of fixed width for each.
_MESSAGE = "part int, chunk int, numbers binary, more binary"


def _messages(rows: list[tuple]) -> pa.Table:
    kinds = {"part": pa.int32(), "chunk": pa.int32(), "numbers": pa.binary(), "more": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.table({n: pa.array(list(c), kind) for (n, kind), c in zip(kinds.items(), columns, strict=True)})


def _read(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, records of ``width`` bytes and senders' rows of some messages."""
    blobs = [unpack(x) for x in _texts(table, "numbers")]
    numbers = np.concatenate([np.zeros(0, _U), *blobs])
    records = np.frombuffer(b"".join(_texts(table, "more")), np.uint8).reshape(len(numbers), width)
    return numbers, records, np.repeat(np.arange(len(blobs)), [len(x) for x in blobs])


def _bytes(numbers: np.ndarray, kind: str) -> np.ndarray:
    """Each number as a row of bytes."""
    return np.ascontiguousarray(numbers, kind).view(np.uint8).reshape(len(numbers), np.dtype(kind).itemsize)


def _number(records: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(records[:, : np.dtype(kind).itemsize]).view(kind).ravel()


class Exchange:
    """The way of numbers from chunks to the parts of a range and of the answers back."""

    def __init__(self, chunks: int, parts: int, fan: int):
        self.relays = parts > fan
        self.coarse = math.isqrt(parts - 1) + 1 if self.relays else parts
        self.fine = -(-parts // self.coarse)
        self.parts = self.coarse * self.fine
        self.teams = math.isqrt(chunks - 1) + 1

    def send(self, chunk: int, numbers: np.ndarray, records: np.ndarray, bits: int) -> pa.Table:
        """What a chunk sends: sorted numbers and their records, by part or coarse range."""
        return _messages([(p, chunk, pack(numbers[s]), records[s].tobytes()) for p, s in _split(numbers, bits, self.coarse)])

    def ask(self, sent: DataFrame, bits: int, width: int, answers: int, judge) -> DataFrame:
        """The answers to ``sent``, by chunk.

        ``judge(numbers, records)`` sees all that falls in a part, with records of ``width``
        bytes, and says which numbers go back, and with what records of ``answers`` bytes.
        """
        lead = _PLACE if self.relays else 0
        coarse, fine, parts, teams = self.coarse, self.fine, self.parts, self.teams

        def gather(key, table):
            part, team = (k.as_py() for k in key)
            numbers, records, row = _read(table, width)
            place = (np.array(table.column("chunk").to_pylist(), np.int64) // teams)[row]
            order = np.argsort(numbers, kind="stable")
            numbers, records = numbers[order], np.hstack([_bytes(place, "<u2"), records])[order]
            found = _split(numbers, bits, parts, part * fine, (part + 1) * fine)
            return _messages([(p, team, pack(numbers[s]), records[s].tobytes()) for p, s in found])

        def count(key, table):
            numbers, records, row = _read(table, lead + width)
            back, answer = judge(numbers, records[:, lead:])
            numbers, row, answer = numbers[back], row[back], np.hstack([records[back, :lead], answer[back]])
            cuts = np.searchsorted(row, np.arange(table.num_rows + 1))
            senders = table.column("chunk").to_pylist()
            return _messages([(key[0].as_py() // fine, senders[i], pack(numbers[a:b]), answer[a:b].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])

        def deliver(key, table):
            part, team = (k.as_py() for k in key)
            numbers, records, _ = _read(table, _PLACE + answers)
            place = _number(records, "<u2")
            order = np.lexsort((numbers, place))
            numbers, records, place = numbers[order], records[order, _PLACE:], place[order]
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1), len(place)]
            return _messages([(part, int(place[a]) * teams + team, pack(numbers[a:b]), records[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])])

        if not self.relays:
            return sent.groupBy("part").applyInArrow(count, _MESSAGE)
        relayed = sent.groupBy("part", F.pmod("chunk", F.lit(teams)).alias("team")).applyInArrow(gather, _MESSAGE)
        return relayed.groupBy("part").applyInArrow(count, _MESSAGE).groupBy("part", "chunk").applyInArrow(deliver, _MESSAGE)


def _texts(table: pa.Table, name: str) -> list[bytes | None]:
    return table.column(name).to_pylist()


def _among(numbers: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each number is in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(numbers), bool)
    return known[np.minimum(np.searchsorted(known, numbers), len(known) - 1)] == numbers


def find_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> tuple[DataFrame, list[str]]:
    """``docs`` with four columns added, and their names: n_words, n_removed, kept (the words
    that stay, joined by single spaces, as UTF-8) and kept_sha256.

    Words are runs of characters other than blank and \\x09-\\x0D.  Null and empty texts have
    no words, and texts shorter than a window lose none.  Repeated rows are repeats of each
    other; ties need no order, for every occurrence of a repeated window is dropped, the first
    one included.  Clashing names get underscores; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    block = (window + 1) // 2
    raw, chunk = fresh("raw_text", docs.columns), fresh("chunk", docs.columns)
    text = docs[text_col].cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    spread = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, math.ceil(size / chunk_bytes), min(spread, math.ceil(size / (1 << 20))))
    exchange = Exchange(chunks, chunks, fan)
    bits = min(63, max(1, size).bit_length() + 8)  # a block is some hundred bytes: a false hit in 30,000 windows or so
    key = F.xxhash64(*[docs[c] for c, kind in docs.dtypes if not kind.startswith("map")])
    grouped = docs.withColumn(raw, text.cast("binary")).withColumn(chunk, F.pmod(key, F.lit(chunks)).cast("int")).drop(text_col)
    # a task takes about as many chunks as the session's parallelism asks for, but eight at most
    grouped = grouped.repartition(min(chunks, max(spread // 2, math.ceil(chunks / 8), 2)), chunk)
    number = lambda key: key[0].as_py()

    def probe(key, table):
        part = Chunk(_texts(table, raw))
        at, h = part.windows(block, 0)
        h >>= _U(64 - bits)
        numbers, of, often = np.unique(h, return_inverse=True, return_counts=True)
        own = np.minimum(np.bincount(of, part.grid(at, block), len(numbers)), 2).astype(np.uint8) + _SEVERAL * (often > 1).astype(np.uint8)
        return exchange.send(number(key), numbers, own[:, None], bits)

    def standing_elsewhere(numbers, records):
        """Probes that may be a block elsewhere; the answer: whether there are two blocks of them."""
        own = records[:, 0]
        _, of = np.unique(numbers, return_inverse=True)
        blocks = np.bincount(of, own % _SEVERAL)[of]
        two = blocks >= 2
        return two | ((blocks == 1) & (own != 1)), two[:, None].view(np.uint8)  # 1: a block of the chunk's own and no other window

    def extend(key, table, back):
        part = Chunk(_texts(table, raw))
        at, h = part.windows(block, 0)
        h >>= _U(64 - bits)
        known, two, _ = _read(back, 1)
        hit = _among(h, np.sort(known))
        hit &= _among(h, np.sort(known[two[:, 0] > 0])) | ~part.grid(at, block)
        near = np.zeros(len(part.words) + 1, np.int64)
        np.add.at(near, np.maximum(at[hit] - (window - block), 0), 1)
        np.add.at(near, at[hit] + 1, -1)
        start, first = part.windows(window, 0)
        second = part.windows(window, 1)[1]
        near = np.cumsum(near)[start] > 0
        first, second = first[near], second[near]
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        heads = np.flatnonzero(new)
        twice = np.diff(np.append(heads, len(first))) > 1
        first, second = first[heads], second[heads]
        return exchange.send(number(key), first, np.hstack([_bytes(second, "<u8"), twice[:, None].view(np.uint8)]), 64)

    def repeated_windows(numbers, records):
        """Windows that occur twice or more; the answer is empty."""
        second, twice = _number(records, "<u8"), records[:, 8]
        order = np.lexsort((second, numbers))
        a, b = numbers[order], second[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        of = np.cumsum(new) - 1
        repeated = np.zeros(len(a), bool)
        repeated[order] = np.bincount(of, 1 + twice[order])[of] >= 2
        return repeated, np.zeros((len(a), 0), np.uint8)

    names = [fresh(c, docs.columns) for c in ("n_words", "n_removed", "kept", "kept_sha256")]

    def drop(key, table, back):
        part = Chunk(_texts(table, raw))
        start, first = part.windows(window, 0)
        repeated = start[_among(first, np.sort(_read(back, 0)[0]))]
        cover = np.zeros(len(part.words) + 1, np.int64)
        np.add.at(cover, repeated, 1)
        np.add.at(cover, repeated + window, -1)
        keep = np.cumsum(cover)[:-1] == 0
        kept, removed, a = [], [], 0
        for words in part.docs:
            mine = keep[a : a + len(words)]
            a += len(words)
            removed.append(len(words) - int(mine.sum()))
            kept.append(b" ".join(compress(words, mine.tolist())))
        out = table.drop_columns([chunk])
        out = out.append_column(names[0], pa.array(part.sizes)).append_column(names[1], pa.array(removed, pa.int64()))
        return out.append_column(names[2], pa.array(kept, pa.binary())).append_column(names[3], pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()))

    hits = exchange.ask(grouped.groupBy(chunk).applyInArrow(probe, _MESSAGE), bits, 1, 1, standing_elsewhere)
    repeats = exchange.ask(grouped.groupBy(chunk).cogroup(hits.groupBy("chunk")).applyInArrow(extend, _MESSAGE), 64, 9, 0, repeated_windows)
    carried = [f for f in grouped.schema.fields if f.name != chunk]
    schema = T.StructType([*carried, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BinaryType()), T.StructField(names[3], T.StringType())])
    out = grouped.groupBy(chunk).cogroup(repeats.groupBy("chunk")).applyInArrow(drop, schema)
    text = F.col(raw).cast("string").alias(text_col)
    return out.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns], *names), names


def remove_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows taken out of the text; texts without any stay as they are.

    Null texts stay null and empty ones empty; of repeated rows of a window or more each
    loses its text; a text of repeats only becomes empty, and its row stays.
    """
    out, (_, removed, kept, _) = find_repeats(docs, window, text_col)
    text = F.when(F.col(removed) > 0, F.col(kept).cast("string")).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
