"""Token counts and token ids through a table of distinct pre-tokens.

A text is cut only where the tokenizer is sure to cut as well, so the pieces can be
encoded apart from each other.  Each distinct piece is encoded once per Python worker
by the tokenizer library itself; documents are then joined with that table.  Counting
never builds the ids of a document: it sums ``frequency x pieces`` over the document's
distinct pre-tokens.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from .common import bound_batches, slices, worker_cache

#: Distinct pre-tokens a worker keeps before it starts its table anew.
TABLE_LIMIT = 1_000_000
_SLICE = 1 << 21  # characters whose words are learned together
_GROUP = 256
_BATCHED = 64
#: A blank at the edge of a text or beside other white space: no certain cut there.
_LOOSE = re.compile(r"^\s|\s$|\s\s")
_WESTERN = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
_WESTERN_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def load_tokenizer(path: str):
    """A ``tokenizers`` file, without truncation or padding; special strings as by default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if array("I").itemsize == 4 and sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class _PieceTable:
    """A bounded table of what the tokenizer makes of each distinct piece."""

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        self.tokenizer, self.limit, self.known = load_tokenizer(path), limit, {}
        special = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special and not (x.lstrip or x.rstrip or x.single_word)}
        self.mark, self.mark_id = next(iter(special.items()), (None, None))

    @classmethod
    def of(cls, path: str) -> _PieceTable:
        """The table of this worker."""
        return worker_cache((cls.__name__, path), lambda: cls(path))

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece.  Many go to the library as one text, with a special token as
        the mark between them: it always splits a text, and what is between marks stands alone."""
        if self.mark is None or any(self.mark in p for p in pieces):
            return [np.array(x.ids, dtype="<u4") for x in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        groups = [pieces[i : i + _GROUP] for i in range(0, len(pieces), _GROUP)]
        out: list[np.ndarray] = []
        for i in range(0, len(groups), _BATCHED):
            part = groups[i : i + _BATCHED]
            for group, x in zip(part, self.tokenizer.encode_batch_fast([self.mark.join(g) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(x.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == self.mark_id).tolist()
                if len(cuts) != len(group) - 1:
                    raise ValueError("the tokenizer did not split at its special token")
                out += [ids[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]
        return out

    def make(self, pieces: list[str]) -> list:
        raise NotImplementedError

    def learn(self, words: set[str]) -> None:
        """Add what is missing; where that would be too much, the table starts anew."""
        missing = words.difference(self.known)
        if len(self.known) + len(missing) > self.limit:
            self.known.clear()
            missing = words
        plain = [w for w in missing if "<" not in w]
        odd = [w for w in missing if "<" in w]  # may hold special strings
        for part in (plain, odd):
            for i in range(0, len(part), _GROUP * _BATCHED):
                few = part[i : i + _GROUP * _BATCHED]
                self.known.update(zip(few, self.make(few), strict=True))


class PieceCounter(_PieceTable):
    """Counts tokens of a byte-level BPE whose pre-tokens may start with one blank.

    The cut is made before a single blank between two visible characters: every
    pre-token ends there, and what follows does not depend on what went before.
    """

    def make(self, pieces: list[str]) -> list[int]:
        return [len(x) for x in self.encode_pieces([" " + w for w in pieces])]

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; none for null and empty texts."""
        out: list[int] = []
        for a, b in slices(texts, _SLICE):
            firsts, frequencies = [], []
            for text in texts[a:b]:
                first, *rest = ("",) if not text else _CUT.split(text) if _LOOSE.search(text) else text.split(" ")
                firsts.append(first)
                frequencies.append(Counter(rest))
            self.learn(set().union(*frequencies))
            known, heads = self.known, [len(x.ids) for x in self.tokenizer.encode_batch(firsts, add_special_tokens=False)]
            out += [n + sum([known[w] * k for w, k in f.items()]) for n, f in zip(heads, frequencies, strict=True)]
        return out


class _Ids(dict):
    """Ids by piece, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: bytes) -> bytes:
        self[piece] = ids = self.make(piece)
        return ids


class PieceEncoder:
    """Ids, as little-endian unsigned 32-bit bytes, of a BPE that drops white space.

    No pre-token of such a tokenizer crosses white space, so the ids of a text are the
    ids of its words put together.  Texts are UTF-8 and split at ASCII white space only;
    any other white space stays within a piece and is left to the library.  A piece of
    Western European letters is one pre-token and goes to the library's BPE model directly,
    in small letters; a full stop or comma after a letter or digit is a pre-token of its own.
    Both shortcuts are tried out at the start and left alone where they don't hold.
    """

    def __init__(self, path: str, limit: int = TABLE_LIMIT):
        self.tokenizer, self.limit = load_tokenizer(path), limit
        self.model, self.known = self.tokenizer.model, _Ids(self._make)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c.lower())[0][0] for c in _WESTERN}
        self.ends = {e: self._whole(e) for e in (b".", b",")}
        self.plain = all(self._whole(w + e) == self._letters(w) + self.ends[e] for w in ("Abstract".encode(), "ÉTÉçÿß".encode()) for e in self.ends)

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        """The encoder of this worker."""
        return worker_cache((cls.__name__, path), lambda: cls(path))

    def _whole(self, piece: bytes) -> bytes:
        return _bytes(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids)

    def _letters(self, piece: bytes) -> bytes:
        return _bytes([t.id for t in self.model.tokenize(piece.decode().translate(self.letters))])

    def _make(self, piece: bytes) -> bytes:
        if not self.plain:
            return self._whole(piece)
        if piece[-1:] in self.ends and (piece[-2:-1].isalnum() or _WESTERN_WORD.fullmatch(piece[:-1])):
            return self.known[piece[:-1]] + self.ends[piece[-1:]]
        return self._letters(piece) if _WESTERN_WORD.fullmatch(piece) else self._whole(piece)

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        ids = self.known.__getitem__
        for text in texts:
            if len(self.known) > self.limit:
                self.known.clear()
            yield b"".join(map(ids, text.split())) if text else b""

    def masked(self, text: bytes | None, spans: list[dict] | None) -> tuple[bytes, np.ndarray]:
        """The ids of a text, and whether each of them and an end id after them starts within a span of characters."""
        whole = (text or b"").decode()
        x = self.tokenizer.encode(whole, add_special_tokens=False)
        at = np.array([*(a for a, _ in x.offsets), max(0, len(whole) - 1)], dtype=np.int64)
        loss = np.zeros(len(at), dtype=np.int64)
        for s in spans or []:
            loss[(at >= s["start"]) & (at < s["end"])] = 1
        return _bytes(x.ids), loss


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row of ``docs``.

    ``tokenizer_path`` is a byte-level BPE file of the tokenizers library that every
    executor can open.  Null and empty texts have no bytes and no tokens; repeated rows
    are counted each; other columns are ignored; an empty table gives an empty result.
    No shuffle: the table of distinct pre-tokens lives in the Python worker and is
    bounded by ``TABLE_LIMIT``.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.of(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = np.array(counter.count(texts), dtype="int64")
            size = np.array([len(t.encode()) if t else 0 for t in texts], dtype="int64")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
