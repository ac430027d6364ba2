"""Counts, ids and packing against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import packing, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
BITS = ["the", "The", "don't", "it's.", "A.", "x,", "..", "é", "É.", "  ", "\n", " ", " ", "\t", " ", " ", " ", "<|endoftext|>", "<|startoftext|>", "<", "7", "12,", "ß", "İ", "Σ", "中文", "😀", "\x1c", "\x85", "\r\n", "'S", "naïve.", "é", "|", "$5.00", "fooBar.", "\x00"]
byte_bpe, word_bpe = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def texts(n=3000):
    rng = random.Random(4)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_counts_equal_the_library():
    assert tokens.PieceCounter(BYTES).count(texts()) == [len(byte_bpe.encode(t, add_special_tokens=False).ids) for t in texts()]
    assert tokens.PieceCounter(BYTES, limit=50).count(texts(300)) == [len(byte_bpe.encode(t, add_special_tokens=False).ids) for t in texts(300)]


def test_ids_equal_the_library():
    for encoder in (tokens.PieceEncoder(WORDS), tokens.PieceEncoder(WORDS, limit=50)):
        assert encoder.plain
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts()])]
        assert got == [word_bpe.encode(t, add_special_tokens=False).ids for t in texts()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_any_text(some):
    some = [t for t in some if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    assert tokens.PieceCounter.of(BYTES).count(some) == [len(byte_bpe.encode(t, add_special_tokens=False).ids) for t in some]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.PieceEncoder.of(WORDS).encode([t.encode() for t in some])]
    assert got == [word_bpe.encode(t, add_special_tokens=False).ids for t in some]


ROWS = [(1, "some words here. " * 3000), (2, None), (3, ""), (4, "one"), (4, "one"), (None, "null id"), (6, "<|endoftext|> x")]


def frame(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, n_tokens int, id string")


def test_count_edges(spark):
    got = tokens.count_tokens(frame(spark), BYTES)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((str(i), len((t or "").encode()), len(byte_bpe.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert {r["doc_id"] for r in got.where("over_limit").collect()} == {1}
    assert tokens.count_tokens(frame(spark).limit(0), BYTES).count() == 0


def check_pieces(pieces, want, capacity=4096, segments=packing.MAX_SEGMENTS):
    """Each id in one piece, sequences gapless and within limits, no padding but at powers of two."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for doc, ids in want.items():
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity and len(seq) <= segments and (at == capacity or at & (at - 1) == 0)


def test_packing_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(["a b c " * n for n in (1, 3, 900, 5000, 12, 40, 7)] + [None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = [r.asDict() for r in packing.pack_documents(docs, WORDS).collect()]
    check_pieces(pieces, {i: [*word_bpe.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows})
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0
    assert packing.pack_documents(frame(spark), WORDS).select("doc_id").distinct().count() == 6


def test_loss_limit_binds(spark):
    rows = [(i, "ask this " * 20 + "tell that " * n, [(180, 180 + 10 * n)]) for i, n in enumerate([30, 5, 60, 1, 44, 12, 90, 7] * 3)] + [(90, "no span", None), (91, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:long,end:long>>").coalesce(1)
    pieces = [r.asDict() for r in packing.pack_documents(docs, WORDS, max_loss=128, capacity=1024, loss_col="spans").collect()]
    ids = {i: [*word_bpe.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    check_pieces(pieces, ids, 1024)
    borne = {i: [0] * 40 + [1] * (len(ids[i]) - 40) if s else [0] * len(ids[i]) for i, _, s in rows}
    load = {}
    for p in pieces:
        load[p["sequence_id"]] = load.get(p["sequence_id"], 0) + sum(borne[p["doc_id"]][p["start"] : p["start"] + p["length"]])
    assert 64 <= max(load.values()) <= 128
    loose = packing.pack_documents(docs, WORDS, capacity=1024, loss_col="spans")
    assert loose.select("sequence_id").distinct().count() < len(load)


def test_vector_limits():
    rng = random.Random(8)
    packer = packing.VectorPacker(0, capacity=64, max_segments=5, max_loss=40, open_limit=4)
    rows, docs = [], {}
    for i in range(400):
        ids = np.array([rng.randint(0, 99) for _ in range(rng.randint(1, 100))], "<u4")
        loss = np.array([rng.random() < 0.6 for _ in ids], dtype=np.int64)
        docs[i] = (ids, loss)
        rows += packer.add(i, ids.tobytes(), loss)
    rows += packer.flush()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    pieces = [dict(zip(names, r, strict=True)) for r in rows]
    check_pieces(pieces, {i: ids.tolist() for i, (ids, _) in docs.items()}, 64, 5)
    load = {}
    for p in pieces:
        load[p["sequence_id"]] = load.get(p["sequence_id"], 0) + int(docs[p["doc_id"]][1][p["start"] : p["start"] + p["length"]].sum())
    assert max(load.values()) <= 40
