"""WARC round trips, preference formatting, oracle SQL and the pipeline."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import chat, oracles, queries, warc
from tests.llm.test_duplicates import classes, hits, repeats
from tests.llm.test_tokens_packing import check_pieces, word_bpe
from tests.test_oracles import same

PAGES = "page_id long, url string, html string, digest string, first int"


def pages(spark, tmp_path, rows):
    frame = spark.createDataFrame([(i, u, h, "d", 1) for i, u, h in rows], PAGES)
    warc.write_captures(frame, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    return records, {r["capture_id"]: r for r in warc.assemble(records).collect()}


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "é\r\n\r\n" * 60
    nasty = long + "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "WARC/1.1\r\n"
    rows = [(5, "http://a.b/x?y#z", long), (3, "http://a.b/2", long), (9, "http://c.d", long), (1, None, nasty), (2, "http://e\r\nX: y", None), (4, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "http://n", long), (8, "http://big", "x" * 3_000_000), (8, "http://big", "x" * 3_000_000)]
    records, got = pages(spark, tmp_path, rows)
    assert records.count() == 3 * len(rows)
    of = {}
    for r in got.values():
        of[(r["metadata"]["fields"] or "").partition('"page-id":"')[2].partition('"')[0]] = r
    want = {str(i) if i is not None else "": h or "" for i, _, h in rows}
    assert len(got) == len(rows) - 1 and set(of) == set(want)
    for key, body in want.items():
        r = of[key]
        assert (r["response"]["payload_bytes"], r["response"]["payload_digest"]) == (len(body.encode()), hashlib.sha256(body.encode()).hexdigest())
        assert r["n_requests"] == r["n_metadata"] == (2 if key == "8" else 1)
        if r["response"]["warc_type"] == "response":
            assert bytes(r["response"]["payload"]) == body.encode()
        else:
            assert r["response"]["payload"] is None and got[r["refers_to"]]["metadata"]["fields"].find('"page-id":"3"') >= 0
    assert {k for k, r in of.items() if r["response"]["warc_type"] == "revisit"} == {"5", "9", ""}


def test_warc_cut_file_and_empty_table(spark, tmp_path):
    _, none = pages(spark, tmp_path, [])
    assert none == {}
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 21\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhi\r\n\r\n"
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.warc.gz").write_bytes(gzip.compress(whole) + gzip.compress(whole.replace(b"<a>", b"<b>")) + gzip.compress(whole[:-20]))
    assert [(r["record_id"], bytes(r["payload"])) for r in warc.read_records(spark, str(tmp_path / "c")).collect()] == [("<a>", b"hi"), ("<b>", b"hi")]


def test_warc_old_version_and_plain_files(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nsee WARC/1. and WARC/1.0\r\nhere"
    old = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "x.warc.gz").write_bytes(gzip.compress(old + old.replace(b"<a>", b"<b>").replace(b"WARC/1.0", b"WARC/1.1", 1)))
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.read_records(spark, str(tmp_path / "o")).collect()}
    assert got == {k: block.partition(b"\r\n\r\n")[2] for k in ("<a>", "<b>")}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.warc").write_bytes(old)
    with pytest.raises(ValueError, match="not a gzip archive"):
        warc.read_records(spark, str(tmp_path / "p"))


def test_preferences(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    rows = [
        (1, t(("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "end")), t(("user", "q"), ("assistant", "bad"))), (2, t(("user", "q")), t(("user", "q"))), (3, None, t(("assistant", None))), (4, t((None, "x")), t((None, "x"), ("assistant", "é"))),
    ]
    frame = spark.createDataFrame([(i, a, b, "keep") for i, a, b in rows], f"id long, chosen {chat.TURNS}, rejected {chat.TURNS}, n string")
    got = {r["id"]: r for r in chat.format_preferences(frame).collect()}
    one = got[1]
    assert one["prompt"] == "<|im_start|>user\nq<|im_end|>\n" and one["prompt_turns"] == 1 and one["n"] == "keep"
    assert [one["chosen_text"][s["start"] : s["end"]] for s in one["chosen_spans"]] == ["good<|im_end|>\n", "end<|im_end|>\n"]
    assert [one["rejected_text"][s["start"] : s["end"]] for s in one["rejected_spans"]] == ["bad<|im_end|>\n"]
    assert (got[2]["chosen_text"], got[2]["rejected_text"], got[2]["prompt_turns"]) == ("", "", 1)
    assert (got[3]["prompt"], got[3]["chosen_text"], got[3]["rejected_text"]) == ("", "", "<|im_start|>assistant\n<|im_end|>\n")
    assert got[4]["prompt_turns"] == 1 and got[4]["rejected_text"].endswith("é<|im_end|>\n")
    assert chat.format_preferences(frame.limit(0)).count() == 0


def test_siblings(spark):
    turns = [(0, 1, "assistant", "a0"), (0, 0, "user", "q0"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 1, "assistant", "a1"), (2, 0, "user", "q2"), (None, 0, "user", "lost"), (7, None, None, None)]
    got = {r["conv_id"]: r for r in chat.sibling_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {0, 1, 2, 7}
    assert [x["text"] for x in got[0]["rejected"]] == ["q0", "a1"] and [x["text"] for x in got[1]["rejected"]] == ["q1", "a1", "a0"] and [x["text"] for x in got[2]["rejected"]] == ["q2"]


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_llm_oracle(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), oracles.ORACLES[name], sf)


def test_pipeline_against_brute_force(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("raw_text", F.lit(1))
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash near-dedup", "substring dedup", "benchmark decontamination", "packing"]
    rows = lambda f: [(r["doc_id"], r["text"]) for r in f.collect()]

    def step(name, before):
        out = stages[name](spark, before, sf)
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        return spark.read.parquet(str(tmp_path / name.replace(" ", "-")))

    calm = step("toxicity", docs)
    assert calm.columns == columns
    kept = {k for k, _ in rows(calm)}
    clean = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(clean - kept) <= 0.05 * len(clean)
    single = step("minhash near-dedup", calm)
    want = classes(rows(calm))
    assert single.columns == columns and sorted(k for k, _ in rows(single)) == sorted(set(want.values()))
    fresh = step("substring dedup", single)
    truth = {k: (n, h) for k, _, n, h in repeats(rows(single), 35)}
    assert fresh.columns == columns
    for k, text in rows(fresh):
        if truth[k][0]:
            assert hashlib.sha256(text.encode()).hexdigest() == truth[k][1]
    assert all(r["n_chars"] == len(r["text"]) for r in fresh.collect())
    safe = step("benchmark decontamination", fresh)
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert safe.columns == columns and sorted(k for k, _ in rows(safe)) == sorted(k for k, t in rows(fresh) if hits(t, items)[1] == 0)
    pieces = [r.asDict() for r in step("packing", safe).collect()]
    check_pieces(pieces, {k: [*word_bpe.encode(t or "", add_special_tokens=False).ids, 2] for k, t in rows(safe)})


def test_stages_take_edges(spark, sf):
    rows = [(1, None), (2, ""), (3, "some text " * 50_000), (4, "tie"), (4, "tie"), (None, "no id")]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, sf)
        if name == "packing":
            assert {(r["doc_id"], r["doc_tokens"]) for r in out.collect()} == {(1, 1), (2, 1), (3, 100_001), (4, 2), (None, 3)}
        else:
            texts = sorted((str(r["doc_id"]), r["text"]) for r in out.collect() if r["doc_id"] != 3)
            tied = [("4", "tie")] * (1 if name == "minhash near-dedup" else 2)
            assert texts == [("1", None), ("2", ""), *tied, ("None", "no id")], name
            assert [r["text"] for r in out.collect() if r["doc_id"] == 3] == ([""] if name == "substring dedup" else [rows[2][1]]), name
        assert stage(spark, frame.limit(0), sf).count() == 0, name
