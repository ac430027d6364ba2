"""Rows of pages that repeat come back each."""

from ledgerloom.llm import oracles, queries

from ..test_oracles import same


def test_equal_rows_are_captures_of_their_own(spark, tmp_path):
    long = "<p>" + "x" * 200
    rows = [(1, "http://a/", long)] * 3 + [(2, "http://b/", long)] * 2 + [(3, "http://c/", "short")] * 2 + [(4, "http://d/", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    frame.write.parquet(str(tmp_path / "raw"))
    next((tmp_path / "raw").glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    got = queries.op4_warc(spark, str(tmp_path))
    assert got.count() == len(rows)
    same(got, oracles.ORACLES["op4_warc"], str(tmp_path))
