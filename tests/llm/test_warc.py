import hashlib

from gradeframe.llm import warc as W

import __spark_entry__ as entry

PAGES = "page_id long, url string, html string"


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def test_derived_records_point_back(spark):
    html = "<html><head><title>T</title></head><body><p>One é &amp; two<p>Three</body></html>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "http://c/", "")], PAGES)
    source = {r.page_id: r for r in W.responses(pages).collect()}
    derived = W.derive(W.responses(pages)).collect()
    assert len(derived) == 6 and len({r.record_id for r in derived}) == 6
    for r in derived:
        s = source[r.page_id]
        assert r.refers_to == s.record_id and r.source_digest == s.payload_digest == sha(s.payload)
        assert r.source_headers == s.http_header and s.block_digest == sha(s.http_header + s.payload)
        assert r.block_digest == sha(r.block) and r.content_length == len(r.block.encode())
        if r.record_type == "metadata":
            assert f"payloadDigest: {s.payload_digest}\r\n" in r.block and f"responseId: {s.record_id}" in r.block
    texts = {r.page_id: r.block for r in derived if r.record_type == "conversion"}
    assert texts == {1: "One é & two\nThree", 2: "", 3: ""}


def test_files_can_be_read_again(spark, data, tmp_path):
    derived = entry.queries()["op3_warc"](spark, data)
    assert derived.count() == 2 * spark.read.parquet(f"{data}/pages.parquet").count()
    W.write_warc(derived, str(tmp_path / "out"))
    back = {r.headers["WARC-Record-ID"]: r for r in W.read_warc(spark, str(tmp_path / "out")).collect()}
    rows = derived.collect()
    assert len(back) == len(rows)
    for r in rows:
        b = back[r.record_id]
        assert b.block == r.block and b.headers["WARC-Refers-To"] == r.refers_to
        assert b.headers["WARC-Block-Digest"] == r.block_digest
        assert b.headers["WARC-Source-Payload-Digest"] == r.source_digest


def test_edge_cases(spark):
    assert W.derive(W.responses(spark.createDataFrame([], PAGES))).count() == 0
    long = "<p>" + "word " * 200_000
    pages = spark.createDataFrame([(1, "u", long), (1, "u", long), (None, "v", "<b>x")], PAGES)
    pages = pages.selectExpr("*", "1 as block", "2 as record_id", "3 as record_type")
    rows = W.derive(W.responses(pages)).collect()
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 4
    other = W.responses(pages).selectExpr("*").withColumn("record_type", W.F.lit("request"))
    assert W.derive(other).count() == 0
