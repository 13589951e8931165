import base64
import hashlib
import json

from evidentia.llm import warc
from evidentia.llm.entry import op5_warc
from evidentia.llm.shared import scratch_path

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, record_type string"


def brute(rows):
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(last.get(html or "", page), page)
    out = {}
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = last[html or ""] != page
        out[page] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[html or ""] if revisit else None)
    return out


def collect(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_pages(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert collect(op5_warc(spark, SF)) == brute(rows)


def test_odd_rows_round_trip(spark, tmp_path):
    nasty = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a/\r\nX: y", "é" * 70_000), (2, None, None), (3, "u", ""), (4, "u", nasty), (5, "u", nasty), (6, "", "x"), (7, "u", "é" * 70_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    frame.write.parquet(str(tmp_path / "pages.parquet"))
    assert collect(op5_warc(spark, str(tmp_path))) == brute(rows)
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert op5_warc(spark, str(tmp_path / "none")).count() == 0


def test_filters_reach_the_reader_and_payloads_survive(spark):
    warc.register(spark)
    path = scratch_path(spark, "warc")
    pages = spark.createDataFrame([(i, f"http://h/{i % 3}", f"<p>{i // 2}", "") for i in range(40)], PAGES)
    warc.deduplicated(pages).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    found = read.where("target_uri = 'http://h/1' and record_type = 'response'")
    assert {(r.record_id, bytes(r.payload)) for r in found.collect()} == {(f"urn:page:{i}", b"<p>%d" % (i // 2)) for i in range(1, 40, 2) if i % 3 == 1}
    # Files that no manifest names, as a lost attempt leaves them, do not count.
    files, root = warc._open_fs(path)
    with files.open_output_stream(f"{root}/part-lost.warc.gz") as out:
        out.write(b"rubbish")
    assert spark.read.format("warc").load(path).count() == 40
    assert len(json.loads(files.open_input_stream(f"{root}/{warc.MANIFEST}").read())) >= 1


def test_members_tell_their_length_and_others_are_inflated(spark, monkeypatch):
    """Rolled files, headers without payloads, and an archive of another writer, whose members tell no length."""
    import gzip
    import io

    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    rows = [{"record_id": f"urn:page:{i}", "record_type": "response", "target_uri": "u", "payload": bytes([i]) * 5000 + b"\r\n\r\nWARC/1.1"} for i in range(30)]
    ours = b"".join(warc.gzip_member(warc.record_bytes(r)) for r in rows)
    theirs = b"".join(gzip.compress(warc.record_bytes(r)) for r in rows)
    assert gzip.decompress(ours) == gzip.decompress(theirs)
    for data in (ours, theirs, ours + theirs):
        found = list(warc.file_records(io.BufferedReader(io.BytesIO(data)), {}, True))
        assert [r["payload"] for r in found] == [r["payload"] for r in rows] * (len(found) // 30)
        heads = list(warc.file_records(io.BufferedReader(io.BytesIO(data)), {"record_id": {"urn:page:7"}}, False))
        assert {(r["record_id"], r["payload_bytes"], r["payload"]) for r in heads} == {("urn:page:7", 5012, None)}
    writer = warc.WarcWriter(scratch_path(spark, "rolled").removeprefix("file://"))
    from pyspark.sql import Row

    assert len(writer.write(Row(**r) for r in rows).files) > 1 or len(ours) < 3000
