import hashlib
import random
import zlib

from evidentia.llm.media_chunks import MOST, chunks_of, cuts, payload_of, round_trip, to_media

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, file_id string, key string"


def brute(text):
    raw = (text or "").encode()
    payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
    media = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())


def figures(r):
    return (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = round_trip(docs).collect()
    assert {r.doc_id: figures(r) for r in rows} == {r.doc_id: brute(r.text) for r in docs.collect()}
    assert len(rows) == docs.count()


def test_odd_rows(spark):
    long = " ".join(str(i * i) for i in range(60_000))
    rows = [(1, ""), (2, None), (3, "x" * 64), (4, "x" * 65), (5, long), (6, "new head " + long), (7, long + " tail"), (8, long),
            (None, "é"), (None, "é"), (None, None), (9, "a"), (9, "b"), (9, "a"), (10, "z" * 100_000)]
    out = round_trip(spark.createDataFrame([(*r, "f", "k") for r in rows], DOCS)).collect()
    assert sorted((str(r.doc_id), figures(r)) for r in out) == sorted((str(i), brute(t)) for i, t in rows)
    assert round_trip(spark.createDataFrame([], DOCS)).count() == 0


def test_cuts_follow_content():
    rng = random.Random(5)
    data = bytes(rng.randrange(256) for _ in range(300_000))
    assert b"".join(d for _, d in chunks_of(data)) == data
    assert all(b - a <= MOST for a, b in zip([0, *cuts(data)], cuts(data), strict=False))
    moved = bytes(rng.randrange(256) for _ in range(1234)) + data
    same = {k for k, _ in chunks_of(data)} & {k for k, _ in chunks_of(moved)}
    assert len(same) > 0.9 * len(cuts(data))
    assert len(to_media(payload_of("")[1])) == 64 + len(b"P5\n64 1\n255\n")
