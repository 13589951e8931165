"""Media columns: payloads cut by content, stored once per chunk, rebuilt and verified.

A payload is stored as an 8-bit grey image (PGM, 64 samples wide), which keeps
its bytes as they are. The stored file is cut where a rolling gear hash has
``CUT_BITS`` zero bits, so equal stretches of different files give equal
chunks. Digests and owners meet in a Spark aggregation: the first owner of a
digest keeps the bytes with its ordered chunk list, all others only refer to
it. To rebuild a file, the chunks it refers to are joined by digest; files that
own all their chunks are rebuilt where they lie. Every rebuilt file is checked
against the digest taken before it was cut.

Equal payloads are one file: their digest is the key. Defined results: a null
text is empty and its payload is 64 zero bytes; ties and repeated rows share one
file; an empty table gives no rows; extra columns are not read; very long texts
give long chunk lists in one row, but only bytes of shared chunks move.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, may_be_among

WIDTH = 64
#: A cut about every 2**CUT_BITS bytes, within these bounds.
CUT_BITS, LEAST, MOST = 11, 512, 16384
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)
_MASK = np.uint32(((1 << CUT_BITS) - 1) << (32 - CUT_BITS))
CUT = "doc_id long, key long, n_bytes long, file_id binary, digests array<binary>"
FILES = "file_id binary, whole boolean, chunks array<struct<digest: binary, data: binary>>"
#: Files, about, that one copy of a popular chunk serves.
SPREAD = 512


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def to_media(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(media: bytes) -> bytes:
    magic, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if (magic, most) != (b"P5", b"255") or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image")
    return samples


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. The hash at a byte depends on the 32 bytes up to it."""
    h = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes; older ones shifted further
        if len(h) > step:
            h[step:] += h[:-step].copy() << np.uint32(step)
    ends, last = [], 0
    for at in np.flatnonzero((h & _MASK) == 0) + 1:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            last = int(at)
            ends.append(last)
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    return [*ends, len(data)] if last < len(data) else ends


def chunks_of(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    begin = 0
    for end in cuts(media):
        yield hashlib.sha256(media[begin:end]).digest()[:16], media[begin:end]
        begin = end


def features(payload: bytes) -> str:
    """Mean, deviation, entropy and share of zero samples, to four digits."""
    count = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    p = count / count.sum()
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, p @ (np.arange(256) - mean) ** 2)))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"mean={mean:.4f};dev={deviation:.4f};entropy={entropy:.4f};zero={p[0]:.4f}"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text; the key of a row without doc_id is a hash of its text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("key"), "text")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_bytes, file_id and the ordered chunk digests of each row of ``docs`` (doc_id, text)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files, digests = [], [], []
            for text in batch.column(2):
                n, payload = payload_of(text.as_py())
                media = to_media(payload)
                sizes.append(n)
                files.append(hashlib.sha256(media).digest())
                digests.append([digest for digest, _ in chunks_of(media)])
            arrays = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(digests, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "n_bytes", "file_id", "digests"])

    return _keyed(docs).mapInArrow(apply, CUT)


def store(docs: DataFrame) -> DataFrame:
    """Files, each with its chunk list; bytes only of the chunks it owns, ``whole`` if these are all.

    ``docs`` has (text, file_id, foreign): the digests among the file's chunks
    that another file owns. A null file_id takes the text as it is.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, whole, lists = [], [], []
            for text, file_id, foreign in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                media = to_media(payload_of(text)[1])
                found = hashlib.sha256(media).digest()
                if file_id not in (None, found):
                    continue  # another row with this key
                others, own = set(foreign or ()), []
                for digest, data in chunks_of(media):
                    own.append({"digest": digest, "data": None if digest in others else data})
                    others.add(digest)  # a chunk that a file repeats is stored once
                ids.append(found)
                whole.append(not foreign)
                lists.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(whole, pa.bool_()), pa.array(lists, pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())])))], names=["file_id", "whole", "chunks"])

    return docs.select("text", "file_id", "foreign").mapInArrow(apply, FILES)


READ = "file_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def rebuild(files: DataFrame) -> DataFrame:
    """One row of verified figures for each stored file of (file_id, chunks, others)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file_id, chunks, others in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                have = {c["digest"]: c["data"] for c in [*chunks, *(others or ())] if c["data"] is not None}
                media = b"".join(have[c["digest"]] for c in chunks)
                if hashlib.sha256(media).digest() != file_id:
                    raise ValueError("a rebuilt file differs from the one that was stored")
                payload = from_media(media)
                rows.append({"file_id": file_id, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:]), "media_bytes": len(media), "media_sha256": file_id.hex(), "feature": features(payload)})
            schema = pa.schema([("file_id", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("file_id", "chunks", "others").mapInArrow(apply, READ)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` (doc_id, text) and return what is read back: one row per document."""
    listed = materialize(manifest(docs), "chunk_lists")
    first = materialize(listed.groupBy("file_id").agg(F.min("key").alias("key")), "firsts")
    chunks = listed.select("file_id", F.explode(F.array_distinct("digests")).alias("digest")).distinct()
    held = chunks.groupBy("digest").agg(F.min("file_id").alias("holder"), F.count("*").alias("files")).where("files > 1").select("digest", "holder")
    shared = materialize(chunks.join(held, "digest"), "shared_chunks")
    foreign = shared.where("file_id <> holder").groupBy("file_id").agg(F.collect_list("digest").alias("foreign"))

    # Rows that bring a payload of their own, with no chunk of another file, are stored where
    # they are read; copies, repeated keys and files with foreign chunks are joined first.
    copies = listed.select("key", "file_id").exceptAll(first.select("key", "file_id")).select("key")
    special = copies.unionByName(first.join(foreign, "file_id", "left_semi").select("key"))
    rows = _keyed(docs).withColumn("special", may_be_among(special, F.col("key")))
    plain = rows.where(~F.col("special")).withColumn("file_id", F.lit(None).cast("binary")).withColumn("foreign", F.lit(None).cast("array<binary>"))
    joined = rows.where("special").join(first.join(foreign, "file_id", "left").hint("merge"), "key")
    once = joined.withColumn("same", F.sha2("text", 256)).dropDuplicates(["key", "file_id", "same"])  # rows lie by key already
    stored = materialize(store(plain).unionByName(store(once)), "chunk_store")

    # Bytes of shared chunks go to the files that refer to them; files that own all theirs are rebuilt where they lie.
    wanted = shared.where("file_id <> holder").select("file_id", "digest")
    many = wanted.groupBy("digest").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("copies"))
    owners = stored.where(may_be_among(shared.where("file_id = holder").select(F.col("file_id").alias("key")), F.col("file_id")))
    pieces = owners.select(F.explode("chunks").alias("c")).select("c.*").where("data is not null")
    pieces = pieces.where(may_be_among(many.select(F.col("digest").alias("key")), F.col("digest"))).join(many.hint("merge"), "digest")
    pieces = pieces.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    salted = wanted.join(many.hint("merge"), "digest").withColumn("salt", F.pmod(F.xxhash64("file_id"), F.col("copies")).cast("int")).drop("copies")
    others = salted.join(pieces, ["digest", "salt"]).groupBy("file_id").agg(F.collect_list(F.struct("digest", "data")).alias("others"))
    empty = F.lit(None).cast("array<struct<digest: binary, data: binary>>")
    rebuilt = rebuild(stored.where("whole").withColumn("others", empty)).unionByName(rebuild(stored.where("not whole").join(others, "file_id")))
    return listed.select("doc_id", "n_bytes", "file_id").join(rebuilt, "file_id").drop("file_id")
