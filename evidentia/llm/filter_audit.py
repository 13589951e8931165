"""Filter interaction audit: what five filters remove, alone, together and in every order.

Filters A to D look at a document only; E fails if its text is that of a smaller
``doc_id``. Copies are found by partition refinement: texts are classed by their
length in code points, and a class is split by hashes of successive blocks, each
``GROWTH`` times as long as the one before, so the rounds grow with the
logarithm of the longest text. After each round classes of one id are dropped.
What survives is compared in full: each text with that of its class's smallest
id; where texts differ after all (hashes collided), these form a class of their
own and the comparison goes on, so no hash decides.

One Arrow pass makes a row per document: part, a mask of the failed filters A
to D, length and block hashes. Only such rows are grouped and joined; texts move
for documents that have a copy. A copy's failure of E moves its count to
another mask, so nothing is joined back to all documents. Counts per part and
mask, at most 32 a part, give all 600 rows of that part: filters do not depend
on each other's removals, so what an order does follows from the masks.

Defined results: a null text is the empty one; a null ``source`` is the part
''; rows with a null ``doc_id`` are counted and have no labels, but are neither
copies nor originals; rows that repeat an id with its text are each counted and
are not copies of each other; an id is labelled if one of its label rows says
so; an empty table gives no rows; other columns are not read. Long texts are
split into words piece by piece, between words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import FILTER_BITS, bits_of, materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bytes of the first block, and how much longer each next one is.
BLOCK, GROWTH = 4096, 16
#: Bytes after which a long text is cut at the next white space.
PIECE = 1 << 20
_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|"
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
FEATURES = "doc_id long, part string, mask int, keys array<long>"


def block_keys(raw: bytes, length: int, bits: int = 64) -> list[int]:
    """The length, then for each block a hash of all that went before and the block."""
    keys, at, size = [length], 0, BLOCK
    while at < len(raw):
        h = xxhash.xxh3_64_intdigest(raw[at : at + size], seed=keys[-1] & (2**64 - 1)) >> (64 - bits)
        keys.append(h - (1 << 64) if h >> 63 else h)
        at, size = at + size, size * GROWTH
    return keys


def word_counts(raw: bytes) -> tuple[int, int]:
    """Words and distinct words."""
    if len(raw) <= PIECE:
        words = raw.split()  # splits at just the six characters of the rule
        return len(words), len(set(words))
    n, seen, begin = 0, set(), 0
    while begin < len(raw):
        m = _BREAK.search(raw, begin + PIECE)
        end = m.start() if m else len(raw)
        words = raw[begin:end].split()
        n, begin = n + len(words), end
        seen.update(words)
    return n, len(seen)


def failures(raw: bytes, length: int) -> int:
    """Bits of the failed filters A to D."""
    words, distinct = word_counts(raw)
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (words < 50) | (100 * distinct < 65 * words) << 1 | (100 * capitals > 5 * length) << 2 | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3


def _rows(docs: DataFrame, part: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))


def features(docs: DataFrame, part: str = "source", bits: int = 64) -> DataFrame:
    """doc_id, part, mask of A to D and class keys of each row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = batch.column(2), pc.utf8_length(batch.column(2)).to_pylist()
            masks, keys = [], []
            for text, n in zip(texts, lengths, strict=True):
                raw = text.as_buffer().to_pybytes()
                masks.append(failures(raw, n))
                keys.append(block_keys(raw, n, bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "part", "mask", "keys"])

    return _rows(docs, part).mapInArrow(apply, FEATURES)


def _several(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, key, ...) whose key several ids have.

    The keys are written before the join, so that their size is known and Spark
    can split a key that very many rows have.
    """
    keys = rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    return rows.join(materialize(keys, "several"), "key", "left_semi")


def survivors(rows: DataFrame) -> DataFrame:
    """(doc_id, key) of the rows of ``features`` that share all block hashes with another id's."""
    active, settled, turn = rows.where("doc_id is not null").select("doc_id", "keys"), None, 0
    while True:
        keyed = active.select("doc_id", F.element_at("keys", turn + 1).alias("key"), "keys")
        active = materialize(_several(keyed).select("doc_id", "keys"), f"refined-{turn}")
        ended = active.where(F.size("keys") == turn + 1).select("doc_id", F.element_at("keys", -1).alias("key"))
        settled = ended if settled is None else settled.unionByName(ended)
        active = active.where(F.size("keys") > turn + 1)
        if active.isEmpty():
            return settled
        turn += 1


def _texts(docs: DataFrame, part: str, keys: DataFrame, bits: int) -> DataFrame:
    """doc_id, part, mask, key and text of documents whose key may be among ``keys``; others are passed over where they lie."""
    held = docs.sparkSession.sparkContext.broadcast(bits_of(keys.select(F.pmod("key", F.lit(FILTER_BITS)).alias("bit"))))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(held.value, dtype=np.uint8)
        for batch in batches:
            texts, lengths = batch.column(2), pc.utf8_length(batch.column(2)).to_pylist()
            at, found, masks = [], [], []
            for i, n in enumerate(lengths):
                raw = texts[i].as_buffer().to_pybytes()
                key = block_keys(raw, n, bits)[-1]
                bit = key % FILTER_BITS
                if flags[bit >> 3] >> (bit & 7) & 1:
                    at.append(i)
                    found.append(key)
                    masks.append(failures(raw, n))
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(masks, pa.int32()), pa.array(found, pa.int64()), own.column(2)], names=["doc_id", "part", "mask", "key", "text"])

    return _rows(docs, part).where("doc_id is not null").mapInArrow(apply, "doc_id long, part string, mask int, key long, text string")


def copies(docs: DataFrame, rows: DataFrame, part: str = "source", bits: int = 64) -> DataFrame:
    """(doc_id, part, mask) of each row whose text a smaller id has; ``rows`` are the features of ``docs``."""
    first = materialize(survivors(rows).groupBy("key").agg(F.min("doc_id").alias("first")), "first")
    named = materialize(_texts(docs, part, first, bits).join(first.select("key"), "key", "left_semi"), "texts")
    # Classes by key and turn: texts that differ from their class's first are classed anew.
    out = None
    while True:
        heads = named.join(first, "key").where("doc_id = first").groupBy("key", "first").agg(F.min("text").alias("head"))
        heads = materialize(heads, "heads")
        met = materialize(named.join(heads, "key").select(*named.columns, "first", (F.col("text") == F.col("head")).alias("same")), "compared")
        found = met.where("same and doc_id > first").select("doc_id", "part", "mask")
        out = found if out is None else out.unionByName(found)
        named = met.where("not same").select("doc_id", "part", "mask", "key", "text")
        first = materialize(named.groupBy("key").agg(F.min("doc_id").alias("first")), "first")
        if first.isEmpty():
            return out


def _marks(labels: DataFrame) -> DataFrame:
    def any_one(c: str) -> Column:
        return F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)

    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(any_one("quality"), any_one("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source", bits: int = 64) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents fail just the filters of ``mask``, and how many of them are labelled so."""
    rows = materialize(features(docs, part, bits), "features")
    found = materialize(copies(docs, rows, part, bits), "copies")
    moved = found.select("doc_id", "part", F.explode(F.array(F.struct("mask", F.lit(-1).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.lit(1).alias("n")))).alias("m"))
    counted = rows.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionByName(moved.select("doc_id", "part", "m.*"))
    marked = counted.join(materialize(_marks(labels), "marks"), "doc_id", "left")
    n = F.col("n").cast("long")

    def total(label: str) -> Column:
        return F.sum(n * F.coalesce(label, F.lit(0))).alias("good" if label == "quality" else label)

    return marked.groupBy("part", "mask").agg(F.sum(n).alias("n"), total("quality"), total("toxic"))


def _sum(where: Callable[[Column], Column], of: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.filter("masks", lambda x: where(x["mask"])), F.lit(0).cast("long"), lambda total, x: total + of(x))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", bits: int = 64) -> DataFrame:
    """Per part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    counts = mask_counts(docs, labels, part, bits)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    steps = parts.withColumn("filter_order", F.explode(F.lit(ORDERS))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own, before = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    steps = steps.withColumn("bit", F.pow(F.lit(2), F.instr(F.lit(FILTERS), own) - 1).cast("int"))
    steps = steps.withColumn("done", sum((F.when(F.contains(before, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0)))
    bit, done = F.col("bit"), F.col("done")

    def has(mask: Column, bits: Column) -> Column:
        return mask.bitwiseAND(bits) != 0

    def here(mask: Column) -> Column:
        return has(mask, bit) & ~has(mask, done)

    return steps.select(
        "part", "filter_order", "step",
        _sum(lambda m: ~has(m, bit) & ~has(m, done), lambda x: x["n"]).alias("kept"),
        _sum(here, lambda x: x["n"]).alias("removed"),
        _sum(lambda m: has(m, bit) & has(m, done), lambda x: x["n"]).alias("redundant"),
        _sum(lambda m: m == bit, lambda x: x["n"]).alias("unique_fails"),
        _sum(here, lambda x: x["good"]).alias("good_lost"),
        _sum(here, lambda x: x["toxic"]).alias("toxic_lost"),
        # Of the orders, a filter comes first among the k that a document fails in one of k.
        _sum(lambda m: has(m, bit), lambda x: x["n"] * F.floor(F.lit(len(ORDERS)) / F.bit_count(x["mask"]))).alias("shapley"),
    )
