"""Benchmark items in documents, found by latent semantic retrieval and checked word by word.

1. Document frequencies of hashed words, over all documents, give the weights.
2. Benchmark items are cut into passages; the rows of their TF-IDF matrix are
   made and multiplied where Spark keeps the benchmark, and a randomised SVD
   reduces them to ``RANK`` dimensions, half of the passages' number at most.
3. Each document is read in windows of words, counted from its own start. A
   window is projected into the latent space, unless its benchmark words weigh
   less than ``HELD`` of the lightest passage. It is a candidate for an item if
   it has the cosine ``COSINE`` with one of its passages (less for passages
   shorter than a window) and holds ``HELD`` of that passage's length.
4. The longest common subsequence of words of the item and the text around the
   window decides, with a check for the item's answer (its last words) if the
   match is loose. Windows are judged one by one, so a verdict depends on
   nothing but the text and the benchmark.

The space is fitted to all items at once. What goes to every task is the basis
(``BUCKETS`` by ``RANK`` floats at most) and a block of items with ``PASSAGES``
passages or fewer; a larger benchmark needs another pass over the documents.
Words are lower-cased and without digits and punctuation. An item without words
or id matches nothing.

Defined results: null and empty texts match nothing; repeated rows give
repeated results; repeated items each match; empty tables give no rows; extra
columns are passed on by ``clean``. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped
from .shingles import NOT_LETTERS, Words, runs

#: Hash buckets of words for document frequencies and TF-IDF.
BUCKETS = 1 << 16
PASSAGE, PASSAGE_STEP, WINDOW_STEP = 24, 12, 6
RANK, OVERSAMPLE, POWER = 128, 16, 2
COSINE, HELD = 0.35, 0.3
#: Share of an item's words, in order, that counts as a copy; and, with its answer, as a paraphrase.
COPY, PARAPHRASE = 0.75, 0.6
ANSWER, ANSWER_SHARE = 5, 0.8
#: Passages that one pass over the documents looks for, about 32 MB.
PASSAGES = 1 << 16
LEAKS = "doc_id long, item_id long, coverage double, answer boolean"


def _hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = Words(raw, NOT_LETTERS)
    return words.hashes(), words.ptr


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(48)).astype(np.int64)


def _lower(texts: list[str | None]) -> list[str]:
    return [(t or "").lower() for t in texts]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per bucket, and all documents. Tasks add up what they read; ``BUCKETS`` sums reach the driver."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for _, _, raw in runs(_lower(batch.column(0).to_pylist())):
                h, ptr = _hashes(raw)
                owner = np.repeat(np.arange(len(raw)), np.diff(ptr))
                seen = np.sort(owner * BUCKETS + _bucket(h))
                total += np.bincount(seen[np.diff(seen, prepend=-1) > 0] % BUCKETS, minlength=BUCKETS)
                rows += len(raw)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), pa.array([*total[at], rows], pa.int64())], names=["bucket", "n"])

    counts = docs.select("text").mapInArrow(apply, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df, rows = np.zeros(BUCKETS), 0
    for b, n in zip(counts["bucket"].to_pylist(), counts["n"].to_pylist(), strict=True):
        if b < 0:
            rows = n
        else:
            df[b] = n
    return df, rows


def passages_of(n: int) -> list[tuple[int, int]]:
    """Windows over the words of an item; one if it is short."""
    starts = sorted({*range(0, max(1, n - PASSAGE + 1), PASSAGE_STEP), max(0, n - PASSAGE)})
    return [(s, min(n, s + PASSAGE)) for s in starts] if n else []


def _passage_rows(texts: list[str | None], idf: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(item number, words, buckets, weights) of each passage; a word's every occurrence counts."""
    h, ptr = _hashes([t.encode("utf-8", "surrogatepass") for t in _lower(texts)])
    for i, (first, last) in enumerate(zip(ptr[:-1], ptr[1:], strict=True)):
        for a, b in passages_of(int(last - first)):
            at, count = np.unique(_bucket(h[first + a : first + b]), return_counts=True)
            yield i, b - a, at, idf[at] * count


def _summed(parts: DataFrame) -> np.ndarray | None:
    """The sum of float arrays given as bytes: added by eights, then in one task, so one row reaches the driver."""

    def added(group: pa.Table) -> pa.Table:
        total = None
        for x in group["y"]:
            part = np.frombuffer(x.as_buffer(), dtype=np.float32)
            total = part.copy() if total is None else total + part
        return pa.table({"y": pa.array([total.tobytes()], pa.binary())})

    for many in (8, 1):
        parts = parts.withColumn("group", F.spark_partition_id() % many).groupBy("group").applyInArrow(lambda t: added(t.select(["y"])), "y binary")
    rows = parts.collect()
    return np.frombuffer(rows[0].y, dtype=np.float32) if rows else None


def randomised_svd(rows: DataFrame, known: np.ndarray, width: int, rank: int, seed: int = 13) -> np.ndarray:
    """Right singular vectors (width x rank, at most) of the sparse rows (at, value); ``known`` maps ``at`` to columns.

    Each task multiplies its rows with the current basis and back; the driver
    orthogonalises the sum, a matrix of ``width`` by ``rank + OVERSAMPLE``.
    """
    many = min(width, rank + OVERSAMPLE)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, many)).astype(np.float32))[0]
    context = rows.sparkSession.sparkContext

    def gram(q: np.ndarray) -> np.ndarray:
        held = context.broadcast(q)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, y = held.value, None
            for batch in batches:
                for at, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    y = np.zeros((width, many), dtype=np.float32) if y is None else y
                    at, a = known[at], np.array(value, dtype=np.float32)
                    y[at] += np.outer(a, a @ q[at])
            if y is not None:
                yield pa.RecordBatch.from_arrays([pa.array([y.tobytes()], pa.binary())], names=["y"])

        total = _summed(rows.select("at", "value").mapInArrow(partial, "y binary"))
        held.destroy()
        return np.zeros((width, many), dtype=np.float32) if total is None else total.reshape(width, many)

    for _ in range(POWER):
        basis = np.linalg.qr(gram(basis))[0]
    product = basis.T @ gram(basis)
    values, vectors = np.linalg.eigh((product + product.T) / 2)
    best = np.argsort(-values)[:rank]
    return (basis @ vectors[:, best[values[best] > 1e-6]]).astype(np.float32)


@dataclass(frozen=True)
class Space:
    """The latent space of all passages. ``weighted`` has a row for each known bucket, times its weight; the last one is zero."""

    idf: np.ndarray
    known: np.ndarray
    weighted: np.ndarray
    lightest: float


def fit_space(benchmark: DataFrame, df: np.ndarray, documents: int) -> Space | None:
    idf = (np.log((documents + 1) / (df + 1)) + 0.05).astype(np.float32)
    held = benchmark.sparkSession.sparkContext.broadcast(idf)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_passage_rows(batch.column(0).to_pylist(), held.value))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([at.tolist() for _, _, at, _ in rows], pa.list_(pa.int32())),
                    pa.array([(w / np.linalg.norm(w)).tolist() for *_, w in rows], pa.list_(pa.float32())),
                    pa.array([float(w.sum()) for *_, w in rows], pa.float32()),
                ],
                names=["at", "value", "weight"],
            )

    rows = benchmark.where("item_id is not null").select("text").mapInArrow(apply, "at array<int>, value array<float>, weight float")
    passages, lightest = rows.agg(F.count("*"), F.min("weight")).first()
    if not passages:
        return None
    buckets = np.array(sorted(r.b for r in rows.select(F.explode("at").alias("b")).distinct().collect()))
    known = np.full(BUCKETS, len(buckets), dtype=np.int32)
    known[buckets] = np.arange(len(buckets))
    space = randomised_svd(rows, known, len(buckets), max(1, min(RANK, passages // 2)))
    space = np.vstack([space, np.zeros((1, space.shape[1]), dtype=np.float32)])
    return Space(idf, known, space * np.append(idf[buckets], np.float32(0))[:, None], float(lightest))


@dataclass(frozen=True)
class Index:
    """A block of items: their word hashes, and the unit vectors and lengths of their passages in the latent space."""

    space: Space
    ids: list[int]
    words: list[np.ndarray]
    passages: np.ndarray
    item_of: np.ndarray
    length: np.ndarray
    cosine: np.ndarray


def build_index(space: Space, ids: list[int], texts: list[str | None]) -> Index | None:
    h, ptr = _hashes([t.encode("utf-8", "surrogatepass") for t in _lower(texts)])
    words = [h[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    rows = list(_passage_rows(texts, np.ones(BUCKETS, dtype=np.float32)))
    if not rows:
        return None
    z = np.stack([count @ space.weighted[space.known[at]] for _, _, at, count in rows])
    length = np.linalg.norm(z, axis=1)
    z /= length[:, None] + np.float32(1e-9)
    cosine = COSINE * np.sqrt(np.minimum(1.0, np.array([n for _, n, _, _ in rows]) / PASSAGE))
    return Index(space, ids, words, z.astype(np.float32), np.array([i for i, *_ in rows]), (HELD * length).astype(np.float32), cosine.astype(np.float32))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit per word of ``a`` at a time."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def judge(item: np.ndarray, span: np.ndarray) -> tuple[float, bool, bool]:
    """Coverage, whether the answer is there, and whether this is a leak."""
    coverage = common_subsequence(item, span) / len(item)
    tail = item[-ANSWER:]
    answer = common_subsequence(tail, span) >= ANSWER_SHARE * len(tail)
    return coverage, answer, coverage >= COPY or (answer and coverage >= PARAPHRASE)


def _projected(space: Space, row: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Each window's vector in the latent space.

    Windows overlap, so words are summed once per step of ``WINDOW_STEP`` words
    and a window is the sum of its steps.
    """
    place = begins[:, None] + np.arange(0, PASSAGE, WINDOW_STEP)
    there = place < stops[:, None]
    steps, number = np.unique(place, return_inverse=True)
    number = number.reshape(place.shape)
    stop = np.zeros(len(steps), dtype=np.int64)
    stop[number[there]] = np.broadcast_to(stops[:, None], place.shape)[there]
    sums = np.zeros((len(steps) + 1, space.weighted.shape[1]), dtype=np.float32)
    for j in range(WINDOW_STEP):
        at = steps + j
        sums[:-1] += space.weighted[np.where(at < stop, row[np.minimum(at, len(row) - 1)], len(space.weighted) - 1)]
    number = np.where(there, number, len(steps))
    z = sums[number[:, 0]]
    for j in range(1, number.shape[1]):
        z += sums[number[:, j]]
    return z


def _candidates(index: Index, h: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int]]:
    """Window numbers and item numbers that are close. ``stops`` are the ends of the texts."""
    space, bucket = index.space, _bucket(h)
    row = space.known[bucket]
    weight = np.where(row < len(space.weighted) - 1, space.idf[bucket], np.float32(0)).astype(np.float64)
    inside = np.concatenate(([0.0], np.cumsum(weight)))
    near = np.flatnonzero(inside[np.minimum(begins + PASSAGE, stops)] - inside[begins] >= HELD * space.lightest - 1e-6)
    for at in range(0, len(near), 512):
        own = near[at : at + 512]
        z = _projected(space, row, begins[own], stops[own])
        size = np.linalg.norm(z, axis=1)
        dots = z @ index.passages.T
        close = np.flatnonzero(((dots >= index.length) & (dots >= size[:, None] * index.cosine)).ravel())
        yield from zip(own[close // len(index.passages)].tolist(), index.item_of[close % len(index.passages)].tolist(), strict=True)


def windows(lengths: np.ndarray) -> np.ndarray:
    """How many windows texts of so many words have: one each ``WINDOW_STEP`` words until one reaches the end."""
    return np.where(lengths > 0, np.maximum(1, -(-(lengths - PASSAGE) // WINDOW_STEP) + 1), 0)


def around(words: np.ndarray, at: int, item: np.ndarray) -> np.ndarray:
    """The part of a text's words that is judged for a window at ``at``: an item's length before and after it."""
    return words[max(0, at - len(item)) : at + PASSAGE + len(item)]


def leaks_in(index: Index, texts: list[str | None]) -> Iterator[tuple[int, int, float, bool]]:
    """(text number, item number, coverage, answer) of each item found in each text."""
    for first, _, raw in runs(_lower(texts)):
        h, ptr = _hashes(raw)
        if not len(h):
            continue
        many = windows(np.diff(ptr))
        owner = np.repeat(np.arange(len(raw)), many)
        begin = ptr[owner] + WINDOW_STEP * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
        best: dict[tuple[int, int], tuple[float, bool]] = {}
        for w, item in sorted(set(_candidates(index, h, begin, ptr[owner + 1]))):
            i, words = int(owner[w]), index.words[item]
            if best.get((i, item), (0.0,))[0] == 1.0:
                continue
            span = around(h[ptr[i] : ptr[i + 1]], int(begin[w] - ptr[i]), words)
            there = set(span.tolist())
            if sum(x in there for x in words.tolist()) < PARAPHRASE * len(words):
                continue  # no subsequence can be long enough
            coverage, answer, leak = judge(words, span)
            if leak:
                best[i, item] = max(best.get((i, item), (0.0, False)), (coverage, answer))
        for (i, item), (coverage, answer) in sorted(best.items()):
            yield first + i, item, coverage, answer


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks of ``PASSAGES`` passages: a stated query set, read in its order of ids and texts."""
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        many = len(passages_of(len(_hashes([t.encode("utf-8", "surrogatepass") for t in _lower([row.text])])[0])))
        if ids and held + many > PASSAGES:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        held += many
    if ids:
        yield ids, texts


def _indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[Index]:
    space = fit_space(benchmark, *document_frequencies(docs))
    if space:
        yield from filter(None, (build_index(space, ids, texts) for ids, texts in _blocks(benchmark)))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, coverage, answer): each benchmark item found in a document of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in _indexes(docs, benchmark):
        found = rows.mapInArrow(_scan(docs, index), LEAKS)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], LEAKS) if out is None else out


def _scan(docs: DataFrame, index: Index):
    held = docs.sparkSession.sparkContext.broadcast(index)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            found = list(leaks_in(index, batch.column(1).to_pylist()))
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array([index.ids[f[1]] for f in found], pa.int64()), pa.array([round(f[2], 6) for f in found], pa.float64()), pa.array([f[3] for f in found], pa.bool_())],
                names=["doc_id", "item_id", "coverage", "answer"],
            )

    return apply


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a benchmark item, with all their columns, block after block."""
    for index in _indexes(docs, benchmark):
        docs = mapped(docs, _keep(docs, index), docs.schema)
    return docs


def _keep(docs: DataFrame, index: Index):
    held, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = {f[0] for f in leaks_in(held.value, batch.column(at).to_pylist())}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

    return apply
