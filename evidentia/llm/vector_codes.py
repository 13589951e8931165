"""Vector code compression: product quantization with integer codebooks.

A component x becomes the integer floor(256 x), a vector is cut into equal
consecutive parts, and each part is replaced by the index of the nearest entry
of its position's codebook. Codebooks start as the parts of the vectors with
the smallest ids; each round assigns every part to its nearest entry (squared
distance, ties to the lower index) and moves each entry to the floor of its
parts' mean. Unused entries stay.

The codebooks (entries x dimension integers, whatever the size of the table)
are sent to all tasks. Arrow batches compute all distances of a batch as
|x|^2 - 2 x.c + |c|^2 with int64 matrix products, which are exact; a task adds
up counts and sums of each entry and gives one row per entry, and Spark merges
these by a grouped shuffle. The driver sees sums only. The vectors are read once
for their dimension, once for the first codebooks, once a round and once for
the codes.

Defined results: vectors that are null or hold null or non-finite components
are left out; the dimension is that of the smallest id's kept vector among
those that can be cut, kept vectors of another length get a null code and error;
components are held within +-2**k, k the largest with 4 * dimension * 2**2k < 2**63,
so nothing overflows (for 64 dimensions 2**27, that is |x| up to 2**19), and
sums of errors stop at 2**63 - 1. Of rows that share an id the smallest vector
serves as a first entry, once; a null id never does. With fewer kept ids than
entries the codebooks are shorter; an empty table gives no rows. Repeated rows
are coded each. Extra columns are passed on by ``encode`` unless they are
called ``code`` or ``error``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import mapped, materialize

#: Rows whose distances are held at once.
ROWS = 2048
MOST = 2**63 - 1


def _bound(dim: int) -> int:
    k = 0
    while 4 * max(dim, 1) << 2 * (k + 1) < 2**63:
        k += 1
    return 1 << k


@dataclass(frozen=True)
class Codebooks:
    """``entries`` is parts x entries x places; empty where nothing could be fitted."""

    entries: np.ndarray
    scale: int = 256

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors (rows x dimension) that the codes (rows x parts) stand for."""
        parts = self.entries[np.arange(self.entries.shape[0])[None, :], codes]
        return parts.reshape(len(codes), -1) / self.scale

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance, rows x parts each, of integer vectors."""
        parts, _, width = self.entries.shape
        codes, distances = np.empty((len(x), parts), dtype=np.int64), np.empty((len(x), parts), dtype=np.int64)
        norms = (self.entries**2).sum(axis=2)[:, None, :]
        across = np.ascontiguousarray(self.entries.transpose(0, 2, 1))
        for begin in range(0, len(x), ROWS):
            own = np.ascontiguousarray(x[begin : begin + ROWS].reshape(-1, parts, width).transpose(1, 0, 2))
            d = (own**2).sum(axis=2)[:, :, None] - 2 * np.matmul(own, across) + norms
            best = d.argmin(axis=2)  # the first of equals
            codes[begin : begin + ROWS] = best.T
            distances[begin : begin + ROWS] = np.take_along_axis(d, best[:, :, None], axis=2)[:, :, 0].T
        return codes, distances


def integers(vectors: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept rows of another length, kept rows of length ``dim``, and the integers of the latter."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero((lengths == dim) & (dim > 0))
    flat = vectors.take(pa.array(fit, pa.int64())).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), dim)
    whole = np.isfinite(flat).all(axis=1)
    others = [i for i in np.flatnonzero((lengths >= 0) & ((lengths != dim) | (dim == 0))).tolist() if np.isfinite(np.array(vectors[i].as_py(), dtype=np.float64)).all()]
    # Held in doubles first: a value beyond int64 could not be converted.
    held = np.clip(np.floor(flat[whole] * scale), -_bound(dim), _bound(dim)).astype(np.int64)
    return np.array(others, dtype=np.int64), fit[whole], held


def _kept(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _doubles(vectors: DataFrame, column: str) -> Column:
    return F.col(f"`{column}`").cast("array<double>")


def _first_entries(vectors: DataFrame, id_column: str, column: str, dim: int, entries: int, scale: int) -> list[list[int]]:
    """Integer vectors of the smallest ids. Each task gives as many rows as there are entries, at most."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, list[int]] = {}
        for batch in batches:
            _, rows, x = integers(batch.column(1), dim, scale)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[rows]
            if len(least) >= entries:
                below = ids <= max(least)
                ids, x = ids[below], x[below]
            for i, v in zip(ids.tolist(), x.tolist(), strict=True):
                least[i] = min(least.get(i, v), v)
            least = {i: least[i] for i in sorted(least)[:entries]}
        if least:
            yield pa.RecordBatch.from_arrays([pa.array(least.keys(), pa.int64()), pa.array(least.values(), pa.list_(pa.int64()))], names=["id", "x"])

    named = vectors.where(F.col(f"`{id_column}`").isNotNull()).select(F.col(f"`{id_column}`").cast("long").alias("id"), _doubles(vectors, column).alias("v"))
    found = named.mapInArrow(apply, "id long, x array<long>").groupBy("id").agg(F.min("x").alias("x"))
    return [r.x for r in found.orderBy("id").limit(entries).collect()]


def _sums(vectors: DataFrame, column: str, books: Codebooks) -> DataFrame:
    """(part, entry, n, s0, s1, ...): how many parts each used entry has, and their sums."""
    parts, entries, width = books.entries.shape
    held = vectors.sparkSession.sparkContext.broadcast(books)
    names = [f"s{k}" for k in range(width)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        count, total = np.zeros(parts * entries, dtype=np.int64), np.zeros((width, parts * entries), dtype=np.int64)
        for batch in batches:
            _, _, x = integers(batch.column(0), books.dim, books.scale)
            codes, _ = books.assign(x)
            keys = (codes + np.arange(parts) * entries).ravel()
            count += np.bincount(keys, minlength=parts * entries)
            own = x.reshape(-1, width)
            for k in range(width):
                np.add.at(total[k], keys, np.ascontiguousarray(own[:, k]))
        used = np.flatnonzero(count)
        if len(used):
            columns = [used // entries, used % entries, count[used], *(t[used] for t in total)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", *names])

    rows = vectors.select(_doubles(vectors, column).alias("v")).mapInArrow(apply, ", ".join(f"{c} long" for c in ("part", "entry", "n", *names)))
    return rows.groupBy("part", "entry").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)))


def fit(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks of ``vectors`` after ``rounds`` rounds."""
    v, i = F.col(f"`{column}`"), F.col(f"`{id_column}`")
    cuttable = (F.size(v) > 0) & (F.size(v) % parts == 0)
    first = vectors.where(i.isNotNull() & cuttable & _kept(v)).agg(F.min(F.struct(i.cast("long").alias("i"), F.size(v).alias("n"))).alias("f")).first().f
    if first is None:
        return Codebooks(np.zeros((parts, 0, 0), dtype=np.int64), scale)
    rows = np.array(_first_entries(vectors, id_column, column, first.n, entries, scale), dtype=np.int64)
    books = Codebooks(np.ascontiguousarray(rows.reshape(len(rows), parts, -1).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        moved = books.entries.copy()
        for r in _sums(vectors, column, books).collect():
            moved[int(r.part), int(r.entry)] = [int(s) // int(r.n) for s in r[3:]]
        books = Codebooks(moved, scale)
    return books


def encode(vectors: DataFrame, books: Codebooks, column: str = "embedding") -> DataFrame:
    """Kept rows of ``vectors`` without ``column``, with ``code`` (two hex digits per part) and ``error``."""
    kept = [f for f in vectors.schema.fields if f.name not in (column, "code", "error")]
    schema = StructType([*(StructField(f.name, f.dataType) for f in kept), StructField("code", StringType()), StructField("error", LongType())])
    held = vectors.sparkSession.sparkContext.broadcast(books)
    width = 2 * max(1, (len(f"{max(books.entries.shape[1] - 1, 0):x}") + 1) // 2)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        hexes = np.array([f"{i:0{width}x}" for i in range(books.entries.shape[1])], dtype=object)
        for batch in batches:
            others, rows, x = integers(batch.column(len(kept)), books.dim, books.scale)
            codes, errors = [None] * len(others), [None] * len(others)
            if len(rows):
                best, distances = books.assign(x)
                codes += ["".join(r) for r in hexes[best].tolist()]
                errors += distances.sum(axis=1).tolist()
            where = np.concatenate([others, rows])
            order = np.argsort(where)
            taken = batch.take(pa.array(where[order], pa.int64()))
            arrays = [*(taken.column(i) for i in range(len(kept))), pa.array([codes[i] for i in order], pa.string()), pa.array([errors[i] for i in order], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return mapped(vectors.select(*(F.col(f"`{f.name}`") for f in kept), _doubles(vectors, column)), apply, schema)


def compress(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """``encode`` with codebooks fitted on the same rows, and ``label_error`` and ``codebooks_sha256``."""
    books = fit(vectors, id_column, column)
    coded = materialize(encode(vectors.drop("label_error", "codebooks_sha256"), books, column), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    most = F.when(total > MOST, MOST).otherwise(total).cast("long")
    # Written, so that Spark knows its size and can split a hot label's rows in the join.
    totals = materialize(coded.groupBy(F.col(f"`{label}`").alias("of")).agg(most.alias("label_error")), "label-errors")
    joined = coded.join(totals, coded[f"`{label}`"].eqNullSafe(totals["of"]), "left").drop("of")
    return joined.withColumn("codebooks_sha256", F.lit(books.digest()))
