"""Toxicity by a classifier chain of linear models.

Categories are predicted in turn: junk, toxic, toxic junk. Each category's
logistic model sees the text's features and the probabilities of the earlier
categories. In training these come out of fold: models fitted on the other
folds predict each row, on features chosen without its fold, so later models
learn from probabilities as good as those they will see. Equal texts are in one
fold.

Features are rates per word of hashed words and word beginnings (4, 6 and 7
bytes), which also tell compounds in languages that build them. The model is
fitted on at most ``LABELLED_ROWS`` labelled documents, those with the smallest
hashes of their ids, and on the ``FEATURES`` hashes that tell the categories
apart best. Spark counts the hashes; a table of the hash space and the chosen
features of the sample reach the driver. The model is a few kilobytes and goes
to every task; scoring is one pass over whole texts without a shuffle.

Defined results: a null text is empty; a text without words has no rates and
gets the model's base probabilities; without labelled rows all probabilities
are 0 and nothing is rejected; labels that are null are left out; repeated rows
each get their row; an empty table gives no rows; extra columns are passed on
by ``reject``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, materialize
from .shingles import NOT_LETTERS, Words, runs

CATEGORIES = ("junk", "toxic", "toxic_junk")
#: Labelled documents, at most, that the model is fitted on.
LABELLED_ROWS = 4000
FEATURES, FOLDS, RIDGE = 512, 3, 0.02
#: Probability from which a document is rejected.
THRESHOLD = 0.5
_SPACE_BITS = 18
_BEGINNINGS = (None, 4, 6, 7)


def _lower(text: str | None) -> str:
    return (text or "").lower()


def hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and feature hash of every occurrence, and each text's word count."""
    words = Words(raw, NOT_LETTERS)
    many = np.diff(words.ptr)
    owner = np.repeat(np.arange(len(raw)), many)
    found = []
    for salt, begin in enumerate(_BEGINNINGS):
        h = words.hashes(begin) * np.uint64(2 * salt + 3)
        found.append((h >> np.uint64(64 - _SPACE_BITS)).astype(np.int64))
    return np.tile(owner, len(found)), np.concatenate(found), many


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights, the last for the constant, by damped Newton steps on the ridge-penalised loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge * len(x) / 100)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-4)[:, None]).T @ x
        curve[np.diag_indices_from(curve)] += penalty + 1e-6
        move = np.linalg.solve(curve, gradient)
        w -= move * min(1.0, 5 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-4:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


@dataclass(frozen=True)
class Chain:
    """``column`` maps a feature hash to its column or -1; ``weights`` has a model per category."""

    column: np.ndarray
    width: int
    weights: tuple[np.ndarray, ...]

    def features(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
        for begin, end, raw in runs([_lower(t) for t in texts]):
            owner, h, many = hashed(raw)
            at = self.column[h]
            cell = owner[at >= 0] * self.width + at[at >= 0]
            counts = np.bincount(cell, minlength=len(raw) * self.width).reshape(len(raw), self.width)
            yield begin, end, 100 * counts / np.maximum(many, 1)[:, None]

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.zeros((len(texts), len(CATEGORIES)))
        out = np.empty((len(texts), len(self.weights)))
        for begin, end, x in self.features(texts):
            x = np.minimum(x, 5.0)
            for k, w in enumerate(self.weights):
                out[begin:end, k] = predict(np.hstack([x, out[begin:end, :k]]), w)
        return out


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, chosen: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """A model per column of ``y``; earlier probabilities come out of fold.

    ``chosen`` has the columns of ``x`` to use without each fold, and last those to use with all rows.
    """
    earlier = np.zeros((len(x), 0))
    weights = []
    for k in range(y.shape[1]):
        weights.append(logistic(np.hstack([x[:, chosen[-1]], earlier]), y[:, k]))
        if k + 1 < y.shape[1]:
            out = np.empty(len(x))
            for f, columns in enumerate(chosen[:-1]):
                seen = np.hstack([x[:, columns], earlier])
                own = fold == f
                out[own] = predict(seen[own], logistic(seen[~own], y[~own, k])) if own.any() and not own.all() else y[:, k].mean()
            earlier = np.hstack([earlier, out[:, None]])
    return tuple(weights)


def _sparse(sample: DataFrame) -> DataFrame:
    """Each labelled text's distinct hashes and rates; (text, doc_id, quality, toxic, fold) come in."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, raw in runs([_lower(t) for t in batch.column(0).to_pylist()]):
                owner, h, many = hashed(raw)
                cell, count = np.unique(owner * (1 << _SPACE_BITS) + h, return_counts=True)
                ptr = np.searchsorted(cell, np.arange(len(raw) + 1) << _SPACE_BITS)
                index = pa.array((cell & ((1 << _SPACE_BITS) - 1)).astype(np.int32))
                rate = pa.array((100 * count / np.maximum(many, 1)[cell >> _SPACE_BITS]).astype(np.float32))
                offsets = pa.array(ptr.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i)[begin:end] for i in range(1, 5)), pa.ListArray.from_arrays(offsets, index), pa.ListArray.from_arrays(offsets, rate)],
                    names=["doc_id", "quality", "toxic", "fold", "h", "rate"],
                )

    return sample.mapInArrow(apply, "doc_id long, quality int, toxic int, fold int, h array<int>, rate array<float>")


def choose(counts: np.ndarray, rows: np.ndarray, many: int = FEATURES) -> np.ndarray:
    """The hashes whose documents differ most from all in a category.

    ``counts`` has for each hash the documents that hold it: all, junk, toxic; ``rows`` the same of the sample.
    """
    present = counts[:, 0].astype(float)
    score = np.zeros(len(counts))
    for k in (1, 2):
        share = rows[k] / max(rows[0], 1)
        spread = np.sqrt(np.maximum(present * share * (1 - share), 1e-9))
        score = np.maximum(score, np.where(present >= 5, np.abs(counts[:, k] - present * share) / (spread + 1), 0))
    best = np.argsort(-score, kind="stable")[:many]
    return best[score[best] > 0]


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Chain:
    """The chain, from documents (doc_id, text) and labels (doc_id, quality, toxic)."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The sample has `rows` rows of three numbers at most, so it may be sent to every task.
    # Where a doc_id repeats, its least text counts, so no more than `rows` rows are fitted.
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    sparse = materialize(_sparse(sample.select("text", "doc_id", "quality", "toxic", fold)), "labelled")

    kinds = [F.lit(True), F.col("quality") == 0, F.col("toxic") == 1]
    sums = [F.count_if((F.col("fold") == f) & kind).alias(f"n{f}{k}") for f in range(FOLDS) for k, kind in enumerate(kinds)]
    sizes = np.array(sparse.agg(*sums).first(), dtype=float).reshape(FOLDS, 3)
    column = np.full(1 << _SPACE_BITS, -1, dtype=np.int32)
    if not sizes[:, 0].sum():
        return Chain(column, 0, ())
    found = sparse.select("fold", "quality", "toxic", F.explode("h").alias("h")).groupBy("h").agg(*sums).toArrow()
    counts = np.zeros((FOLDS, len(column), 3), dtype=np.float32)
    for f in range(FOLDS):
        for k in range(3):
            counts[f, found["h"].to_numpy(), k] = found[f"n{f}{k}"].to_numpy()
    whole = counts.sum(axis=0)
    picks = [*(choose(whole - counts[f], sizes.sum(axis=0) - sizes[f]) for f in range(FOLDS)), choose(whole, sizes.sum(axis=0))]
    used = np.unique(np.concatenate(picks))
    place = np.full(len(column), -1, dtype=np.int32)
    place[used] = np.arange(len(used))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, len(used)), dtype=np.float32)
            at = place[batch.column(4).flatten().to_numpy()]
            owner = np.repeat(np.arange(batch.num_rows), batch.column(4).value_lengths().to_numpy(zero_copy_only=False))
            x[owner[at >= 0], at[at >= 0]] = np.minimum(batch.column(5).flatten().to_numpy(), 5.0)[at >= 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "toxic", "fold", "x"])

    sample = sparse.mapInArrow(narrow, "doc_id long, quality int, toxic int, fold int, x binary").toArrow()
    sample = sample.sort_by([(c, "ascending") for c in ("doc_id", "toxic", "quality")])
    x = np.frombuffer(b"".join(v.as_py() for v in sample["x"]), dtype=np.float32).reshape(sample.num_rows, len(used))
    junk, toxic = (sample[c].to_numpy() == v for c, v in (("quality", 0), ("toxic", 1)))
    y = np.stack([junk, toxic, junk & toxic], axis=1).astype(float)
    column[picks[-1]] = np.arange(len(picks[-1]))
    return Chain(column, len(picks[-1]), fit_chain(x, y, sample["fold"].to_numpy(), [place[p] for p in picks]))


def _per_batch(chain: Chain, act: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], at: int) -> Callable:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield act(batch, chain.probabilities(batch.column(at).to_pylist()))

    return apply


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and each category's probability."""

    def act(batch: pa.RecordBatch, p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=["doc_id", *CATEGORIES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_per_batch(chain, act, 1), "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES))


def reject(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns."""

    def act(batch: pa.RecordBatch, p: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array(p[:, CATEGORIES.index("toxic")] < threshold))

    return mapped(docs, _per_batch(chain, act, docs.columns.index("text")), docs.schema)
