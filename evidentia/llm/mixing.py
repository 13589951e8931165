"""Mixing sources to target weights by pivotal rounding of fractional copies.

Every document of a source gets the same number of copies, in fractions: the
source's target over its size. Whole copies are taken as they are. The
fractions are settled in pairs: words move at random from one document to the
other until one of the two takes a whole copy or none, so that the words a
source takes in all stay put and each document's expectation stays its
fraction. What is left of a group of documents joins the other groups' rests
in the next level of a reduction tree, until one document of each source is
left; that one is rounded at random.

Documents of at most the source's median size (by words) settle last, after
their fractions have shared out what rounding the last larger document left
over. So a source misses its target by about a part of a small document.

Randomness comes from hashes of ids and the seed, so reruns agree. Groups are
dealt by a hash within the source and hold about ``GROUP`` documents, however
large the source is; rows that repeat an id and size are counted and dealt in
chunks of ``GROUP`` at most, so no id makes a large group. Only ids and sizes
are shuffled.

Defined results: a null or empty text has size 0 and takes 0; a null source is
a source of its own, last in order; repeated rows are documents of their own;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents, about, in a group that one call settles.
GROUP = 4096
#: Fractions this close to 0 or 1 are whole.
EPS = 1e-9
ROWS = "doc_id long, source string, size long, chunk long, part string, slot long, p double, done boolean"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and the control characters 9 to 13."""
    packed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(packed, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, size): one row per source.

    Targets are proportional to the weights unless that exceeds ``most`` times
    the source; full sources are those with the least room per weight, so a
    running sum over the sources in that order finds the common level. The
    windows run over one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = total.withColumn("weight", weight).withColumn("room", F.col("source_size") * most)
    order = W.orderBy((F.col("room") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("want", F.sum("source_size").over(everything) * share)
        .withColumn("full", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("want") - F.col("full")) / F.col("open"))
        .withColumn("is_full", F.col("level") * F.col("weight") >= F.col("room"))
        # The level of the first source that isn't full holds for it and all later ones.
        .withColumn("common", F.min_by("level", F.struct("is_full", F.col("room") / F.col("weight"))).over(everything))
    )
    target = F.when(F.col("is_full"), F.col("room")).otherwise(F.least("room", F.col("common") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def _settle(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Pair fractions in turn until at most one is left; returns them and its index, or -1."""
    p, left = p.copy(), -1
    for j in range(len(p)):
        if not EPS < p[j] < 1 - EPS:
            p[j] = round(p[j])
            continue
        if left < 0:
            left = j
            continue
        i, a, b = left, float(size[left]), float(size[j])
        gain = min((1 - p[i]) * a, p[j] * b)  # words that may move from j to i
        loss = min(p[i] * a, (1 - p[j]) * b)
        words = gain if draw[j] * (gain + loss) < loss else -loss
        p[i] += words / a
        p[j] -= words / b
        whole = [x for x in (i, j) if not EPS < p[x] < 1 - EPS]
        for x in whole:
            p[x] = round(p[x])
        left = -1 if len(whole) == 2 else (j if whole == [i] else i)
    return p, left


def _draws(ids: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64) + np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def _level(rows: DataFrame, level: int, seed: int) -> DataFrame:
    def apply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "doc_id"], ascending=False, kind="stable")
        ids, size = group["doc_id"].fillna(-1).to_numpy(np.int64), group["size"].to_numpy()
        p, left = _settle(size, group["p"].to_numpy(), _draws(ids, size, seed * 1009 + level))
        done = np.arange(len(p)) != left
        return group.assign(p=p, done=done)

    salted = rows.withColumn("slot", F.col("slot").cast("long"))
    return salted.groupBy("source", "part", "slot").applyInPandas(apply, ROWS)


def _dealt(sizes: DataFrame) -> DataFrame:
    """``sizes`` (doc_id, source, size) with a ``chunk`` that at most ``GROUP`` equal rows share."""
    counted = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GROUP)))
    counted = materialize(counted.withColumn("chunk", chunks), "dealt")
    # Chunks of an often repeated row are spread before they become rows again.
    several = counted.where("n > 1").repartition("doc_id", "chunk").withColumn("m", F.least(F.lit(GROUP), F.col("n") - F.col("chunk") * GROUP))
    several = several.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    columns = ["doc_id", "source", "size", "chunk"]
    return counted.where("n = 1").select(columns).unionByName(several.select(columns))


def _slot(fan: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "size", "chunk", F.lit(seed)), F.lit(fan))


def _tree(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """Settle all but one document of each (source, part), level by level."""
    settled, level = [], 0
    while True:
        fan = max(1, -(-most // GROUP))
        out = materialize(_level(rows.withColumn("slot", _slot(fan, seed + level)), level, seed), "mix")
        if fan == 1:
            return _union([*settled, out])
        settled.append(out.where("done"))
        rows, most, level = out.where(~F.col("done")), fan, level + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of ``docs`` (doc_id, text, source)."""
    sizes = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "sizes")
    goal = materialize(targets(sizes, weights, share, most), "targets")
    dealt = _dealt(sizes)
    per_source = dealt.join(goal, dealt["source"].eqNullSafe(goal["source"])).select(dealt["*"], "source_size", "target")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = per_source.withColumn("base", F.floor(copies + EPS)).withColumn("p", F.greatest(copies - F.floor(copies + EPS), F.lit(0.0)))

    # Half of a source's words are in documents up to about this size (a power of two).
    power = F.ceil(F.log2(F.greatest("size", F.lit(1))))
    bins = sizes.groupBy("source", power.alias("power")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    by_size = W.partitionBy("source").orderBy("power")
    bins = bins.withColumn("upto", F.sum("words").over(by_size)).withColumn("all", F.sum("words").over(W.partitionBy("source")))
    half = bins.groupBy("source").agg(F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("power"))).alias("half"), F.sum("rows").alias("rows")).withColumnRenamed("source", "of")
    half = materialize(half, "half")
    largest = half.agg(F.max("rows")).first()[0] or 0

    split = each.join(half, F.col("source").eqNullSafe(F.col("of")))
    split = split.withColumn("part", F.when(power > F.col("half"), "large").otherwise("small")).withColumn("done", F.lit(False))
    columns = ["doc_id", "source", "size", "chunk", "part", "p", "done"]
    trivial = (F.col("size") == 0) | (F.col("p") <= EPS)
    open_rows = split.where(~trivial)
    large = _tree(open_rows.where("part = 'large'").select(columns), largest, seed)
    rest = large.where(~F.col("done")).withColumn("up", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < F.col("p"))
    rest = rest.withColumn("whole", F.col("up").cast("double"))

    # Rounding the last large document changes the small ones' fractions a little.
    small = open_rows.where("part = 'small'").select(columns)
    debt = rest.select(F.col("source").alias("of"), ((F.col("p") - F.col("whole")) * F.col("size")).alias("debt"))
    room = small.groupBy("source").agg(F.sum("size").alias("words")).withColumnRenamed("source", "owner")
    shift = materialize(room.join(debt, F.col("owner").eqNullSafe(F.col("of"))).select("owner", (F.col("debt") / F.col("words")).alias("shift")), "shift")
    moved = small.join(shift, F.col("source").eqNullSafe(F.col("owner")), "left")
    small = moved.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p") + F.coalesce("shift", F.lit(0.0))))).select(columns)
    small = _tree(small, largest, seed + 1)
    last = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30) < F.col("p")
    whole = _union([
        large.where("done").select("doc_id", "source", "size", "p"),
        rest.select("doc_id", "source", "size", F.col("whole").alias("p")),
        small.select("doc_id", "source", "size", F.when(F.col("done"), F.col("p")).otherwise(last.cast("double")).alias("p")),
        split.where(trivial).select("doc_id", "source", "size", F.lit(0.0).alias("p")),
    ])
    ends = goal.select(F.col("source").alias("of"), "source_size", "target")
    whole = whole.join(ends, F.col("source").eqNullSafe(F.col("of")))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + EPS)).otherwise(0)
    copies = (base + F.round("p")).cast("long")
    return whole.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
