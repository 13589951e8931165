"""Localities to search: those of known projects, then names of the register that are not near copies of one before.

The rule goes by order: a name is taken if no taken name before it is alike. As
a graph of like names that is the lexicographically first independent set, found in rounds: of the
open names those without an open like name before them are taken, and the open names like a taken
one before go. A round decides all names that depend on decided ones only, so there are as many
rounds as the longest chain of names that depend on each other, and no list passes through the driver.

Like names meet by keys instead of in pairs. If a share of ``ALIKE`` of two names' characters lies in
common blocks, the names have a common subsequence of M = ALIKE * (both lengths) / 2 characters: names of less
than ``LONG`` characters wait under all their subsequences of the lengths that count, so hardly any meet but like
ones. For longer names those are too many, and such names are few: up to ``WIDE`` characters they are held against all names of the lengths
that count, in groups of two bounded blocks, by the length of the common subsequence, which takes one machine word a name.
Of still longer ones k = (1 - ALIKE) * (both lengths) insertions and deletions at most
turn one into the other, each touches one part of the first name at most, so of its k + 1 parts one stands in the other,
at most k places off. A name that holds another has it among its substrings. Names that are taken anyway don't meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations
from difflib import SequenceMatcher
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import fixed
from ..functions.text import clean_locality, norm, title_case
from ..operators.matching import Texts
from ..session import evenly, materialize

#: Share of characters in common blocks, and the shortest new name that may hold another or be held.
ALIKE, HELD = 0.85, 6
#: Length from which names don't meet by subsequences, of which a shorter name has up to 5,000; and that above which they meet by parts.
LONG, WIDE = 20, Texts.BITS
#: Long names, and others, that meet in one group.
BLOCKS = (2048, 16384)


def _edits(a: int, b: int) -> int:
    return math.floor((1 - ALIKE) * (a + b) + 1e-9)


def _partners(n: int) -> range:
    """Lengths of names that can be alike to one of length ``n``: the blocks are no longer than the shorter name."""
    return range(max(1, math.ceil(n * ALIKE / (2 - ALIKE) - 1e-9)), math.floor(n * (2 - ALIKE) / ALIKE + 1e-9) + 1)


def _parts(n: int, many: int) -> list[tuple[int, int]]:
    """Start and length of ``many`` parts of a name of length ``n``, as even as can be."""
    cuts = [n * i // many for i in range(many + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _common(a: int, b: int) -> int:
    """Length of the common subsequence that like names of these lengths have at least."""
    return math.ceil(ALIKE / 2 * (a + b) - 1e-9)


def same_keys(name: str) -> set[str]:
    """Subsequences under which like names meet, if both are shorter than ``LONG``."""
    n = len(name)
    sizes = {_common(n, other) for other in _partners(n) if other < LONG} if n < LONG else set()
    return {"".join(c) for size in sizes if size <= n for c in combinations(name, size)}


def _long_partners(n: int, least: int) -> list[int]:
    return [other for other in _partners(n) if max(n, other) >= least]


def part_keys(name: str, least: int = LONG) -> set[str]:
    """Parts of a name for partners of which one has ``least`` characters."""
    keys = set()
    for other in _long_partners(len(name), least):
        for i, (at, size) in enumerate(_parts(len(name), _edits(len(name), other) + 1)):
            keys.add(f"{len(name)}.{other}.{i}.{name[at : at + size]}")
    return keys


def asked_part_keys(name: str, least: int = LONG) -> set[str]:
    """Parts of such partners that may stand in ``name``."""
    keys = set()
    for other in _long_partners(len(name), least):
        k = _edits(other, len(name))
        for i, (at, size) in enumerate(_parts(other, k + 1)):
            for begin in range(max(0, at - k), min(len(name) - size, at + k) + 1):
                keys.add(f"{other}.{len(name)}.{i}.{name[begin : begin + size]}")
    return keys


def _substrings(name: str) -> set[str]:
    return {name[a:b] for a in range(len(name)) for b in range(a + 1, len(name) + 1)}


def own_keys(name: str) -> set[str]:
    """Keys under which a name waits."""
    return {f"c{name}"} | {f"s{k}" for k in same_keys(name)} | part_keys(name)


def asked_keys(name: str) -> set[str]:
    """Keys that a name asks for; of two like names each asks for one of the other's, but the shorter one that is held."""
    return {f"c{k}" for k in _substrings(name)} | {f"s{k}" for k in same_keys(name)} | asked_part_keys(name)


def _keyed(names: DataFrame, keys: Callable[[str], set[str]]) -> DataFrame:
    """(seq, free, len, key, size): a row for each key of each name, with the key's length; the key is a hash."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A name has thousands of keys.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = pa.array([list(keys(t)) for t in part.column(2).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), found], names=["seq", "free", "name", "keys"])

    rows = names.select("seq", "free", "name").mapInArrow(apply, "seq long, free boolean, name string, keys array<string>")
    rows = rows.select("seq", "free", F.length("name").cast("short").alias("len"), F.explode("keys").alias("key"))
    return rows.select("seq", "free", "len", F.xxhash64("key").alias("key"), F.length("key").cast("short").alias("size"))


def met_in_blocks(rows: DataFrame, blocks: tuple[int, int] = BLOCKS) -> DataFrame:
    """(seq, before) of ``rows`` (seq, free, name) of up to ``WIDE`` characters, one of them ``LONG``: pairs whose common subsequence is as long as that of like names.

    Both sides are dealt over blocks, each two of which are one group. The work grows with the long names times the others, at some nanoseconds a pair: most lack common letters.
    """
    n = F.length("name")
    others = rows.where(n.between(min(_partners(LONG)), WIDE))
    long = others.where(n >= LONG)
    many = [max(1, math.ceil(df.count() / size)) for df, size in zip((long, others), blocks, strict=True)]
    deal = lambda df, i: df.select("*", F.pmod(F.xxhash64("seq"), F.lit(many[i])).cast("int").alias("lr"[i]), F.explode(F.sequence(F.lit(0), F.lit(many[1 - i] - 1))).alias("rl"[i]))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (deal(df, i).repartition(tasks, "l", "r") for i, df in enumerate((long, others)))
    need = np.array([[_common(x, y) if y in _partners(x) else x + y for y in range(WIDE + 1)] for x in range(WIDE + 1)], np.uint8)

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        old = Texts(theirs["name"].to_pylist())
        seqs, free = theirs["seq"].to_numpy(), theirs["free"].to_numpy(zero_copy_only=False)
        seq, before = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for s, f, name in zip(*(mine[c].to_pylist() for c in ("seq", "free", "name")), strict=True):
            least = need[len(name)][old.sizes]
            at = np.flatnonzero(least <= old.letters(name))
            # Two long names meet in one order; the later one of a pair must not be free.
            at = at[np.where(old.sizes[at] < LONG, seqs[at] != s, seqs[at] > s) & np.where(seqs[at] > s, ~free[at], not f)]
            at = at[old.common(name, at) >= least[at]]
            seq.append(np.maximum(seqs[at], s))
            before.append(np.minimum(seqs[at], s))
        return pa.table([np.concatenate(seq), np.concatenate(before)], names=["seq", "before"])

    return a.groupBy("l", "r").cogroup(b.groupBy("l", "r")).applyInArrow(meet, "seq long, before long")


@F.pandas_udf(BooleanType())
def _alike(new: pd.Series, old: pd.Series) -> pd.Series:
    def one(a: str, b: str) -> bool:
        if len(a) >= HELD and (a in b or b in a):
            return True
        m = SequenceMatcher(None, a, b)
        return m.real_quick_ratio() >= ALIKE and m.quick_ratio() >= ALIKE and m.ratio() >= ALIKE

    return pd.Series([one(a, b) for a, b in zip(new, old, strict=True)], dtype=bool)


def like_before(names: DataFrame) -> DataFrame:
    """(seq, before): for each of ``names`` (seq, name; both unique) the earlier ones that it is alike to.

    Those of the ``free`` ones are left out where ``names`` says which these are.
    """
    if "free" not in names.columns:
        names = names.withColumn("free", F.lit(False))
    # A name has thousands of keys: names are few bytes, and one task would make them all.
    rows = materialize(evenly(names.select("seq", "free", "name")), "even-names")
    side = lambda df, i: df.select(F.col("seq").alias(f"s{i}"), F.col("free").alias(f"f{i}"), F.col("len").alias(f"l{i}"), "key", F.col("size").alias(f"z{i}"))
    later = F.when(F.col("s1") < F.col("s2"), F.col("f2")).otherwise(F.col("f1"))
    pair = lambda met: met.select(F.greatest("s1", "s2").alias("seq"), F.least("s1", "s2").alias("before")).distinct()
    # A key counts only at the length that the two names' lengths ask for.
    short = _keyed(rows.where(F.length("name") < LONG), same_keys)
    met = side(short.where("not free"), 2).join(side(short, 1).hint("merge"), "key").where("s1 < s2").where(F.col("z1") == F.ceil(F.lit(ALIKE / 2) * (F.col("l1") + F.col("l2")) - 1e-9))
    pairs = pair(met)
    # The later one of a name and one that it holds must not be short.
    held = side(_keyed(rows, lambda t: {t}), 1).join(side(_keyed(rows, _substrings), 2).hint("merge"), "key").where("s1 <> s2").where(~later)
    held = held.where(F.when(F.col("s1") < F.col("s2"), F.col("l2")).otherwise(F.col("l1")) >= HELD)
    wider = rows.where(F.length("name") >= min(n for n in range(1, WIDE + 2) if _long_partners(n, WIDE + 1)))
    parts = side(_keyed(wider, partial(part_keys, least=WIDE + 1)), 1).join(side(_keyed(wider, partial(asked_part_keys, least=WIDE + 1)), 2).hint("merge"), "key").where("s1 <> s2").where(~later)
    pairs = materialize(pairs.unionByName(pair(held)).unionByName(pair(parts)).unionByName(met_in_blocks(rows)).distinct(), "met-names")
    by = lambda key, name: rows.select(F.col("seq").alias(key), F.col("name").alias(name))
    pairs = pairs.join(by("seq", "new"), "seq").join(by("before", "old"), "before")
    return pairs.where(_alike("new", "old")).select("seq", "before")


def first_independent(rows: DataFrame, edges: DataFrame, free: Column) -> DataFrame:
    """``rows`` (seq, ...) that are taken in order: all ``free`` ones, others if no taken row before is linked by ``edges`` (seq, before)."""
    nodes = rows.select("seq", free.alias("free"))
    edges = materialize(edges.join(nodes.where("not free").select("seq"), "seq", "left_semi"), "edges")
    gone = materialize(edges.join(nodes.where("free").select(F.col("seq").alias("before")), "before", "left_semi").select("seq").distinct(), "gone")
    taken = nodes.where("free").select("seq")
    left = materialize(nodes.where("not free").select("seq").join(gone, "seq", "left_anti"), "open")
    while not left.isEmpty():
        # Only edges between open rows count any more.
        edges = edges.join(left, "seq", "left_semi").join(left.withColumnRenamed("seq", "before"), "before", "left_semi")
        edges = materialize(edges, "open-edges")
        now = materialize(left.join(edges.select("seq").distinct(), "seq", "left_anti"), "taken")
        gone = edges.join(now.withColumnRenamed("seq", "before"), "before", "left_semi").select("seq").distinct()
        taken = taken.unionByName(now)
        left = materialize(left.join(now, "seq", "left_anti").join(gone, "seq", "left_anti"), "open")
    return rows.join(materialize(taken, "all-taken"), "seq", "left_semi")


def localities(known: DataFrame, register: DataFrame) -> DataFrame:
    """(seq, name, from_known) in the order of search.

    ``known`` (seq, locality: the short name of each project's place) gives every name once, but cities,
    states and names of one or two letters; ``register`` (seq, locality: as it stands in an address) those
    that are sound and not alike to one taken before. Of equal names the first counts.
    """
    first = lambda df, key: df.groupBy(key).agg(F.min_by("name", "seq").alias("name"), F.min("seq").alias("seq"))
    a = known.select("seq", F.trim("locality").alias("name")).withColumn("key", norm(F.col("name")))
    a = first(a.where((F.length("key") > 2) & ~F.col("key").isin(*fixed.WIDE_PLACES)), "key")
    b = register.select("seq", clean_locality(F.col("locality")).alias("name")).withColumn("key", norm(F.col("name")))
    b = first(b.where("key <> ''"), "key").join(a.select("key"), "key", "left_anti").withColumn("name", title_case(F.col("name")))
    # One order over both: known names come before all others.
    both = a.select(F.lit(True).alias("from_known"), "seq", "name", "key").unionByName(b.select(F.lit(False).alias("from_known"), "seq", "name", "key"))
    both = materialize(both, "unnumbered-names")
    low = both.groupBy("from_known").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).collect()
    span = {r.from_known: (r.lo, r.hi) for r in low}
    shift = span[True][1] - span[False][0] + 1 if len(span) == 2 else 0
    both = both.withColumn("seq", (F.col("seq") + F.when(F.col("from_known"), 0).otherwise(shift)).cast("long"))
    edges = like_before(both.select("seq", F.col("from_known").alias("free"), F.col("key").alias("name")))
    return first_independent(both, edges, F.col("from_known")).select("seq", "name", "from_known")
