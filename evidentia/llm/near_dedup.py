"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard.

A document's set holds its distinct k-word shingles. The signature needs two
permutations only: ``sigma`` scatters the shingle over a ring of 2**32 places,
and coordinate ``j`` is the smallest ``pi`` of the places moved on by ``j``.
Bands of four coordinates name the buckets; two sets that share a bucket are
candidates, and every link is confirmed on the full sets.

Equal sets are one class, and in each bucket every class is compared with one
hub. What is left to find are links between two members of a bucket, and these
follow from how the members differ from their hub: with D shingles of the hub
missing and A of their own added, sets x and y are similar enough just if their
differences have

    (100 + p) * shared >= cost(x) + cost(y) - (100 - p) * |hub|,   cost = 100 D + p A

members in common. Differences that the same members hold are one unit, as those
of one edit are. Members meet by their rarest units, as many of these as the
rule leaves to chance; where more than ``FEW`` of different components hold the
same one, they meet one of them and are split by the next unit that they have in
common, and so on, until few are left or all have in common what the rule asks
for. So a family of edited copies makes rows in proportion to its members, also
where all are just below the threshold; at most ``FEW`` others are met through a
row. The members of a hub of up to a given number of blocks, of about ``WHOLE``
members each, are compared in one bounded group for each two blocks instead. Members far from their hub choose another hub among themselves; those far
from ``HUBS`` hubs meet by the same rule with an empty hub, which is prefix
filtering on the rarest shingles.

Defined results: a null or empty text, or one of white space, has an empty set
and links with nothing; rows that share a ``doc_id`` count as one vertex, also
if their texts differ; a null ``doc_id`` cannot be named, so its
``component_id`` is null and it is kept; an empty table gives no rows; extra
columns are not read. Very long texts are hashed whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import SMALL_BATCH_BYTES, are_set, bit_of, bits_of, bound_batches, materialize, written
from .shingles import mix64, runs, shingle_sets

#: Coordinates in a band.
ROWS = 4
#: Chance, at most, that a pair right at the threshold shares no band.
MISS = 1e-5
#: Hubs that a bucket's members are compared with before prefix filtering takes the rest.
HUBS = 2
#: Members are near a hub up to this multiple of the cost that a link with the hub allows.
NEAR = 6
#: Members with the same units that always meet in pairs; more are split by their next one, where that makes less than one row
#: for ``PAID`` pairs, and only while all groups together would make more than ``EACH`` pairs a member.
FEW, PAID, EACH = 32, 4, 16
#: Rounds, before all others meet, in which the holders of a unit meet just one of them.
STARS = 1
#: Members of like cost, up to this factor, are told what to have in common by the least cost among them.
SPAN = 1.2
#: A block of a hub has about so many members at most, with so many differences in all.
WHOLE, TOKENS = 256, 1 << 21
#: Tokens that meet in more than one of ``OFTEN`` pairs of two blocks are counted by matrices of ``BLOCK`` tokens, the others ``MEET`` pairs at once.
OFTEN, BLOCK, MEET = 64, 1024, 1 << 22
#: Pairs, about, that meet one copy of their hub's set.
SPREAD = 512
_SIGMA, _PI = np.uint64(0x5851F42D4C957F2D), np.uint32(0x2545F491)
SIGNATURE = "doc_id long, n_shingles long, set_id binary, bands array<long>"


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows)))


def circulant_minima(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Signatures of non-empty sets: one row each, ``coordinates`` wide."""
    lengths = np.array([len(s) for s in sets])
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = (mix64(np.concatenate(sets) ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    for j in range(coordinates):
        np.add(place, np.uint32(j), out=x)  # the ring's shift; wraps at 2**32
        x ^= _PI
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            np.right_shift(x, np.uint32(shift), out=y)
            x ^= y
            if factor > 1:
                x *= np.uint32(factor)
        out[:, j] = np.minimum.reduceat(x, first)
    return out


def _digest(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signatures(docs: DataFrame, k: int, bands: int, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set) and band keys; null for empty sets."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, end, raw in runs(texts):
                sets = shingle_sets(raw, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[list[int] | None] = [None] * len(sets)
                if full:
                    minima = circulant_minima([sets[i] for i in full], bands * rows).astype(np.uint64)
                    key = np.zeros((len(full), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
                    for r in range(rows):
                        key = mix64(key * _SIGMA + minima[:, r::rows])
                    for i, row in zip(full, key.view(np.int64).tolist(), strict=True):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [ids[begin:end], pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_id", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, SIGNATURE)


def _sets(docs: DataFrame, k: int, names: DataFrame) -> DataFrame:
    """(id, grams): the digest and the sorted 64-bit shingles, as bytes, of each text whose doc_id is among ``names`` (name), and of a few others.

    The names are looked up where sets are made: as a filter before it that takes a
    second Python worker for each task, all workers are kept and used in turn.
    """
    held = docs.sparkSession.sparkContext.broadcast(bits_of(names.select(bit_of(F.col("name")).alias("bit"))))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = are_set(held.value, batch.column(0).to_numpy())
            for _, _, raw in runs(batch.column(1).filter(pa.array(wanted)).to_pylist()):
                sets = shingle_sets(raw, k)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "grams"])

    return docs.select(bit_of(F.col("doc_id").cast("long")).alias("bit"), "text").mapInArrow(apply, "id binary, grams binary")


def _shingles(sets: DataFrame) -> DataFrame:
    """(id, delta): each set's shingles as an array."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.int64()))], names=["id", "delta"])

    return sets.select("id", "grams").mapInArrow(apply, "id binary, delta array<long>")


def _near(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


COMPARED = "id binary, rep long, hub binary, hub_rep long, cost long, room long, linked boolean, delta array<long>"


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each pair (id, rep, hub, hub_rep) on its full sets.

    ``cost`` and ``room`` (what a link with the hub allows) decide; members
    near the hub keep their differences, the missing shingles inverted.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, rooms, links, deltas = [], [], [], []
            for x, h in zip(batch.column(4), batch.column(5), strict=True):
                x, h = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, h))
                at = np.searchsorted(h, x)
                known = h[np.minimum(at, len(h) - 1)] == x
                both = int(known.sum())
                cost, room = 100 * (len(h) - both) + percent * (len(x) - both), (100 - percent) * len(h)
                costs.append(cost)
                rooms.append(room)
                links.append(cost <= room)
                if cost <= NEAR * room:
                    missing = np.ones(len(h), dtype=bool)
                    missing[at[known]] = False
                    deltas.append(np.concatenate([x[~known], ~h[missing]]).view(np.int64))
                else:
                    deltas.append(None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(costs, pa.int64()), pa.array(rooms, pa.int64()), pa.array(links, pa.bool_()), pa.array(deltas, pa.list_(pa.int64()))],
                names=["id", "rep", "hub", "hub_rep", "cost", "room", "linked", "delta"],
            )

    # A hub of many pairs is met in several copies, so its pairs spread over tasks.
    many = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("copies"))
    hubs = many.join(sets.withColumnRenamed("id", "hub"), "hub").select("hub", F.col("grams").alias("hub_grams"), "copies")
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    salted = pairs.join(many, "hub").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")).drop("copies")
    rows = salted.join(sets, "id").join(hubs, ["hub", "salt"])
    return rows.select("id", "rep", "hub", "hub_rep", "grams", "hub_grams").mapInArrow(apply, COMPARED)


def _hub_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (key, id, rep, n): each member with its bucket's hub (key, ..., hub, m), and the distinct pairs."""
    hub = rows.groupBy("key").agg(F.min(F.struct("id", "rep", "n")).alias("h"), F.count("*").alias("members")).where("members > 1")
    hub = hub.select("key", F.col("h.id").alias("hub"), F.col("h.rep").alias("hub_rep"), F.col("h.n").alias("m"))
    met = rows.join(hub, "key").where("id <> hub")
    return met, met.select("id", "rep", "n", "hub", "hub_rep", "m").distinct()


def _several(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose ``by`` holds several components."""
    mixed = rows.groupBy(*by).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(*by)
    return rows.join(mixed, by, "left_semi")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("vertex", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _units(members: DataFrame) -> DataFrame:
    """``members`` (hub, id, rep, comp, cost, room, linked, delta) with ``us``, their units by rarity, and ``rest``.

    Tokens are the differences of a member from its hub. Those that one component only holds can't be
    shared with another and are dropped; those with the same holders (told by two 64-bit
    checksums of their ids) are a unit, whose weight is their number. ``rest`` has the weight of a
    unit and all after it.
    """
    keyed = members.select("hub", "id", "comp", F.explode("delta").alias("x"))
    sums = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"s{i}") for i in (1, 2)]
    held = keyed.groupBy("hub", "x").agg(F.count("*").alias("held"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *sums).where("lo < hi")
    held = materialize(held.select("hub", "x", "held", "s1", "s2"), "held")
    own = keyed.select("hub", "id", "x").join(held, ["hub", "x"]).groupBy("hub", "id", "held", "s1", "s2").agg(F.count("*").cast("int").alias("w"))
    own = own.groupBy("hub", "id").agg(F.array_sort(F.collect_list(F.struct("held", "s1", "s2", "w"))).alias("us"))
    rest = F.transform("us", lambda u, i: F.aggregate(F.slice("us", i + 1, F.size("us")), F.lit(0), lambda a, v: a + v["w"]))
    return members.drop("delta").join(own, ["hub", "id"]).withColumn("rest", rest)


def _level(b: Column, base: Column) -> Column:
    """Least cost of level ``b``: level 0 has all that are linked to the hub, level 1 begins beyond."""
    return F.when(b == 0, 0.0).otherwise(base * F.pow(F.lit(SPAN), b - 1) * (1 - 1e-9))


def _needs(units: DataFrame, percent: int) -> DataFrame:
    """A row (..., own, b, need) for each level ``b`` up to its ``own``: what a member has in common with any partner, if one of the two is of level ``b`` and none below.

    A pair has (cost + cost - room) / (100 + p) tokens in common, and the partner's cost is that of
    ``b`` at least, and p for each token in common. Two members linked to the hub are in one component, so one linked to
    it only looks for those that are not.
    """
    whole, base = 100 + percent, F.greatest("room", F.lit(1))
    own = F.when(F.col("linked") | (F.col("cost") <= F.col("room")), 0).otherwise(1 + F.floor(F.log(F.col("cost") / base) / math.log(SPAN)))
    rows = units.withColumn("own", own.cast("int")).withColumn("b", F.explode(F.sequence(F.when(F.col("room") > 0, 0).otherwise(1), F.greatest("own", F.when(F.col("room") > 0, 0).otherwise(1)))))
    b = F.col("b")
    apart = F.greatest(F.ceil((F.col("cost") - F.col("room")) / 100), F.ceil((F.col("cost") + _level(b, base) - F.col("room")) / whole), F.lit(1))
    need = F.when(F.col("own") == 0, F.floor(F.col("cost") / whole) + 1).otherwise(apart)
    most = F.when(b == 0, F.col("room")).otherwise(_level(b + 1, base) * (1 + 1e-6)) / percent
    return rows.withColumn("need", need.cast("int")).where((F.col("need") <= F.element_at("rest", 1)) & ((b == F.col("own")) | (F.col("need") <= most)))


_ROW = ["hub", "b", "id", "rep", "comp", "cost", "room", "own", "need"]


def _grown(rows: DataFrame) -> DataFrame:
    """Each row once for each next unit (from ``at`` on) after which enough may still follow; ``bound`` is what has to be reached."""
    places = F.filter(F.sequence("at", F.size("us")), lambda j: (j < F.size("us")) & (F.coalesce(F.get("rest", j), F.lit(0)) + F.col("w") >= F.col("bound")))
    rows = rows.withColumn("j", F.explode(places))
    unit = F.get("us", F.col("j"))
    grown = rows.select(*_ROW, "rest", F.xxhash64("key", unit["s1"], unit["s2"]).alias("key"), (F.col("j") + 1).alias("at"), (F.col("w") + unit["w"]).alias("w"))
    after = F.slice("rest", F.col("at") + 1, F.size("rest"))
    more = F.size(F.filter(after, lambda r: r + F.col("w") >= F.col("need")))
    return grown.select(*_ROW, "key", "at", "w", F.coalesce(F.get("rest", F.col("at")), F.lit(0)).alias("left"), more.alias("more"))


def _met(y: str, z: str, percent: int) -> Column:
    """Of different components, and enough may be in common: what is, and what both may still have."""
    c = lambda side, name: F.col(f"{side}{name}")
    return (c(y, "comp") != c(z, "comp")) & ((c(y, "w") + F.least(c(y, "left"), c(z, "left"))) * (100 + percent) >= c(y, "cost") + c(z, "cost") - c(y, "room"))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """From rows of mixed groups (with ``lead`` and whether they are ``split``): pairs within groups that aren't, of members that have all in common that is needed, and of the others with one."""
    group = ["hub", "b", "key"]
    together = rows.where(~F.col("split") | (F.col("need") <= F.col("w")))
    side = lambda name: together.select(*group, *(F.col(c).alias(f"{name}_{c}") for c in ("id", "rep", "comp", "cost", "room", "own", "w", "left")))
    both = side("y").join(side("z"), group)
    both = both.where((F.col("y_id") < F.col("z_id")) & ((F.col("y_own") == F.col("b")) | (F.col("z_own") == F.col("b"))) & _met("y_", "z_", percent))
    return both.select("hub", F.col("y_room").alias("room"), *(f"{n}_{c}" for n in "yz" for c in ("id", "rep", "cost"))).unionByName(_stars(rows.where("split"), percent)).distinct()


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """Each row's member with the group's lead, the one of least cost."""
    met = rows.where(_met("lead.", "", percent))
    return met.select("hub", "room", *(F.col(f"lead.{c}").alias(f"y_{c}") for c in ("id", "rep", "cost")), *(F.col(c).alias(f"z_{c}") for c in ("id", "rep", "cost"))).distinct()


def _resolved(members: DataFrame, confirmed: Callable[[DataFrame], DataFrame], labels: DataFrame, percent: int, stars: int = STARS) -> DataFrame:
    """Labels after all ``members`` (with their ``comp``) that may link have met, or are of one component.

    In the first ``stars`` rounds each unit's holders meet one of them; most components are one by then, and units
    that one component only holds are dropped anew. Then groups meet in pairs or are split.
    """
    tested = None
    for turn in range(stars + 1):
        current = members if turn == 0 else materialize(_several(_labelled(members.drop("comp"), labels), ["hub"]), "members")
        units, held = written(_units(current), "units")
        if not held.rows:
            break  # no unit is held by several components
        shape = units.select("hub", "id", "us", "rest")
        start = _needs(units, percent).withColumns({"key": F.lit(0).cast("long"), "at": F.lit(0), "w": F.lit(0), "bound": F.col("need")})
        links, ends = None, False
        while not ends:
            rows, grown = written(_grown(start), "prefixes")
            if not grown.rows:
                break
            lead = F.min(F.when(F.col("own") == F.col("b"), F.struct("cost", "id", "rep", "comp", "w", "left", "room")))
            beyond = F.when(F.col("need") > F.col("w"), F.col("need"))
            leads = F.count_if(F.col("own") == F.col("b"))
            groups = rows.groupBy("hub", "b", "key").agg(
                F.count("*").alias("n"), leads.alias("leads"), F.sum("more").alias("more"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), lead.alias("lead"), F.min(beyond).alias("next")
            )
            met = F.col("leads") * (F.col("n") - (F.col("leads") + 1) / 2)
            split = (F.col("n") > FEW) & F.col("next").isNotNull() & (met > PAID * F.col("more"))
            groups = groups.where("lo < hi and lead is not null").select("hub", "b", "key", "lead", "next", met.alias("met"), split.alias("split"))
            groups, all_groups = written(groups, "groups", met=F.sum("met"), split=F.max("split"))
            if not all_groups.rows:
                break
            ends = turn < stars or not all_groups.split or all_groups.met <= EACH * held.rows
            if ends and all_groups.split:
                groups = groups.withColumn("split", F.lit(False))
            mixed = rows.join(groups, ["hub", "b", "key"])
            pairs = _pairs(mixed, percent) if turn == stars else _stars(mixed, percent)
            if tested is not None:
                pairs = pairs.join(tested, ["hub", "y_id", "z_id"], "left_anti")
            pairs = materialize(pairs, "pairs")
            found, linked = written(confirmed(pairs).distinct(), "found")
            if linked.rows:
                links = found if links is None else links.unionByName(found)
            pairs = pairs.select("hub", "y_id", "z_id")
            tested = pairs if tested is None else tested.unionByName(pairs)
            # Who has all it needs goes on only with those that need more.
            large = mixed.where("split").withColumn("bound", F.greatest("need", "next"))
            start = large.select(*_ROW, "key", "at", "w", "bound").join(shape, ["hub", "id"])
        if links is not None:
            labels = connected_components(labels.select(F.col("vertex").alias("a"), F.col("comp").alias("b")).unionByName(links))
    return labels


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the ``n`` vertices that each reaches over the edges (a, b)."""
    low = np.arange(n)
    while True:
        before, least = low, np.minimum(low[a], low[b])
        low = before.copy()
        np.minimum.at(low, before[a], least)
        np.minimum.at(low, before[b], least)
        while (low[low] != low).any():
            low = low[low]
        if (low == before).all():
            return low


def _shared(y: tuple[np.ndarray, np.ndarray], z: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], tokens: int) -> np.ndarray:
    """How many tokens each row has in common with each column, from their (place, token): frequent ones as products of matrices, the others by their holders."""
    (row, y_token), (col, z_token) = ((at[order], token[order]) for at, token in (y, z) for order in (np.argsort(token, kind="stable"),))
    rows, cols = np.bincount(y_token, minlength=tokens), np.bincount(z_token, minlength=tokens)
    often = rows * cols * OFTEN > shape[0] * shape[1]
    shared, place = np.zeros(shape, dtype=np.int32), np.cumsum(often) - 1
    for first in range(0, int(often.sum()), BLOCK):
        sides = []
        for at, token, n in ((row, y_token, shape[0]), (col, z_token, shape[1])):
            now = often[token] & (place[token] >= first) & (place[token] < first + BLOCK)
            has = np.zeros((n, BLOCK), dtype=np.float32)
            has[at[now], place[token[now]] - first] = 1
            sides.append(has)
        shared += (sides[0] @ sides[1].T).astype(np.int32)  # exact: counts up to BLOCK
    row, y_token = row[~often[y_token]], y_token[~often[y_token]]
    begin, many = (np.cumsum(cols) - cols)[y_token], cols[y_token]
    ends = np.cumsum(many)
    for first in range(0, int(ends[-1]) if len(ends) else 0, MEET):
        lo, hi = np.searchsorted(ends, (first, first + MEET), side="right")
        hi = min(hi + 1, len(ends))  # of a token that two runs meet, each takes its part
        n = np.minimum(ends[lo:hi], first + MEET) - np.maximum(ends[lo:hi] - many[lo:hi], first)
        skip = np.maximum(first - (ends[lo:hi] - many[lo:hi]), 0)
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[lo:hi] + skip, n)
        np.add.at(shared.reshape(-1), np.repeat(row[lo:hi], n) * shape[1] + col[which], 1)
    return shared


def _within(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among the members of each hub, all of which are compared.

    A hub's members are dealt over its ``blocks``, and each two blocks (one with itself too) are a group: a member is in as many groups as there are blocks.
    """

    def apply(group: pa.Table) -> pa.Table:
        comp, cost, room = (group.column(c).to_numpy() for c in ("comp", "cost", "room"))
        left, right = (group.column(c).to_numpy() for c in ("left", "right"))
        deltas = group.column("delta").combine_chunks()
        who = np.repeat(np.arange(len(comp)), np.diff(deltas.offsets.to_numpy()))
        values, token = np.unique(deltas.flatten().to_numpy(), return_inverse=True)
        names, comp = np.unique(comp, return_inverse=True)
        # What a member has in common with any partner of another component, which is not linked to the hub if the member is.
        need = np.where(cost <= room, cost // (100 + percent) + 1, np.maximum(-((room - cost) // 100), 1))
        while len(who):
            lo, hi = np.full(len(values), len(names)), np.full(len(values), -1)
            np.minimum.at(lo, token, comp[who])
            np.maximum.at(hi, token, comp[who])
            both = [np.bincount(token[side[who]], minlength=len(values)) > 0 for side in (left, right)]
            keep = ((lo < hi) & both[0] & both[1])[token]
            keep &= (np.bincount(who[keep], minlength=len(comp)) >= need)[who]
            if keep.all():
                break
            who, token = who[keep], token[keep]
        values, token = np.unique(token, return_inverse=True)
        alive = np.bincount(who, minlength=len(comp)) > 0
        sides = []
        for side in (left & alive, right & alive):
            mine = side[who]
            sides.append((np.flatnonzero(side), ((np.cumsum(side) - 1)[who[mine]], token[mine])))
        (y, y_held), (z, z_held) = sides
        shared = _shared(y_held, z_held, (len(y), len(z)), len(values))
        linked = ((100 + percent) * shared >= cost[y][:, None] + cost[z][None, :] - room[:1]) & (comp[y][:, None] != comp[z][None, :])
        at, to = np.nonzero(linked)
        low = _joined(comp[y[at]], comp[z[to]], len(names))
        moved = np.flatnonzero(low != np.arange(len(names)))
        return pa.table({"a": pa.array(names[low[moved]], pa.int64()), "b": pa.array(names[moved], pa.int64())})

    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select(
        "hub", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
        (F.col("own") <= F.col("other")).alias("left"), (F.col("own") >= F.col("other")).alias("right"), "comp", "cost", "room", "delta",
    )
    return rows.groupBy("hub", "lo", "hi").applyInArrow(apply, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, whole: int = WHOLE, blocks: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text).

    Hubs of up to ``blocks`` blocks of about ``whole`` members are settled in groups of two blocks each, larger ones by units; neither changes the result.
    """
    bound_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    bands = band_count(percent / 100)
    sig = materialize(signatures(docs, k, bands), "signatures")
    full = sig.where("set_id is not null and doc_id is not null")
    classes = materialize(
        full.groupBy(F.col("set_id").alias("id")).agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")),
        "classes",
    )
    banded = classes.select(F.explode("bands").alias("key"), "id", "rep", "n")
    bucket = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    rows = materialize(banded.join(bucket, "key", "left_semi"), "buckets")

    # Only classes that share a bucket can link; their sets are kept once.
    wanted = rows.select("id", "rep").distinct()
    sets = materialize(_sets(docs, k, wanted.select(F.col("rep").alias("name"))).join(wanted.select("id").hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "sets")

    # 1. Members against their buckets' hubs; those far from one choose another.
    compared = None
    for _ in range(HUBS):
        met, pairs = _hub_pairs(rows)
        if compared is not None:
            pairs = pairs.join(compared.select("id", "hub"), ["id", "hub"], "left_anti")
        # Sizes alone tell that a member is far: its cost is 100 - p per shingle of difference at least.
        close = F.greatest(100 * (F.col("m") - F.col("n")), percent * (F.col("n") - F.col("m"))) <= NEAR * (100 - percent) * F.col("m")
        new = materialize(_compared(pairs.where(close).drop("n", "m"), sets, percent), "compared")
        compared = new if compared is None else compared.unionByName(new)
        # A link with a far member costs more than (NEAR - 1) * room * p / 100 itself.
        outer = met.join(compared.select("id", "hub", "cost", "room"), ["id", "hub"], "left").where(F.col("cost").isNull() | (F.col("cost") * 100 > (NEAR - 1) * percent * F.col("room")))
        far = F.max((F.col("cost").isNull() | (F.col("cost") > NEAR * F.col("room"))).cast("int"))
        left = outer.groupBy("key").agg(F.count("*").alias("members"), far.alias("far")).where("members > 1 and far = 1").select("key")
        rows, others = written(outer.select("key", "id", "rep", "n").join(left, "key", "left_semi"), "outer")
        if not others.rows:
            break

    # Rows with one doc_id are one vertex, whatever their texts.
    twice = full.groupBy("doc_id").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo < hi").select("doc_id")
    same = full.join(twice, "doc_id", "left_semi").select("doc_id", F.col("set_id").alias("id")).join(classes.select("id", "rep"), "id")
    links = materialize(compared.where("linked").select(F.col("rep").alias("a"), F.col("hub_rep").alias("b")).unionByName(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))).distinct(), "links")
    labels = connected_components(links)

    # 2. Members near one hub, by the differences from it.
    near = materialize(_several(_labelled(compared.where("delta is not null"), labels), ["hub"]), "near")
    sized = near.groupBy("hub").agg(F.count("*").alias("members"), F.sum(F.size("delta")).alias("tokens"))
    sized = materialize(sized.select("hub", F.ceil(F.greatest(F.col("members") / whole, F.col("tokens") / TOKENS)).cast("int").alias("blocks")), "sized")
    links, found = written(_within(near.join(sized.where(F.col("blocks") <= blocks), "hub"), percent).distinct(), "links")
    if found.rows:
        labels = connected_components(labels.select(F.col("vertex").alias("a"), F.col("comp").alias("b")).unionByName(links))
    rest = near.drop("hub_rep", "comp").join(sized.where(F.col("blocks") > blocks), "hub", "left_semi")
    members, large = written(_several(_labelled(rest, labels), ["hub"]), "members")
    deltas = near.select("hub", "id", "delta")

    def by_differences(met: DataFrame) -> DataFrame:
        met = met.join(deltas.select("hub", F.col("id").alias("y_id"), F.col("delta").alias("y_delta")), ["hub", "y_id"])
        met = met.join(deltas.select("hub", F.col("id").alias("z_id"), F.col("delta").alias("z_delta")), ["hub", "z_id"])
        enough = F.size(F.array_intersect("y_delta", "z_delta")) * (100 + percent) >= F.col("y_cost") + F.col("z_cost") - F.col("room")
        return met.where(enough).select(F.col("y_rep").alias("a"), F.col("z_rep").alias("b"))

    if large.rows:
        labels = _resolved(members, by_differences, labels, percent)

    # 3. Members far from all their hubs, by their shingles.
    if others.rows:
        rest = materialize(_several(_labelled(rows, labels), ["key"]).select("id", "rep", "n", "comp").distinct(), "rest")
        shingles = _shingles(sets.join(rest.select("id"), "id", "left_semi"))
        cost = (F.col("n") * percent).alias("cost")
        members = rest.join(shingles, "id").select(F.lit(b"").alias("hub"), "id", "rep", "comp", cost, F.lit(0).cast("long").alias("room"), F.lit(False).alias("linked"), "delta")

        def by_sets(met: DataFrame) -> DataFrame:
            met = met.where(_near(F.col("y_cost"), F.col("z_cost"), percent))
            pairs = met.select(F.col("y_id").alias("id"), F.col("y_rep").alias("rep"), F.col("z_id").alias("hub"), F.col("z_rep").alias("hub_rep"))
            return _compared(pairs, sets, percent).where("linked").select(F.col("rep").alias("a"), F.col("hub_rep").alias("b"))

        labels = _resolved(materialize(members, "rest"), by_sets, labels, percent, stars=0)

    # Most documents keep their own name; only the others are joined.
    moved = classes.join(labels.withColumnRenamed("vertex", "rep"), "rep", "left").select(F.col("id").alias("set_id"), "copies", "rep", F.coalesce("comp", "rep").alias("comp"))
    moved = moved.where("copies > 1 or comp <> rep").select("set_id", "comp")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("comp")), "doc_id")
    return sig.join(moved, "set_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
