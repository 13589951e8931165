"""Nearest rows on the sphere: a tree of cells that follows the points, searched by all rows at once.

Points lie in a cube around the earth that is halved along its three axes again and
again; each occupied cell is a row with its count, the box of its points and one
point of it. A cell of up to ``LEAF`` points is not split, so a dense city is cut finely
and an empty country not at all. The search goes down the tree in joins: a row
keeps the cells that may hold its nearest point, those whose box is no farther than some
point known by then, and meets the children of these in the next round. So
a row meets a few cells a round and the points of a few leaves, in the middle of a city as
well as far from all points, without a first radius or a largest one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..session import materialize

#: Points of a cell that is not split.
LEAF = 32
#: Halvings from one level to the next, and at most (cells of 12 m).
STEP, DEEPEST = 2, 20
#: Cells of the first level, at most: the first level of all has no more.
ROOTS = 8**STEP
_AXES = ("x", "y", "z")
#: Cells are kept up to this much beyond the known distance, so that rounding loses none and ties stay.
_SLACK, _LEAST = 1e-9, 1e-15


def _on_sphere(lat: str, lon: str) -> dict[str, Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return {"x": F.cos(la) * F.cos(lo), "y": F.cos(la) * F.sin(lo), "z": F.sin(la)}


def _sum(parts) -> Column:
    return reduce(Column.__add__, parts)


def _cells(points: DataFrame) -> DataFrame:
    """Rows of ``points`` on every level: (level, id, parent)."""
    level = F.col("level")
    side = [F.least(F.floor((F.col(a) + 1) * F.pow(F.lit(2.0), level - 1)), F.pow(F.lit(2.0), level) - 1).cast("long") for a in _AXES]
    leveled = points.withColumn("level", F.explode(F.sequence(F.lit(STEP), F.lit(DEEPEST), F.lit(STEP)))).withColumns({f"i{a}": s for a, s in zip(_AXES, side, strict=True)})

    def name(shift: int) -> Column:
        ix, iy, iz = (F.shiftright(f"i{a}", shift) for a in _AXES)
        return ix * (1 << 2 * DEEPEST) + iy * (1 << DEEPEST) + iz

    return leveled.withColumns({"id": name(0), "parent": name(STEP)}).drop(*(f"i{a}" for a in _AXES))


def tree(points: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Cells (level, id, parent, n, leaf, the box, one point), the points of the leaves, and the first level, from (r_lat, r_lon, x, y, z, ...).

    The first level is the last one that has ``ROOTS`` cells at most: points of one country skip those of the globe.
    """
    leveled = _cells(points)
    box = [f(a).alias(f"{a}_{w}") for a in _AXES for w, f in (("lo", F.min), ("hi", F.max))]
    every = leveled.groupBy("level", "id").agg(F.min("parent").alias("parent"), F.count("*").alias("n"), *box, F.min(F.struct(*_AXES)).alias("one"))
    every = materialize(every.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("level") == DEEPEST)), "cells")
    wide = {r.level: r["count"] for r in every.groupBy("level").count().collect()}
    top = max((level for level, n in wide.items() if n <= ROOTS), default=STEP)
    split = every.where("not leaf").select((F.col("level") + STEP).alias("level"), F.col("id").alias("parent"))
    below = every.where(F.col("level") > top).join(split, ["level", "parent"], "left_semi").select(every.columns)
    live = materialize(every.where(F.col("level") == top).unionByName(below), "live-cells")
    held = leveled.drop("parent").join(live.where("leaf").select("level", "id"), ["level", "id"])
    return live, materialize(held, "leaf-points"), top


def _bounds(rows: DataFrame) -> DataFrame:
    """Adds the squared chords to the box (``near``) and to the cell's point (``far``)."""
    near = _sum(F.pow(F.greatest(F.col(f"{a}_lo") - F.col(a), F.col(a) - F.col(f"{a}_hi"), F.lit(0.0)), 2) for a in _AXES)
    far = _sum(F.pow(F.col(a) - F.col("one")[a], 2) for a in _AXES)
    return rows.withColumns({"near": near, "far": far})


def nearest(left: DataFrame, right: DataFrame, key: str, value: str, order: str | None = None, most_km: float | None = None) -> DataFrame:
    """Nearest right row of each left row with a place: ``key, nearest, nearest_km``.

    ``left`` has columns ``lat, lon``, ``right`` has ``r_lat, r_lon``. Of rows at the same
    distance the smallest ``order``, or else ``value``, is taken. Rows farther than
    ``most_km`` from all are left out, if it is given; without right rows nothing is found.
    """
    first = [order] if order else []
    points = right.where("r_lat is not null and r_lon is not null").groupBy("r_lat", "r_lon").agg(F.min(F.struct(*first, value)).alias("held"))
    live, held, first_level = tree(points.withColumns(_on_sphere("r_lat", "r_lon")))
    asked = left.where("lat is not null and lon is not null").select("lat", "lon").distinct().withColumns(_on_sphere("lat", "lon"))
    cell = ["level", "id", "leaf", "near", "far"]
    roots = live.where(F.col("level") == first_level).select("level", "id", "leaf", *(f"{a}_{w}" for a in _AXES for w in ("lo", "hi")), "one").collect()  # at most ROOTS
    if not roots:
        return left.select(key, F.lit(None).cast(right.schema[value].dataType).alias("nearest"), F.lit(None).cast("double").alias("nearest_km")).limit(0)
    known = [F.struct(*(F.lit(r[c]).alias(c) for c in r.asDict() if c != "one"), F.struct(*(F.lit(r.one[a]).alias(a) for a in _AXES)).alias("one")) for r in roots]
    met = _bounds(asked.withColumn("c", F.explode(F.array(*known))).select(*asked.columns, "c.*"))
    while True:
        best = F.min("far").alias("best")
        kept = met.groupBy("lat", "lon", *_AXES).agg(best, F.collect_list(F.struct(*cell)).alias("cells"))
        kept = kept.withColumn("cells", F.filter("cells", lambda c: c["near"] <= F.col("best") * (1 + _SLACK) + _LEAST))
        front = materialize(kept.select("lat", "lon", *_AXES, F.explode("cells").alias("c")).select("lat", "lon", *_AXES, "c.*"), "front")
        if front.where("not leaf").isEmpty():
            break
        below = live.select((F.col("level") - STEP).alias("level"), F.col("parent").alias("id"), *(F.col(c).alias(f"_{c}") for c in ("level", "id", "leaf")), *(c for c in live.columns if c[1:] in ("_lo", "_hi")), "one")
        opened = front.where("not leaf").drop("leaf", "near", "far").join(below, ["level", "id"]).drop("level", "id")
        opened = _bounds(opened.withColumnsRenamed({f"_{c}": c for c in ("level", "id", "leaf")}))
        met = front.where("leaf").unionByName(opened.select(*front.columns))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    pairs = front.select("lat", "lon", "level", "id").join(held.select("level", "id", "r_lat", "r_lon", "held"), ["level", "id"])
    found = pairs.groupBy("lat", "lon").agg(F.min(F.struct(km.alias("km"), "held")).alias("b"))
    found = materialize(found.select("lat", "lon", F.col("b.held")[value].alias("nearest"), F.col("b.km").alias("nearest_km")), "nearest")
    out = left.select(key, "lat", "lon").join(found, ["lat", "lon"]).select(key, "nearest", "nearest_km")
    return out if most_km is None else out.where(F.col("nearest_km") <= most_km)
