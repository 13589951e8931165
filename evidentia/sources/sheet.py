"""The input sheet: all-string tables whose columns are recognised by their headers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, geo
from ..functions import text as T
from ..operators.evidence import group_key
from ..session import evenly, materialize


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet, all columns as strings, blanks empty. Spreadsheet files need exporting first."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))


def detect_columns(columns: list[str], given: dict[str, str] | None = None) -> dict[str, str | None]:
    """Role of each header: exact hints first, then hints whose words all occur; each column has one role."""
    clean = {c: re.sub(r"[^a-z]+", " ", c.lower()).strip() for c in columns}
    roles: dict[str, str | None] = {}
    for role, hints in fixed.COLUMN_HINTS.items():
        if given and given.get(role):
            named = [c for c in columns if c.strip().lower() == given[role].strip().lower()]
            if not named:
                raise ValueError(f"no column {given[role]!r} among {columns}")
            roles[role] = named[0]
            continue
        free = [c for c in columns if c not in roles.values()]
        exact = [c for h in hints for c in free if clean[c] == h]
        loose = [c for h in hints for c in free if set(h.split()) <= set(clean[c].split())]
        roles[role] = next(iter(exact + loose), None)
    if not roles["name"]:
        raise ValueError(f"no building name column among {columns}")
    return roles


def entities(sheet: DataFrame, roles: dict[str, str | None]) -> DataFrame:
    """Normalised entities with row and group keys and the matcher struct, as a written table; the sheet has ``row_idx``."""
    v = lambda role: T.cell(F.col(f"`{roles[role]}`")) if roles.get(role) else F.lit("")
    e = evenly(sheet).select("row_idx", v("name").alias("raw"), v("locality").alias("address"), v("city").alias("c"), geo.parse_coord(v("lat")).alias("lat"), geo.parse_coord(v("lon")).alias("lon"),
                     v("rera").alias("rera"), v("existing").alias("existing"), v("min_price").alias("sheet_min"), v("max_price").alias("sheet_max"))
    e = materialize(e.withColumn("near_city", geo.city_from_coords(F.col("lat"), F.col("lon"))), "cells")
    by_coords = F.coalesce("near_city", F.lit(""))
    empty = lambda c: F.nullif(c, F.lit(""))
    e = e.withColumns({"name": T.clean_name(F.col("raw")), "city": F.coalesce(empty("c"), empty(by_coords), T.city_from_address(F.col("address"))), "rera_ids": T.split_ids(F.col("rera"))})
    e = materialize(e, "cities").withColumn("loc", T.short_locality(F.col("address"), F.col("city")))
    e = materialize(e.drop("near_city"), "places")
    own = [F.col(c) for c in ("name", "loc", "city", "rera_ids")]
    skipped = F.when(F.col("name") == "", "empty building name").otherwise(T.not_a_project(F.col("raw")))
    e = e.withColumns({"rkey": T.row_key(*own[:3]), "gkey": group_key(*own), "m": T.matcher(*own), "skip_reason": skipped}).drop("raw", "c")
    return materialize(e, "entities")


def search_queries(e: DataFrame, mode: str = "full") -> DataFrame:
    """Ordered searches of each entity, ``gkey, q, query``; spellings that differ in case only count once."""
    name, loc, city, ids = (F.col(c) for c in ("name", "loc", "city", "rera_ids"))
    place = F.concat_ws(" ", F.nullif(loc, F.lit("")), F.nullif(city, F.lit("")))
    first, second = F.get(ids, F.lit(0)), F.get(ids, F.lit(1))
    q = lambda *parts: F.concat_ws(" ", *parts)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    lit = F.lit
    # The words of the searches, in each mode.
    portals = "site:99acres.com OR site:magicbricks.com OR site:housing.com OR site:squareyards.com"
    rows = {
        "possession": [
            q(name, place, lit("possession date")), F.when(F.col("rera") != "", q(F.col("rera"), lit("possession date"))), q(quoted(name), city, lit("possession")),
            q(name, city, lit("rera completion date")), q(name, place, lit("ready to move year built")),
            q(name, city, lit("site:housing.com OR site:99acres.com OR site:magicbricks.com OR site:squareyards.com")), q(name, place, lit("project details possession status")),
        ],
        "rera": [
            quoted(first), q(name, place, lit("rera possession date extension")), F.when(first.isNotNull(), q(first, lit("revised completion date extension"))),
            F.when(second.isNotNull(), q(second, lit("revised completion date extension"))), quoted(second), q(name, city, lit("rera revised completion date")),
        ],
        "full": [
            q(name, place, lit("price possession")), q(name, place, lit(portals)), F.coalesce(quoted(first), q(quoted(name), city, lit("possession date price"))),
            q(name, city, lit("project price per sq.ft possession")),
        ],
    }[mode]
    texts = F.filter(F.transform(F.array(*rows), T.squeeze), lambda t: t.isNotNull() & (t != ""))
    once = F.filter(texts, lambda t, i: ~F.array_contains(F.transform(F.slice(texts, 1, i), F.lower), F.lower(t)))
    return e.where("skip_reason = ''").dropDuplicates(["gkey"]).select("gkey", F.posexplode(once).alias("q", "query"))


def known_projects(sheet: DataFrame, cities=("hyderabad", "secunderabad")) -> DataFrame:
    """Projects already on file: in the cities and the box, coordinates put right, register number extracted.

    ``sheet``: building_name, locality, city, latitude, longitude, rera_id, all strings.
    """
    lat, lon = geo.parse_coord(F.col("latitude")), geo.parse_coord(F.col("longitude"))
    box = fixed.DISCOVERY_BOX
    k = sheet.where(F.lower(F.trim("city")).isin(*cities)).withColumns({"a": lat, "o": lon})
    turn = F.col("a").between(*box[2:]) & F.col("o").between(*box[:2])
    k = k.withColumns({"lat": F.when(turn, F.col("o")).otherwise(F.col("a")), "lon": F.when(turn, F.col("a")).otherwise(F.col("o"))}).drop("a", "o")
    k = k.where(F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:]))
    return k.withColumn("rera_norm", F.regexp_extract(F.upper(F.coalesce("rera_id", F.lit(""))), r"(P0\d{10})", 1))
