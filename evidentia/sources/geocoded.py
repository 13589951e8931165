"""Places by name and names of places, from recorded answers of a geocoder (no network here).

An answer is a row of ``query`` or of coordinates; of several answers to one
question the one with the largest ``seq`` counts. An answer without a hit has
null coordinates; it is known, so the question isn't asked again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

PLACE = ["locality", "district", "pin"]


def _given(c: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))


def _tries(locality: Column, district: Column, pin: Column) -> Column:
    """Questions for a place, best first: locality in its district, locality in the main city, postal code."""
    ask = lambda cond, label, *parts: F.when(cond, F.struct(F.lit(label).alias("by"), F.concat_ws(", ", *parts).alias("query")))
    city, state, country = (F.lit(x) for x in fixed.GEOCODED_IN)
    asked = F.array(
        ask(locality.isNotNull() & district.isNotNull(), "locality", locality, district, state, country),
        ask(locality.isNotNull(), "locality", locality, city, state, country),
        ask(pin.isNotNull(), "PIN code", pin, country),
    )
    return F.filter(asked, lambda t: t.isNotNull())


def _asked(places: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each question of each different place, with what is known: ``at, by, query, known, lat, lon, hit``.

    Places are taken once each before they meet the answers, so that a place of
    very many rows is one row here.
    """
    last = answers.groupBy("query").agg(F.max_by(F.struct("lat", "lon"), "seq").alias("a"))
    places = places.select(*(_given(c).alias(c) for c in PLACE)).distinct()
    tries = places.select(*PLACE, F.posexplode(_tries(*(F.col(c) for c in PLACE))).alias("at", "t")).select(*PLACE, "at", "t.*")
    south, north, west, east = fixed.DISCOVERY_BOX
    found = tries.join(last, "query", "left").select(*PLACE, "at", "by", "query", F.col("a").isNotNull().alias("known"), "a.lat", "a.lon")
    hit = F.coalesce(F.col("lat").between(south, north) & F.col("lon").between(west, east), F.lit(False))
    return found.withColumn("hit", hit)


def geocode(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """``rows`` (locality, district, pin, ...) with ``geo_lat, geo_lon, geo_by`` of their first question whose answer is in the region's box; else null.
    Columns of these names are replaced.

    Blanks and nulls are no part of a question; a row without any has no place.
    ``answers``: query, lat, lon, seq.
    """
    hits = _asked(rows, answers).where("hit")
    best = hits.groupBy(*PLACE).agg(F.min_by(F.struct("lat", "lon", "by"), "at").alias("_hit"))
    best = best.select(*(F.col(c).alias(f"_{c}") for c in PLACE), "_hit")
    new = {f"geo_{c}": best["_hit"][c].alias(f"geo_{c}") for c in ("lat", "lon", "by")}
    rows = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in new))
    given = lambda c: F.nullif(F.trim(F.coalesce(rows[c].cast("string"), F.lit(""))), F.lit(""))
    joined = rows.join(best, [given(c).eqNullSafe(best[f"_{c}"]) for c in PLACE], "left")
    return joined.select(*(rows[f"`{c}`"] for c in rows.columns), *new.values())


def unasked(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """The next question, ``query``, of each place that has no hit yet and whose questions so far have all been answered; once each."""
    asked = _asked(rows, answers)
    open_ = asked.groupBy(*PLACE).agg(F.min(F.when(F.col("hit"), F.col("at"))).alias("hit_at"), F.min_by("query", F.when(~F.col("known"), F.col("at"))).alias("query"), F.min(F.when(~F.col("known"), F.col("at"))).alias("open_at"))
    return open_.where("open_at is not null and (hit_at is null or open_at < hit_at)").select("query").distinct()


def _grid(lat: Column, lon: Column) -> list[Column]:
    """Coordinates in steps of 0.0001 degrees, halves away from zero."""
    return [F.round(c.try_cast("double") * 10000).cast("long") for c in (lat, lon)]


def _first(*names: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names), F.lit(""))


def reverse_geocode(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """``rows`` (lat, lon, locality, city, ...) whose locality and city are both blank get those of their coordinates; others stay.

    ``answers``: lat, lon, seq and the parts of an address. Rows without
    coordinates or answer keep blanks.
    """
    city = F.regexp_replace(_first(*fixed.ADDRESS_CITY), fixed.CITY_SUFFIX, "")
    named = answers.select(*(c.alias(n) for c, n in zip(_grid(F.col("lat"), F.col("lon")), ("_y", "_x"), strict=True)), "seq", F.struct(_first(*fixed.ADDRESS_LOCALITY).alias("locality"), F.trim(city).alias("city")).alias("a"))
    named = named.groupBy("_y", "_x").agg(F.max_by("a", "seq").alias("_a"))
    blank = _given("locality").isNull() & _given("city").isNull()
    # Only blank rows look for an answer, so the others need no partner.
    y, x = _grid(rows["lat"], rows["lon"])
    joined = rows.join(named, blank & (y == named["_y"]) & (x == named["_x"]), "left")
    new = {c: F.when(blank, F.coalesce(named["_a"][c], F.lit(""))).otherwise(F.coalesce(rows[c], F.lit(""))).alias(c) for c in ("locality", "city")}
    return joined.select(*(new.get(c, rows[f"`{c}`"]) for c in rows.columns))
