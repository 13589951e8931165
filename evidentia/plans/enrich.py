"""Entities to verdicts: recorded searches and pages, facts, fusion, early stop."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.geo import equirect_km
from ..functions.text import html_text, name_score, place_in
from ..operators import evidence, fusion
from ..session import materialize
from ..sources import recorded


def conclusive(mode: str) -> Column:
    """Enough is known to stop searching: a High date; in full mode also a confirmed price with a minimum; never for registers."""
    price = F.coalesce(F.col("price_label").isin("High", "Medium") & F.col("price_min").isNotNull(), F.lit(False))
    high = F.coalesce(F.col("label") == "High", F.lit(False))
    return {"possession": high, "rera": F.lit(False), "full": high & price}[mode]


def facts(entities: DataFrame, results: DataFrame, pages: DataFrame, today: dt.date) -> dict[str, DataFrame]:
    """Candidate tables of all recorded evidence; each row keeps ``q``, the ordinal of its query, in its ``seq``."""
    known = entities.dropDuplicates(["gkey"]).select("gkey", "m")
    r = results.join(known, "gkey")
    snippets = materialize(evidence.matched_snippets(r), "snippets")
    picked = evidence.pick_pages(r)
    parsed = pages.join(picked.select("url").distinct(), "url", "left_semi").select("url", "html", html_text(F.col("html")).alias("page"))
    parsed = materialize(parsed, "parsed-pages")
    html = picked.join(parsed, "url").withColumn("seq", F.col("q") * 1000 + 900).join(known, "gkey")
    read = materialize(evidence.matched_pages(html), "pages")
    return {
        "dates": materialize(evidence.snippet_dates(snippets, today).unionByName(evidence.page_dates(read, today)), "dates"),
        "prices": materialize(evidence.prices(snippets, False).unionByName(evidence.prices(read, True)), "prices"),
        "pairs": materialize(evidence.register_pairs(snippets, today).unionByName(evidence.register_pairs(read, today)), "pairs"),
        "statuses": evidence.status_counts(snippets).unionByName(evidence.status_counts(read)),
    }


def verdicts(entities: DataFrame, found: dict[str, DataFrame], mode: str, today: dt.date, rounds: int = 4) -> DataFrame:
    """One row per group key. Evidence of a query counts only if the verdict of the ones before was not conclusive.

    Round n holds the evidence of the first n queries. All rounds, as many as an entity has
    searches and four at most, are fused at once under a key of entity and round; the
    earliest conclusive one wins, else the last.
    """
    step = 1000 * evidence.STEP
    key = F.struct("gkey", "round").alias("gkey")

    def by_round(df: DataFrame) -> DataFrame:
        first = F.least(F.floor(F.col("seq") / step) + 1, F.lit(rounds)).cast("int")
        rest = [c for c in df.columns if c != "gkey"]
        return df.select("*", F.explode(F.sequence(first, F.lit(rounds))).alias("round")).select(key, *rest)

    every = entities.select("gkey").distinct()
    keys = every.select("gkey", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).select(key)
    statuses = found["statuses"].select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).select(key, "label", "n")
    cands = by_round(found["dates"])
    dates = materialize(fusion.date_fusion(cands, today), "date-rounds")
    prices = fusion.price_fusion(materialize(fusion.namesake_demote(by_round(found["prices"]), cands, dates), "price-rounds"))
    both = fusion.with_missing(dates, keys, statuses).join(prices, "gkey", "left").withColumn("done", conclusive(mode))
    both = both.select("*", F.col("gkey.gkey").alias("g"), F.col("gkey.round").alias("queries")).drop("gkey")
    rest = [c for c in both.columns if c not in ("g", "done")]
    order = F.struct("done", F.when(F.col("done"), -F.col("queries")).otherwise(F.col("queries")))
    return both.groupBy(F.col("g").alias("gkey")).agg(F.max_by(F.struct(*rest), order).alias("v")).select("gkey", "v.*")


def enrich(entities: DataFrame, cache: DataFrame, pages: DataFrame, queries: DataFrame, mode: str, today: dt.date) -> DataFrame:
    """Every entity row with its verdict; rows of one group share the work."""
    found = facts(entities, recorded.cached_results(queries, cache), pages, today)
    work = entities.where("skip_reason = ''")
    v = verdicts(work, found, mode, today)
    if mode == "rera":
        v = v.join(fusion.registry_summary(found["dates"], found["pairs"], today), "gkey", "left")
    out = entities.join(v, "gkey", "left")
    skipped = F.col("skip_reason") != ""
    empty = F.col("skip_reason") == "empty building name"
    return out.withColumns({
        "label": F.when(empty, "Not found").when(skipped, "Skipped").otherwise(F.coalesce("label", F.lit("Not found"))),
        "note": F.when(skipped, F.col("skip_reason")).otherwise(F.col("note")),
        "found": F.coalesce("found", F.lit(False)),
    }).drop("m")


def accept_provider_options(entities: DataFrame, options: DataFrame) -> DataFrame:
    """The provider's project for each entity: near and named alike, the best two options tried in order.

    ``options``: gkey, option_id, title, place, rera, o_lat, o_lon. Accepted with the same
    register number, within 3 km, or within 8 km with a score of 0.9 and the locality named.
    """
    from pyspark.sql import Window

    o = options.join(entities.dropDuplicates(["gkey"]).select("gkey", "m", "lat", "lon"), "gkey")
    m, title = F.col("m"), F.concat_ws(" ", "title", "place")
    o = o.withColumns({"score": name_score(title, m), "km": equirect_km(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))})
    o = o.where((F.col("score") >= fixed.PROVIDER_MIN_SCORE) & (F.col("km") <= fixed.PROVIDER_MAX_KM))
    o = o.withColumn("n", F.row_number().over(Window.partitionBy("gkey").orderBy(F.desc("score"), "km", "option_id"))).where("n <= 2")
    from ..functions.text import id_conflict, id_in

    same = id_in(F.col("rera"), m)
    near = (F.col("km") <= fixed.PROVIDER_NEAR_KM) | ((F.col("km") <= fixed.PROVIDER_FAR_KM) & (F.col("score") >= 0.9) & place_in(title, m))
    ok = o.where(same | (near & ~id_conflict(F.coalesce("rera", F.lit("")), m)))
    return ok.groupBy("gkey").agg(F.min_by(F.struct("option_id", "score", "km"), "n").alias("o")).select("gkey", "o.*")
