"""Weighted candidates fused into one verdict per entity, by grouped aggregation and small range frames.

A candidate table has ``gkey, url, domain, year, month, precision, kind, score,
context, is_rera, trusted, origin, seq``; ``seq`` is the order of discovery and
settles ties. For dates, candidates are dealt by entity once, with what a verdict
needs of them, and all else is done where they lie. Entities of more than
``CROWDED`` candidates are left out of that: their raw candidates are only ever summed and max-ed by
keys that include url or domain, with map-side combine, so one entity with a third of
all rows is spread over tasks; windows run over an entity's sums by date and domain.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dates import date_key, display, month_name, ordinal
from ..functions.money import format_inr
from ..functions.text import on_domain

#: Candidates of an entity that one task may sort; and how many entities of more than these are looked for.
CROWDED, MOST_CROWDED = 1_000_000, 1_000


def crowded(cands: DataFrame, limit: int) -> list[int]:
    """Hashes of the entities with more than about ``limit`` candidates, from a sketch of frequent values; they are few."""
    top = cands.select(F.expr(f"approx_top_k(xxhash64(gkey), {MOST_CROWDED}, {10 * MOST_CROWDED})")).first()[0]
    return [r["item"] for r in top or [] if r["count"] > limit]


def best_per_url(cands: DataFrame) -> DataFrame:
    """Of each entity, url and date the candidate with the highest score, the first one on a tie.

    ``seq`` becomes that of the first candidate seen for the url and date.
    """
    c = cands.withColumn("key", date_key(F.col("year"), F.col("month")))
    rest = [x for x in c.columns if x not in ("gkey", "url", "key", "seq")]
    best = F.max_by(F.struct(*rest), F.struct("score", (-F.col("seq")).alias("first"))).alias("best")
    return c.groupBy("gkey", "url", "key").agg(best, F.min("seq").alias("seq")).select("gkey", "url", "key", "best.*", "seq")


def date_groups(cands: DataFrame) -> DataFrame:
    """Month groups of each entity: score, support from neighbours, domains and top candidate.

    Bare years add 0.6 of their score, and their domain, to the best month of the
    year; they form a group of their own where no month is known.
    """
    by_domain = (
        best_per_url(cands)
        .groupBy("gkey", "key", "domain")
        .agg(
            F.sum("score").alias("score"),
            F.min("seq").alias("seq"),
            F.max("trusted").alias("trusted"),
            F.max(F.col("trusted") & (F.col("is_rera") | F.col("structured"))).alias("strong"),
            F.max(F.struct("trusted", "score", (-F.col("seq")).alias("first"), "url", "year", "month", "precision", "origin", "context")).alias("top"),
        )
    )
    month, of_year = F.length("key") == 7, Window.partitionBy("gkey", "year")
    of_month = Window.partitionBy("gkey", "year", "key")
    moved = by_domain.withColumn("year", F.substring("key", 1, 4)).withColumns({"s": F.sum("score").over(of_month), "first": -F.min("seq").over(of_month)})
    moved = (
        moved.withColumn("into", F.max(F.when(month, F.struct("s", "first", "key"))).over(of_year)["key"])
        .withColumn("rolled", ~month & F.col("into").isNotNull())
        .withColumn("key", F.when(F.col("rolled"), F.col("into")).otherwise(F.col("key")))
    )
    own = lambda c: F.when(~F.col("rolled"), c)
    per_domain = moved.groupBy("gkey", "key", "domain").agg(
        F.sum(F.when(F.col("rolled"), F.col("score") * 0.6).otherwise(F.col("score"))).alias("score"),
        F.min(own(F.col("seq"))).alias("seq"),
        F.max(own(F.col("trusted"))).alias("trusted"),
        F.max(own(F.col("strong"))).alias("strong"),
        F.max(own(F.col("top"))).alias("top"),
    )
    groups = per_domain.groupBy("gkey", "key").agg(
        F.sum("score").alias("score"),
        F.min("seq").alias("seq"),
        F.count("*").alias("sources"),
        F.count_if(F.col("trusted")).alias("trusted_domains"),
        F.coalesce(F.max("strong"), F.lit(False)).alias("strong"),
        F.max("top").alias("top"),
    )
    mon = ordinal(F.col("key"))
    w = Window.partitionBy("gkey").orderBy("mon")
    near = F.coalesce(F.sum("score").over(w.rangeBetween(-3, -1)), F.lit(0.0)) + F.coalesce(F.sum("score").over(w.rangeBetween(1, 3)), F.lit(0.0))
    return groups.withColumn("mon", mon).withColumn("eff", F.col("score") + 0.3 * F.when(F.col("mon").isNull(), 0.0).otherwise(near))


def ranked_groups(cands: DataFrame) -> DataFrame:
    order = [F.desc(F.col("trusted_domains") > 0), F.desc("eff"), F.col("mon").isNull(), F.asc("seq")]
    every = Window.partitionBy("gkey")
    return date_groups(cands).withColumn("rank", F.row_number().over(every.orderBy(*order))).withColumn("total", F.sum("score").over(every))


def date_fusion(cands: DataFrame, today: dt.date, dealt: bool = False, limit: int = CROWDED) -> DataFrame:
    """One verdict per entity: date, status, label, confidence, sources, evidence and alternatives.

    ``dealt``: the candidates of an entity are in one partition already, and Spark knows. Otherwise
    the keys of ``cands`` are read once more, before the rest, for the entities of more than ``limit`` candidates.
    """
    # All that a verdict shows or asks; evidence is the first 300 characters.
    rows = cands.select(
        "gkey", "url", "domain", "year", "month", "precision", "score", F.substring(F.coalesce("context", F.lit("")), 1, 300).alias("context"),
        "is_rera", "trusted", (F.col("kind") == "structured").alias("structured"), F.coalesce(F.nullif("origin", F.lit("")), "kind").alias("origin"), "seq",
    )
    if dealt:
        return _verdicts(rows, today)
    many = crowded(cands, limit)
    if not many:
        return _verdicts(rows.repartition("gkey"), today)
    alone = F.xxhash64("gkey").isin(many)
    return _verdicts(rows.where(alone), today).unionByName(_verdicts(rows.where(~alone).repartition("gkey"), today))


def _verdicts(cands: DataFrame, today: dt.date) -> DataFrame:
    ranked = ranked_groups(cands)
    alternative = F.concat(
        F.when(F.length("key") == 4, F.col("key")).otherwise(F.concat_ws(" ", month_name(F.substring("key", 6, 2).cast("int")), F.substring("key", 1, 4))),
        F.lit(" ("), F.col("sources").cast("string"), F.lit(" src)"),
    )
    first = F.col("rank") == 1
    columns = ["key", "score", "eff", "sources", "trusted_domains", "strong", "top", "total"]
    one = ranked.groupBy("gkey").agg(
        *(F.max(F.when(first, F.col(c))).alias(c) for c in columns),
        F.collect_list(F.when(F.col("rank").between(2, 5), F.struct("rank", alternative.alias("text")))).alias("others"),
    )
    agreement = F.col("score") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    one = one.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("eff") / 1.5) * (0.5 + 0.5 * agreement), 2))
    sure = (F.col("trusted_domains") >= 2) | (F.col("strong") & (F.col("top.score") >= 0.7))
    label = (
        F.when(F.col("trusted_domains") == 0, "Low").when((F.col("confidence") >= 0.55) & sure, "High").when(F.col("confidence") >= 0.3, "Medium").otherwise("Low")
    )
    later = F.col("top.year") * 12 + F.coalesce("top.month", F.lit(12)) > today.year * 12 + today.month
    # Only what the register's date needs is shuffled with it.
    register = (
        best_per_url(cands.where("is_rera").select("gkey", "url", "year", "month", "precision", "score", "seq"))
        .groupBy("gkey")
        .agg(F.max_by(F.struct("year", "month", "precision"), F.struct("score", F.col("month").isNotNull().alias("dated"), (-F.col("seq")).alias("first"))).alias("r"))
        .select("gkey", display(F.col("r.year"), F.col("r.month"), F.col("r.precision")).alias("rera_date"))
    )
    verdict = one.select(
        "gkey",
        F.lit(True).alias("found"),
        display(F.col("top.year"), F.col("top.month"), F.col("top.precision")).alias("display"),
        F.col("key").alias("iso"),
        F.col("top.precision").alias("precision"),
        F.when(later, "Under Construction").otherwise("Ready to Move").alias("status"),
        label.alias("label"),
        "confidence",
        "sources",
        F.col("top.url").alias("best_url"),
        F.concat(F.lit("["), F.col("top.origin"), F.lit("] "), F.col("top.context")).alias("evidence"),
        F.array_join(F.transform(F.array_sort("others"), lambda o: o["text"]), "; ").alias("alternatives"),
        F.when(F.col("trusted_domains") == 0, "only seen on unverified websites - check before using").otherwise("").alias("note"),
    )
    return verdict.join(register, "gkey", "left").withColumn("rera_date", F.coalesce("rera_date", F.lit("")))


def with_missing(verdicts: DataFrame, entities: DataFrame, statuses: DataFrame) -> DataFrame:
    """All of ``entities`` (gkey): those without a date get "Not found" and the most frequent page status."""
    modal = statuses.groupBy("gkey", "label").agg(F.sum("n").alias("n")).groupBy("gkey").agg(F.max_by("label", F.struct("n", "label")).alias("page_status"))
    out = entities.select("gkey").distinct().join(verdicts, "gkey", "left").join(modal, "gkey", "left")
    return out.select(
        "gkey",
        F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("label", F.lit("Not found")).alias("label"),
        F.coalesce("status", "page_status", F.lit("")).alias("status"),
        F.when(F.col("found"), F.col("note")).otherwise("no possession date found on the web").alias("note"),
        *(c for c in verdicts.columns if c not in ("gkey", "found", "label", "status", "note")),
    )


def price_fusion(cands: DataFrame) -> DataFrame:
    """Best price per entity with one source. High: another trusted site agrees within 20 per cent.

    ``cands``: ``gkey, lo, hi, kind, url, domain, trusted, weight, origin, context, per_sqft, seq``.
    """
    wide = F.col("trusted") & (F.col("hi") > 5 * F.col("lo"))
    rank = F.create_map(*(F.lit(x) for pair in fixed.KIND_RANK.items() for x in pair))
    c = cands.withColumn("was_trusted", F.col("trusted")).withColumns({
        "trusted": F.col("trusted") & ~((F.col("lo") != 0) & wide),
        "context": F.when((F.col("lo") != 0) & wide, F.concat(F.lit("(very wide range - may mix other listings) "), "context")).otherwise(F.col("context")),
        "first": -F.col("seq"),
    })
    full = F.col("lo") != 0
    order = F.struct(
        "trusted", on_domain(F.col("domain"), fixed.MAJOR_PORTALS).alias("major"), F.coalesce(F.try_element_at(rank, F.col("kind")), F.lit(0)).alias("rank"),
        (F.col("origin") != "search snippet").alias("page"), "weight", "first",
    )
    value = F.struct("lo", "hi", "kind", "url", "domain", "trusted", "origin", "context", "per_sqft")
    best = c.groupBy("gkey").agg(
        F.max_by(value, F.when(full, order)).alias("b"),
        F.max(full).alias("has_price"),
        F.max_by("per_sqft", F.when(F.col("per_sqft") > 0, F.struct("was_trusted", "first"))).alias("first_sqft"),
        F.max_by(value, F.when(F.col("per_sqft") > 0, F.struct("was_trusted", "weight", "first"))).alias("s"),
    )
    best = best.where(F.col("has_price") | F.col("s").isNotNull())
    per_domain = c.where(full).groupBy("gkey", "domain").agg(
        F.max_by(F.struct("lo", "hi", "weight", "first"), F.struct("weight", "first")).alias("d"),
    )
    joined = c.where(full & F.col("trusted")).join(best.select("gkey", "b"), "gkey")
    agree = (
        joined.where((F.col("domain") != F.col("b.domain")) & (F.abs(F.col("lo") - F.col("b.lo")) <= 0.2 * F.col("b.lo")))
        .groupBy("gkey").agg(F.lit(True).alias("agrees"))
    )
    place = Window.partitionBy("gkey").orderBy(F.desc("d.weight"), F.desc("d.first"))
    spread = lambda lo, hi: F.when(hi > lo * 1.02, F.concat(format_inr(lo), F.lit(" - "), format_inr(hi)))
    other = F.concat(F.coalesce(spread(F.col("d.lo"), F.col("d.hi")), format_inr(F.col("d.lo"))), F.lit(" ("), F.col("domain"), F.lit(")"))
    others = (
        per_domain.join(best.select("gkey", F.col("b.domain").alias("best_domain")), "gkey")
        .where(F.col("domain") != F.col("best_domain"))
        .withColumn("n", F.row_number().over(place))
        .where("n <= 4")
        .groupBy("gkey")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", other.alias("text")))), lambda o: o["text"]), "; ").alias("others"))
    )
    out = best.join(agree, "gkey", "left").join(others, "gkey", "left")
    b, s = F.col("b"), F.col("s")
    shown = F.coalesce(spread(b["lo"], b["hi"]), F.when(b["kind"] == "onwards", F.concat(format_inr(b["lo"]), F.lit(" onwards"))), format_inr(b["lo"]))
    per = F.when(F.col("has_price"), F.when(b["per_sqft"] > 0, b["per_sqft"]).otherwise(F.col("first_sqft"))).otherwise(s["per_sqft"])
    pick = lambda c: F.when(F.col("has_price"), b[c]).otherwise(s[c])
    return out.select(
        "gkey",
        F.when(F.col("has_price"), shown).alias("price_display"),
        F.when(F.col("has_price"), b["lo"].cast("long")).alias("price_min"),
        F.when(F.col("has_price"), b["hi"].cast("long")).alias("price_max"),
        F.when(per > 0, F.concat(F.lit("₹"), F.format_number(per, 0), F.lit("/sq.ft"))).alias("price_sqft"),
        F.when(~pick("trusted"), "Low").when(F.col("has_price") & F.coalesce("agrees", F.lit(False)), "High").otherwise("Medium").alias("price_label"),
        pick("url").alias("price_url"),
        F.concat(F.lit("["), pick("origin"), F.lit("] "), F.substring(pick("context"), 1, 250)).alias("price_evidence"),
        F.coalesce("others", F.lit("")).alias("price_alternatives"),
    )


def namesake_demote(prices: DataFrame, cands: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A page whose closest date is over 12 months from a confirmed verdict is another project's: its prices lose trust."""
    sure = verdicts.where(F.col("found") & F.col("label").isin("High", "Medium") & (F.length("iso") == 7)).select("gkey", ordinal(F.col("iso")).alias("want"))
    gap = F.abs(F.col("year") * 12 + F.col("month") - F.col("want"))
    # Verdicts are the small side: a table of them spares sorting all candidates. A struct is aggregated by sorting, in
    # one buffer that can be spilled; by hashing, partial and final table would be held at once.
    dated = cands.where(F.col("month").isNotNull()).join(sure.hint("shuffle_hash"), "gkey").select("gkey", "url", F.struct(gap.alias("gap")).alias("gap"))
    off = dated.groupBy("gkey", "url").agg(F.min("gap").alias("gap")).where("gap.gap > 12").select("gkey", "url", F.lit(True).alias("off"))
    bad = F.coalesce("off", F.lit(False)) & F.col("trusted")
    note = F.concat(F.lit("(possession on this page differs - maybe another project) "), "context")
    out = prices.join(off, ["gkey", "url"], "left").withColumns({"context": F.when(bad, note).otherwise(F.col("context")), "trusted": F.col("trusted") & ~bad})
    return out.select(prices.columns)


def registry_summary(cands: DataFrame, pairs: DataFrame, today: dt.date) -> DataFrame:
    """Registered completion date of each entity: best original/revised pair, else the fused register candidates."""
    good = pairs.where("relevance >= 0.75").groupBy("gkey").agg(F.max(F.struct("id_match", "rev", "relevance", (-F.col("seq")).alias("first"), "orig", "url", "text")).alias("p"))
    rera = cands.where(F.col("is_rera") & (F.col("score") >= 0.2))
    fused = date_fusion(rera, today).select("gkey", F.struct("iso", "display", "evidence", "best_url", "alternatives").alias("v"))
    mention = rera.where((F.col("kind") == "extension") & (F.col("score") >= 0.35)).groupBy("gkey").agg(F.max_by("context", F.struct("score", (-F.col("seq")).alias("first"))).alias("mention"))
    shown = lambda d: display(d["y"], d["m"], F.lit("month"))
    p, v = F.col("p"), F.col("v")
    extended = F.when(p["rev"] > p["orig"], F.concat(F.lit("Yes - extended "), shown(p["orig"]), F.lit(" -> "), shown(p["rev"]))).when(p.isNotNull(), "No - revised date same as original")
    text = lambda *c: F.coalesce(*c, F.lit(""))
    return good.join(fused, "gkey", "full").join(mention, "gkey", "left").select(
        "gkey",
        text(shown(p["orig"])).alias("rera_orig_display"),
        text(date_key(p["rev"]["y"], p["rev"]["m"]), v["iso"]).alias("rera_current_iso"),
        text(shown(p["rev"]), v["display"]).alias("rera_current_display"),
        F.coalesce(extended, F.concat(F.lit("Mentioned: "), F.substring("mention", 1, 150)), F.lit("Not found")).alias("extension_found"),
        text(p["text"], v["evidence"]).alias("rera_evidence"),
        text(p["url"], v["best_url"]).alias("rera_url"),
        text(v["alternatives"]).alias("rera_alternatives"),
    )


def latest_by_key(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(*key, "v.*")
