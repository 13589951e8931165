"""Projects not yet on file, from a register, listing sites and map places.

Tables: ``register`` (key, seq, name, promoter, last_modified, detail_url, extension_cert, and the
detail fields with lat, lon, type_ok, in_footprint, rera_no), ``listings`` (seq, url, site,
name, locality, builder, rera_no, price, price_sqft, possession), ``places`` (cid, title,
category, address, lat, lon, rating, reviews, query), ``found`` (web lookups: cid, builder,
rera_no, possession, price, price_sqft), ``known`` (building_name, lat, lon, rera_norm, seq)
and ``geo`` (lkey, lat, lon).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import norm
from ..operators.matching import best_match, name_similarity, radius_pairs, token_pairs
from ..operators.nearest import nearest


def against_known(rows: DataFrame, known: DataFrame, key: str, name: str, rera: Column, match_km: float) -> DataFrame:
    """Adds nearest_known, nearest_km, onboarded and onboarded_as.

    Same register number first; with coordinates the first known project, in order, within
    ``match_km`` whose name is alike (0.8); without them only a nearly equal name (0.9).
    """
    r = rows.withColumn("_rera", F.coalesce(rera, F.lit("")))
    k = known.select(F.col("building_name").alias("k_name"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "rera_norm", F.col("seq").alias("k_seq"))
    by_id = k.where("rera_norm <> ''").groupBy(F.col("rera_norm").alias("_rera")).agg(F.min_by("k_name", "k_seq").alias("id_name"))
    small = r.select(key, name, "lat", "lon")
    near = nearest(small, k, key, "k_name", "k_seq")
    close = name_similarity(radius_pairs(small, k, match_km), name, "k_name", 0.8).where("sim >= 0.8")
    close = close.groupBy(key).agg(F.min_by(F.struct("k_name", "sim", "km"), "k_seq").alias("c"))
    names = small.where("lat is null or lon is null")
    alike = best_match(name_similarity(token_pairs(names, k, name, "k_name"), name, "k_name", 0.9), [key], F.col("k_name"), seq="k_seq", least=0.9).select(key, F.col("match").alias("same_name"))
    out = r.join(by_id, "_rera", "left").join(near, key, "left").join(close, key, "left").join(alike, key, "left")
    by_name = F.format_string("Yes (name match %.2f, %.1f km)", F.col("c.sim"), F.col("c.km"))
    verdict = F.when(F.col("id_name").isNotNull(), "Yes (same RERA number)").when(F.col("c").isNotNull(), by_name).when(F.col("same_name").isNotNull(), "Yes (same name, location unknown)").otherwise("")
    return out.withColumns({
        "nearest_known": F.coalesce("nearest", F.lit("")), "nearest_km": F.round("nearest_km", 2), "onboarded": verdict,
        "onboarded_as": F.coalesce("id_name", "c.k_name", "same_name", F.lit("")),
    }).drop("_rera", "nearest", "c", "same_name", "id_name")


def register_set(register: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """Set A: registered projects of the right type in the footprint."""
    a = against_known(register.where("type_ok and in_footprint"), known, "key", "name", F.col("rera_no"), 2.0)
    e = found.select(F.col("cid").alias("_cid"), "price", "price_sqft", F.col("possession").alias("market_possession"))
    return a.join(e, F.concat(F.lit("a:"), "key") == F.col("_cid"), "left").drop("_cid").withColumnRenamed("promoter", "builder")


def merged_listings(listings: DataFrame) -> DataFrame:
    """One row per name and locality: all sites, first url, first non-empty value of each field."""
    filled = lambda f: F.min_by(f, F.when(F.coalesce(F.col(f), F.lit("")) != "", F.col("seq"))).alias(f)
    fields = ("builder", "rera_no", "price", "price_sqft", "possession")
    return listings.groupBy(F.concat_ws("|", norm(F.col("name")), norm(F.coalesce("locality", F.lit("")))).alias("lkey")).agg(
        F.min_by("name", "seq").alias("name"), F.min_by("locality", "seq").alias("locality"), F.array_join(F.array_sort(F.collect_set("site")), ", ").alias("sites"),
        F.min_by("url", "seq").alias("url"), *(filled(f) for f in fields), F.min("seq").alias("seq"),
    )


def _unless(own: str, other: str) -> Column:
    """Own value, else the other's; empty counts as none."""
    return F.coalesce(F.nullif(own, F.lit("")), other, F.lit(""))


def listing_set(listings: DataFrame, known: DataFrame, geo: DataFrame, a: DataFrame, radius_km: float) -> DataFrame:
    """Set C: listed projects, located by their locality and matched to set A."""
    box = fixed.DISCOVERY_BOX
    inside = geo.where(F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:])).select(F.col("lkey").alias("place"), "lat", "lon")
    c = merged_listings(listings).withColumn("place", norm(F.col("locality"))).join(inside, "place", "left").drop("place")
    c = against_known(c, known, "lkey", "name", F.col("rera_no"), 3.0).where(F.col("nearest_km").isNull() | (F.col("nearest_km") <= radius_km + 2))
    right = a.select(F.col("key").alias("a_key"), F.col("name").alias("a_name"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("rera_no").alias("a_rera"), F.col("builder").alias("a_builder"),
                     _unless("revised_completion", "proposed_completion").alias("rera_possession"), F.col("onboarded").alias("a_onboarded"), F.col("onboarded_as").alias("a_as"), F.col("seq").alias("a_seq"))
    pairs = token_pairs(c.select("lkey", "name", "lat", "lon"), right, "name", "a_name")
    planar = F.hypot(F.col("lat") - F.col("r_lat"), F.col("lon") - F.col("r_lon")) * 111.0
    pairs = name_similarity(pairs.where(planar.isNull() | (planar <= 3.0)), "name", "a_name", 0.8)
    hit = F.struct("a_key", "a_rera", "a_builder", "rera_possession", "a_onboarded", "a_as")
    best = best_match(pairs, ["lkey"], hit, seq="a_seq").select("lkey", "match.*")
    c = c.join(best, "lkey", "left")
    again = (F.col("onboarded") == "") & (F.coalesce("a_onboarded", F.lit("")) != "")
    return c.withColumns({
        "in_set_a": F.when(F.col("a_key").isNotNull(), "Yes").otherwise("No"), "rera_no": _unless("rera_no", "a_rera"), "builder": _unless("builder", "a_builder"),
        "onboarded": F.when(again, F.col("a_onboarded")).otherwise(F.col("onboarded")), "onboarded_as": F.when(again, F.col("a_as")).otherwise(F.col("onboarded_as")),
    }).drop("a_rera", "a_builder", "a_onboarded", "a_as")


def with_listing_values(a: DataFrame, c: DataFrame) -> DataFrame:
    """Set A with price, possession and url of the first listing matched to each project, blank or not."""
    fields = F.struct(F.col("price").alias("listing_price"), F.col("price_sqft").alias("listing_price_sqft"), F.col("possession").alias("listing_possession"), F.col("url").alias("listing_url"))
    first = c.where("a_key is not null").groupBy(F.col("a_key").alias("key")).agg(F.min_by(fields, "seq").alias("l"))
    return a.join(first, "key", "left").select(*a.columns, "l.*")


def place_set(places: DataFrame, known: DataFrame, found: DataFrame, a: DataFrame, radius_km: float) -> DataFrame:
    """Set B: map places of a building category near known projects, matched to set A within 1.5 km (planar)."""
    p = places.where(F.col("category").rlike(fixed.PLACE_CATEGORIES)).withColumnRenamed("title", "name")
    b = against_known(p, known, "cid", "name", F.lit(""), 1.0).where(F.col("nearest_km") <= radius_km)
    right = a.select(F.col("key").alias("a_key"), F.col("name").alias("a_name"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col("builder").alias("a_builder"), F.col("rera_no").alias("a_rera"),
                     _unless("revised_completion", "proposed_completion").alias("a_possession"), "project_type", F.col("price").alias("a_price"), F.col("onboarded").alias("a_onboarded"), F.col("onboarded_as").alias("a_as"), F.col("seq").alias("a_seq"))
    pairs = name_similarity(radius_pairs(b.select("cid", "name", "lat", "lon"), right, 1.5, planar=True), "name", "a_name", 0.75)
    hit = F.struct("a_key", "a_name", "a_builder", "a_rera", "a_possession", "project_type", "a_price", "a_onboarded", "a_as")
    best = best_match(pairs, ["cid"], hit, seq="a_seq", least=0.75).select("cid", "match.*")
    e = found.select("cid", F.col("builder").alias("e_builder"), F.col("rera_no").alias("e_rera"), F.col("possession").alias("e_possession"), F.col("price").alias("e_price"), F.lit(True).alias("looked"))
    b = b.join(best, "cid", "left").join(e, "cid", "left")
    matched = F.col("a_key").isNotNull()
    same_id = known.where("rera_norm <> ''").select(F.col("rera_norm").alias("e_rera")).distinct().withColumn("known_id", F.lit(True))
    b = b.join(same_id, "e_rera", "left")
    take = lambda x, y: F.coalesce(F.when(matched, F.col(x)).otherwise(F.col(y)), F.lit(""))
    known_a = matched & (F.coalesce("a_onboarded", F.lit("")) != "")
    known_e = ~matched & F.coalesce("known_id", F.lit(False))
    fresh = F.col("onboarded") == ""
    return b.withColumns({
        "builder": take("a_builder", "e_builder"), "rera_no": take("a_rera", "e_rera"), "possession": take("a_possession", "e_possession"),
        "price": F.coalesce(F.when(matched, F.nullif("a_price", F.lit(""))), "e_price", F.lit("")), "in_set_a": F.when(matched, "Yes").otherwise("No"),
        "details_from": F.when(matched, F.concat(F.lit("register ("), "a_name", F.lit(")"))).when(F.col("looked"), "web search").otherwise(""),
        "onboarded": F.when(fresh & known_a, F.col("a_onboarded")).when(fresh & known_e, "Yes (same RERA number)").otherwise(F.col("onboarded")),
        "onboarded_as": F.when(fresh & known_a, F.col("a_as")).otherwise(F.col("onboarded_as")),
        "maps_url": F.concat(F.lit("https://maps.google.com/?cid="), F.col("cid").cast("string")),
    }).drop("e_builder", "e_rera", "e_possession", "e_price", "looked", "known_id", "a_key", "a_name", "a_builder", "a_rera", "a_possession", "a_price", "a_onboarded", "a_as")


def all_new(a: DataFrame, c: DataFrame) -> DataFrame:
    """Every new project: registered ones, then listed ones that are not registered."""
    text = lambda col: F.coalesce(F.col(col).cast("string"), F.lit(""))
    common = lambda: (text("nearest_known").alias("Nearest Known Project"), text("nearest_km").alias("Distance (km)"))
    location = F.array_join(F.filter(F.array(text("locality"), text("village"), text("mandal")), lambda x: x != ""), ", ")
    listed = F.coalesce(F.nullif("listing_url", F.lit("")), F.lit(""))
    one = a.where("onboarded = ''").select(
        text("name").alias("Project Name"), text("builder").alias("Builder"), F.lit("Hyderabad").alias("City"), location.alias("Location"), text("district").alias("District"), text("pin").alias("PIN"),
        text("rera_no").alias("RERA ID"), text("project_type").alias("Project Type"), _unless("listing_price", "price").alias("Price"), _unless("listing_price_sqft", "price_sqft").alias("Price per sq.ft"),
        _unless("revised_completion", "proposed_completion").alias("Possession (RERA)"), _unless("listing_possession", "market_possession").alias("Possession (listing sites)"),
        F.when(listed != "", "RERA register + listing sites").otherwise("RERA register").alias("Found In"), _unless("listing_url", "detail_url").alias("Link"), *common(),
    )
    empty = F.lit("")
    two = c.where("onboarded = '' and in_set_a = 'No'").select(
        text("name").alias("Project Name"), text("builder").alias("Builder"), F.lit("Hyderabad").alias("City"), text("locality").alias("Location"), empty.alias("District"), empty.alias("PIN"),
        text("rera_no").alias("RERA ID"), empty.alias("Project Type"), text("price").alias("Price"), text("price_sqft").alias("Price per sq.ft"), empty.alias("Possession (RERA)"),
        text("possession").alias("Possession (listing sites)"), F.concat(F.lit("listing sites ("), "sites", F.lit(")")).alias("Found In"), text("url").alias("Link"), *common(),
    )
    return one.unionByName(two)


def summary(new: DataFrame) -> DataFrame:
    metrics = {
        "New projects": F.count("*"), "  from the register": F.count_if(F.col("Found In").startswith("RERA")), "  only on listing sites": F.count_if(F.col("Found In").startswith("listing")),
        "  with a price": F.count_if(F.col("Price") != ""), "  with a register number": F.count_if(F.col("RERA ID") != ""),
    }
    return new.agg(*(m.alias(k) for k, m in metrics.items())).unpivot([], list(metrics), "Metric", "Value")


def already_known(a: DataFrame, c: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of all sets that are on file, columns aligned by name."""
    tag = lambda df, t: df.where("onboarded <> ''").withColumn("Set", F.lit(t)).withColumnsRenamed({"name": "Project Name"})
    keep = ["Project Name", "Set", "onboarded", "onboarded_as", "nearest_known", "nearest_km"]
    sets = [tag(a, "A - register").select(*keep, "rera_no"), tag(c, "C - listings").select(*keep, "rera_no", "url"), tag(b, "B - places").select(*keep, "rera_no", "address")]
    return sets[0].unionByName(sets[1], allowMissingColumns=True).unionByName(sets[2], allowMissingColumns=True)


def place_queries(localities: DataFrame, terms=tuple(fixed.PLACE_TERMS)) -> DataFrame:
    """Every term for every locality; the terms are a short list inside the row, so nothing is joined."""
    return localities.select("locality", F.explode(F.array(*map(F.lit, terms))).alias("term")).withColumn("query", F.concat_ws(" ", "term", F.lit("in"), "locality", F.lit("Hyderabad")))


def listing_queries(localities: DataFrame, done: DataFrame) -> DataFrame:
    """Site searches still to do: the normalised locality and site decide, not the spelling."""
    sites = F.explode(F.array(*(F.struct(F.lit(k).alias("site"), F.lit(d).alias("domain")) for k, d in fixed.LISTING_SITES.items()))).alias("s")
    q = localities.select("locality", sites).select("locality", "s.*").withColumns({"lkey": norm(F.col("locality")), "query": F.concat(F.lit("site:"), "domain", F.lit(" "), "locality", F.lit(" Hyderabad"))})
    return q.join(done.select("site", norm(F.col("locality")).alias("lkey")).distinct(), ["site", "lkey"], "left_anti")


def lookup_work(a: DataFrame, b: DataFrame, done: DataFrame) -> DataFrame:
    """Projects worth a web lookup: not on file, and without a listing price (A) or not in A (B)."""
    text = lambda col: F.nullif(F.col(col), F.lit(""))
    one = a.where("onboarded = '' and coalesce(listing_price, '') = ''").select(F.concat(F.lit("a:"), "key").alias("cid"), "name", F.coalesce(text("locality"), text("village"), text("mandal"), F.lit("")).alias("area"))
    two = b.where("onboarded = '' and in_set_a = 'No'").select(F.col("cid").cast("string"), "name", F.col("address").alias("area"))
    return one.unionByName(two).join(done.select(F.col("cid").cast("string")), "cid", "left_anti")
