"""Names, places, hosts and source trust as column expressions; everything stays inside the JVM."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` worked out once, however often it is used: plain reuse of a column would repeat it, inside lambdas for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cell(c: Column) -> Column:
    """Sheet cell: trimmed; null and the usual words for "nothing" become empty."""
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(s).isin(fixed.NULL_WORDS), "").otherwise(s)


def norm(c: Column) -> Column:
    """Lower case, ``&`` as a word, runs of anything but a-z and 0-9 as one space."""
    s = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def squash(c: Column) -> Column:
    return F.replace(norm(c), F.lit(" "), F.lit(""))


def row_key(name: Column, loc: Column, city: Column) -> Column:
    return F.concat_ws("|", norm(name), norm(loc), norm(city))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def host(url: Column) -> Column:
    """Network location in lower case without one leading ``www.``; port and user stay."""
    h = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return F.regexp_replace(h, r"^www\.", "")


def on_domain(h: Column, domains) -> Column:
    return h.rlike(r"(?:^|\.)(?:" + "|".join(map(re.escape, domains)) + r")\z")


def tier(url: Column, anchor: Column | None = None) -> Column:
    """How far a site is trusted: blocked, official, rera-mirror, portal, project-site or other."""

    def of(h: Column) -> Column:
        found = F.when(on_domain(h, fixed.BLOCKED_HOSTS), "blocked")
        found = found.when(h.endswith(".gov.in") | h.endswith(".nic.in") | on_domain(h, fixed.OFFICIAL_HOSTS), "official")
        found = found.when(h.contains("rera"), "rera-mirror").when(on_domain(h, fixed.TRUSTED_PORTALS), "portal")
        if anchor is not None:
            found = found.when((F.length(anchor) >= 6) & F.contains(F.regexp_replace(h, "[-.]", ""), anchor), "project-site")
        return found.otherwise("other")

    return let(host(url), of)


def domain_weight(url: Column) -> Column:
    known = F.regexp_extract(host(url), r"(?:^|\.)(" + "|".join(map(re.escape, fixed.DOMAIN_WEIGHT)) + r")\z", 1)
    weights = F.create_map(*(F.lit(x) for pair in fixed.DOMAIN_WEIGHT.items() for x in pair))
    return let(
        tier(url),
        lambda t: F.when(t == "official", fixed.OFFICIAL_WEIGHT)
        .when(t == "rera-mirror", fixed.MIRROR_WEIGHT)
        .otherwise(F.coalesce(F.try_element_at(weights, known), F.lit(fixed.DEFAULT_WEIGHT))),
    )


def from_register(url: Column) -> Column:
    return tier(url).isin("official", "rera-mirror")


def url_rejected(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    listed = url.rlike("(?i)" + fixed.AGGREGATE_URL) & ~url.contains(fixed.PROJECT_PAGE_MARK)
    return F.when(tier(url) == "blocked", "blocked site").when(listed, "list / search / resale page").otherwise("")


def city_names(city: Column) -> Column:
    """All names of the market that ``city`` belongs to; empty for no city."""
    c = norm(city)
    aliases = F.create_map(*(F.lit(x) for pair in fixed.CITY_ALIASES.items() for x in pair))
    other = F.coalesce(F.try_element_at(aliases, c), c)
    regions: dict[str, list[str]] = {}
    for names in fixed.CITY_REGIONS:
        for n in names:
            regions.setdefault(n, names)
    table = F.map_from_arrays(strings(list(regions)), F.array(*(strings(v) for v in regions.values())))
    found = F.coalesce(F.try_element_at(table, c), F.try_element_at(table, other), F.array_distinct(F.array(c, other)))
    return F.when(c == "", strings([])).otherwise(found)


def names_any(text: Column, names: Column) -> Column:
    return _names_any(norm(text), names)


def _names_any(normed: Column, names: Column) -> Column:
    padded = F.concat(F.lit(" "), normed, F.lit(" "))
    return let(padded, lambda p: F.exists(names, lambda n: F.contains(p, F.concat(F.lit(" "), n, F.lit(" ")))))


def city_conflict(text: Column, city: Column) -> Column:
    """The text names a known city, but none of the row's market."""
    ours, every = city_names(city), strings(sorted({n for names in fixed.CITY_REGIONS for n in names}))
    return let(F.struct(norm(text).alias("n"), ours.alias("ours")), lambda x: (F.size(x["ours"]) > 0) & ~_names_any(x["n"], x["ours"]) & _names_any(x["n"], F.array_except(every, x["ours"])))


def matcher(name: Column, loc: Column, city: Column, ids: Column) -> Column:
    """What identifies an entity in text, as one struct: weighted tokens, anchor word, places and registration numbers."""
    words = F.filter(F.split(norm(name), " "), lambda t: (t != "") & ~t.isin(fixed.STOP_WORDS) & ((F.length(t) > 1) | t.rlike("^[0-9]$")))
    generic = lambda t: t.isin(fixed.GENERIC_WORDS) | t.rlike("^[0-9]+$")
    own = F.filter(words, lambda t: ~generic(t))
    pick = F.when(F.size(own) > 0, own).otherwise(words)
    anchor = F.aggregate(pick, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    aliases = fixed.CITY_ALIASES | {v: k for k, v in fixed.CITY_ALIASES.items()}
    alias = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    places = F.flatten(F.transform(F.array(norm(loc), norm(city)), lambda p: F.filter(F.array(p, F.coalesce(F.try_element_at(alias, p), F.lit(""))), lambda x: (p != "") & (x != ""))))
    long_ids = F.filter(F.coalesce(ids, strings([])), lambda i: F.length(squash(i)) >= 6)
    weights = F.transform(words, lambda t: F.struct(t.alias("t"), F.when(generic(t), 0.5).otherwise(1.0).alias("w")))
    return F.struct(
        weights.alias("tokens"),
        F.aggregate(weights, F.lit(0.0), lambda a, t: a + t["w"]).alias("total"),
        F.array_join(words, "").alias("squashed"),
        anchor.alias("anchor"),
        ((F.size(own) <= 1) & (F.length(anchor) <= 5)).alias("weak"),
        (F.size(own) <= 1).alias("single"),
        places.alias("places"),
        norm(loc).alias("locality"),
        F.coalesce(city, F.lit("")).alias("city"),
        F.transform(long_ids, squash).alias("ids"),
        long_ids.alias("raw_ids"),
    )


def id_in(text: Column, m: Column) -> Column:
    return let(squash(text), lambda sq: F.exists(m["ids"], lambda i: F.contains(sq, i)))


def name_score(text: Column, m: Column) -> Column:
    """0 to 1: how surely ``text`` talks about the entity of ``m``."""

    def score(x: Column) -> Column:
        words, sq = x["words"], x["sq"]
        hit = F.aggregate(m["tokens"], F.lit(0.0), lambda a, t: a + F.when(F.array_contains(words, t["t"]) | ((F.length(t["t"]) >= 6) & F.contains(sq, t["t"])), t["w"]).otherwise(0.0))
        base = F.when((F.length(m["squashed"]) >= 6) & F.contains(sq, m["squashed"]), 1.0).otherwise(hit / F.when(m["total"] > 0, m["total"]).otherwise(1.0))
        placed = (F.size(m["places"]) == 0) | _names_any(x["n"], m["places"])
        factor = F.when(placed, 1.0).when(m["weak"], 0.8 * 0.6).otherwise(0.8)
        return F.when(F.size(m["tokens"]) == 0, 0.0).when(F.exists(m["ids"], lambda i: F.contains(sq, i)), 1.0).otherwise(base * factor)

    parts = lambda n: F.struct(n.alias("n"), F.split(n, " ").alias("words"), F.replace(n, F.lit(" "), F.lit("")).alias("sq"))
    return let(norm(text), lambda n: let(parts(n), score))


def place_in(text: Column, m: Column) -> Column:
    """The locality is named; the city where there is no telling word in the locality."""
    words = F.split(norm(text), " ")
    telling = F.filter(F.split(m["locality"], " "), lambda t: (F.length(t) >= 4) & ~t.isin(fixed.PLACE_FILLER))
    c = norm(m["city"])
    return F.when(F.size(telling) > 0, F.arrays_overlap(telling, words)).otherwise((c != "") & F.contains(norm(text), c))


def id_shape(i: Column) -> Column:
    """Pattern for other registration numbers of the same form."""
    parts = F.regexp_extract_all(i, F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    rx = F.transform(
        parts,
        lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit(r"\d{"), F.length(p).cast("string"), F.lit("}"))).when(p.rlike("^[A-Za-z]"), p).otherwise(r"\s*[/\-]?\s*"),
    )
    return F.concat(F.lit(r"(?i)(?<![A-Za-z\d])"), F.array_join(rx, ""), F.lit(r"(?!\d)"))


def id_conflict(text: Column, m: Column) -> Column:
    """Numbers of our form stand in the first 8,000 characters, ours nowhere."""
    head = F.substring(text, 1, 8000)
    return ~id_in(text, m) & F.exists(m["raw_ids"], lambda i: F.regexp_like(head, id_shape(i)))


def sectors(normed: Column) -> Column:
    return F.regexp_extract_all(normed, F.lit(r"\bsector (\d{1,3}[a-z]?)\b"), F.lit(1))


def sector_conflict(text: Column, m: Column) -> Column:
    ours, theirs = sectors(m["locality"]), sectors(norm(text))
    return (F.size(ours) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(ours, theirs)


def joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))


def reject_reason(url: Column, title: Column, text: Column, m: Column) -> Column:
    """First reason why a page says nothing about the entity, or empty."""
    by_url, head = url_rejected(url), joined(title, url)
    return (
        F.when(by_url != "", by_url)
        .when(F.coalesce(title, F.lit("")).rlike("(?i)" + fixed.AGGREGATE_TITLE), "list page")
        .when(city_conflict(head, m["city"]), "different city")
        .when(id_conflict(text, m), "different RERA number")
        .when(m["single"] & ~place_in(joined(head, F.substring(text, 1, 6000)), m), "common name, locality not on page")
        .otherwise("")
    )


def trusted(url: Column, title: Column, m: Column) -> Column:
    return tier(url, m["anchor"]).isin(fixed.TRUSTED_TIERS) & ~sector_conflict(joined(title, url), m)


def dedicated(title: Column, text: Column, m: Column) -> Column:
    """How surely the page is about this one entity: the name opens the title; 0 if not."""
    s = name_score(F.substring(title, 1, 110), m)
    return F.when(id_in(text, m), F.when(s >= 0.5, 1.0).otherwise(0.0)).when(s >= 0.8, s).otherwise(0.0)


def split_ids(v: Column) -> Column:
    """Registration numbers of a cell, without "dated ..." remarks."""
    v = F.regexp_replace(F.coalesce(v, F.lit("")), r"(?i)\s+dated\b[^|,;\n]*", "")
    return F.filter(F.transform(F.split(v, r"[|,;\n]+|\s+(?:I|l|and|&)\s+"), lambda p: F.trim(p)), lambda x: F.length(x) >= 5)


def short_locality(address: Column, city: Column) -> Column:
    """Last part of an address that names a locality: no state, city, number or street."""
    c = norm(city)
    aliases = fixed.CITY_ALIASES | {v: k for k, v in fixed.CITY_ALIASES.items()}
    other = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), c), c)
    digits = lambda p: p.rlike("[0-9]") & ~p.rlike(r"(?i)^sector[\s\-]*\d+[a-z]?$")
    parts = F.filter(
        F.transform(F.split(address, ","), lambda p: F.trim(p)),
        lambda p: (norm(p) != "") & ~norm(p).isin(fixed.STATES) & (norm(p) != c) & (norm(p) != other) & ~digits(p) & ~p.rlike(fixed.ADDRESS_NOISE),
    )
    narrow = F.filter(parts, lambda p: ~norm(p).isin(fixed.CITY_LIKE))
    last = F.coalesce(F.try_element_at(narrow, F.lit(-1)), F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.when(F.coalesce(address, F.lit("")) == "", "").when(~address.contains(","), F.substring(address, 1, 60)).otherwise(last)


def city_from_address(address: Column) -> Column:
    """The part before the state, without plus codes and PIN."""
    parts = F.filter(F.transform(F.split(F.coalesce(address, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    state = lambda p: norm(F.regexp_replace(p, "[0-9]", " ")).isin([s for s in fixed.STATES if s not in ("india", "delhi")])
    at = F.array_min(F.filter(F.transform(parts, lambda p, i: F.when(state(p), i)), lambda i: i.isNotNull()))
    before = F.transform(F.slice(parts, 1, F.greatest(at, F.lit(0))), lambda p: F.trim(F.regexp_replace(p, r"(?i)\b[23456789CFGHJMPQRVWX]{4,8}\+[23456789CFGHJMPQRVWX]{2,3}\b", "")))
    named = F.filter(before, lambda p: (p != "") & ~p.rlike(r"^[\d\s\-/]+$"))
    return F.coalesce(F.when(at.isNotNull(), F.regexp_replace(F.try_element_at(named, F.lit(-1)), r"\s*\d{6}$", "")), F.lit(""))


def not_a_project(name: Column) -> Column:
    name = F.coalesce(name, F.lit(""))
    return F.when(name.rlike(r"(?i)^[0-9A-F]{16,}\b|\bPG for\b|\bpaying guest\b"), "PG / paying-guest listing").otherwise("")


def clean_name(name: Column) -> Column:
    name = F.regexp_replace(name, r"(?i)\s*[-(]?\s*\bsite\s+visit\b\s*\)?\s*$", "")
    return F.trim(F.regexp_replace(name, r"(?i)^\s*(?:bank\s+)?auction\s+(?:propert(?:y|ies)|bazaar)\s*[-:|]\s*", ""))


def title_case(n: Column) -> Column:
    """Names in capitals with the first letter of each word only; others as they are."""
    words = F.split(F.lower(n), r"(?<![a-z])(?=[a-z])")
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")
    return F.when((n == F.upper(n)) & (n != F.lower(n)), titled).otherwise(n)


def clean_locality(n: Column) -> Column:
    n = F.regexp_replace(squeeze(F.regexp_replace(F.coalesce(n, F.lit("")), fixed.LOCALITY_SUFFIX, " ")), r"^[ ,\-]+|[ ,\-]+$", "")
    return F.when((n == "") | n.rlike(fixed.LOCALITY_JUNK) | (F.length(n) > 26) | (F.length(norm(n)) < 4), "").otherwise(n)


def word_positions(text: Column, word: Column, most: int | None = None) -> Column:
    """Where ``word``, which isn't empty, stands in the text without overlaps; the first ``most`` places."""
    gaps = F.split(text, F.concat(F.lit(r"\Q"), word, F.lit(r"\E")), -1)
    many = F.size(gaps) - 1
    gaps = F.slice(gaps, F.lit(1), many if most is None else F.least(many, F.lit(most)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda a, gap: F.struct((a["at"] + F.length(gap) + F.length(word)).alias("at"), F.concat(a["found"], F.array(a["at"] + F.length(gap))).alias("found"))
    return F.aggregate(gaps, start, step, lambda a: a["found"])


def occurrences(text: Column, rx: str) -> Column:
    """Non-overlapping matches as ``array<struct<pos, match>>``, pos from 0.

    The text is read once for its matches and, where there are any, once for the gaps before them. (``split`` would
    compile the pattern again for each row.)
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,match:string>>").alias("found"))

    def walked(hits: Column) -> Column:
        gaps = F.regexp_extract_all(text, F.lit(rf"\G(?s:(.*?))(?:{rx})"), F.lit(1))
        found = F.aggregate(
            F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
            start,
            lambda a, p: F.struct(
                (a["at"] + F.length(p["gap"]) + F.length(p["hit"])).alias("at"),
                F.concat(a["found"], F.array(F.struct((a["at"] + F.length(p["gap"])).alias("pos"), p["hit"].alias("match")))).alias("found"),
            ),
            lambda a: a["found"],
        )
        return F.when(F.size(hits) > 0, found).otherwise(start["found"])

    return let(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), walked)


def between(text: Column, a: Column, b: Column) -> Column:
    """Characters a (from 0) up to b, cut to the text."""
    a = F.greatest(a, F.lit(0))
    return F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))


def html_text(html: Column) -> Column:
    """``struct<title, text>`` of a page: scripts and the like dropped, tags as spaces, common references decoded."""
    html = F.coalesce(html, F.lit(""))

    def plain(c: Column) -> Column:
        c = F.regexp_replace(c, "(?s)<[^>]*>", " ")
        for ref, char in (("&nbsp;|&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;|&#34;", '"'), ("&#39;|&apos;", "'"), ("&#8377;|&#x20[bB]9;", "₹"), ("&amp;", "&")):
            c = F.regexp_replace(c, ref, char)
        return squeeze(c)

    title = plain(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))
    h1 = F.regexp_extract(html, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>", 1)
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|svg|iframe)\b.*?(?:</\1\s*>|\z)", " ")
    return F.struct(F.when(html.rlike(r"(?i)<h1[\s>]"), F.concat(title, F.lit(" | "), plain(h1))).otherwise(title).alias("title"), plain(body).alias("text"))
