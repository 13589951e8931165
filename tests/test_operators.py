"""Fusion, joins, state and plans against worked examples and brute force."""

import datetime as dt
import math
import random
import tempfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators import nearest
from evidentia.operators import evidence, fusion, matching, review, state
from evidentia.plans import discovery, enrich, report
from evidentia.session import materialize
from evidentia.sources import recorded, sheet
from evidentia.streaming.ingest import CANDIDATES

TODAY = dt.date(2025, 6, 15)


def cand(seq, domain, key, score, trusted=False, kind="possession", gkey="g"):
    y, m = int(key[:4]), int(key[5:]) if len(key) == 7 else None
    return (gkey, f"https://{domain}/{seq}", domain, y, m, "month" if m else "year", kind, float(score), "ctx", False, trusted, "page", seq)


def fused(spark, rows):
    return fusion.date_fusion(spark.createDataFrame(rows, CANDIDATES), TODAY).collect()


def test_date_fusion(spark):
    rows = [cand(1, "housing.com", "2025-12", 0.9, True, "structured"), cand(2, "99acres.com", "2025-12", 0.6, True), cand(3, "blog.in", "2026-02", 0.3)]
    (v,) = fused(spark, rows)
    assert (v.iso, v.confidence, v.label, v.sources, v.display, v.status) == ("2025-12", 0.92, "High", 2, "Dec 2025", "Under Construction")
    assert v.alternatives == "Feb 2026 (1 src)" and v.evidence == "[page] ctx"
    (v,) = fused(spark, [cand(1, "d1", "2025-12", 0.5, True), cand(2, "d2", "2025", 0.4)])
    assert (v.iso, v.sources, v.confidence, v.label) == ("2025-12", 2, 0.49, "Medium")
    (v,) = fused(spark, [cand(1, "d1", "2025-12", 0.9), cand(2, "d2", "2025-12", 0.9)])
    assert v.label == "Low" and v.note
    assert fused(spark, []) == []


def test_fusion_ignores_row_order(spark):
    rng = random.Random(3)
    rows = [cand(i, f"d{i % 4}", f"20{rng.randint(20, 27)}-{rng.randint(1, 12):02d}" if i % 5 else "2024", rng.random(), i % 3 == 0, gkey=f"g{i % 7}") for i in range(200)]
    a = fused(spark, rows)
    rng.shuffle(rows)
    b = fused(spark, rows)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert all(0 <= v.confidence <= 1 for v in a)


def test_price_fusion(spark):
    schema = "gkey string, lo double, hi double, kind string, url string, domain string, trusted boolean, weight double, origin string, context string, per_sqft int, seq long"
    rows = [("g", 1e7, 1.2e7, "page data", "u1", "housing.com", True, 0.9, "page data", "c", 7500, 1), ("g", 1.15e7, 1.15e7, "range", "u2", "99acres.com", True, 0.9, "page", "c", 0, 2),
            ("wide", 2.75e7, 16.8e7, "range", "u3", "housing.com", True, 0.9, "page", "c", 0, 3), ("sqft", 0.0, 0.0, "per sq.ft only", "u4", "makaan.com", True, 0.8, "page", "c", 6000, 4)]
    v = {r.gkey: r for r in fusion.price_fusion(spark.createDataFrame(rows, schema)).collect()}
    assert (v["g"].price_display, v["g"].price_label, v["g"].price_sqft, v["g"].price_min) == ("₹1 Cr - ₹1.2 Cr", "High", "₹7,500/sq.ft", 10_000_000)
    assert v["g"].price_alternatives == "₹1.15 Cr (99acres.com)"
    assert v["wide"].price_label == "Low" and "very wide range" in v["wide"].price_evidence
    assert (v["sqft"].price_label, v["sqft"].price_min, v["sqft"].price_sqft) == ("Medium", None, "₹6,000/sq.ft")


def test_registry_summary(spark):
    pairs = spark.createDataFrame([("g", (2018, 12), (2020, 6), "u", True, 1.0, "t", 1)], "gkey string, orig struct<y:int,m:int>, rev struct<y:int,m:int>, url string, id_match boolean, relevance double, text string, seq long")
    (r,) = fusion.registry_summary(spark.createDataFrame([], CANDIDATES), pairs, TODAY).collect()
    assert (r.rera_current_iso, r.extension_found) == ("2020-06", "Yes - extended Dec 2018 -> Jun 2020")


def test_name_similarity(spark):
    names = ["Green Valley", "Dhruv Valley", "Prestige Lakeside Habitat", "Lakeside Habitat by Prestige", "Towers", "", "My Home Bhooja"]
    rows = [(a, b) for a in names for b in names]

    def brute(a, b):
        ta, tb = ([t for t in "".join(c if c.isalnum() else " " for c in x.lower()).split() if t not in set(T.fixed.SIMILARITY_GENERIC)] for x in (a, b))
        if not ta or not tb:
            return 0.0
        x, y = " ".join(ta), " ".join(tb)
        inside = 0.9 if min(len(x), len(y)) >= 5 and (x in y or y in x) else 0.0
        return max(len({*ta} & {*tb}) / len({*ta} | {*tb}), SequenceMatcher(None, x, y).ratio(), inside)

    got = matching.name_similarity(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    for r in got:
        assert r.sim == pytest.approx(brute(r.a, r.b)), (r.a, r.b)


def test_radius_and_nearest(spark):
    rng = random.Random(1)
    at = lambda n: [(i, rng.uniform(8, 30), rng.uniform(70, 90)) for i in range(n)]
    a, b = at(60), at(80)
    left, right = spark.createDataFrame(a, "k int, lat double, lon double"), spark.createDataFrame(b, "r int, r_lat double, r_lon double")

    def km(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    assert {(r.k, r.r) for r in matching.radius_pairs(left, right, 150).collect()} == {(p[0], q[0]) for p in a for q in b if km(p, q) <= 150}
    assert {(r.k, r.r) for r in matching.radius_pairs(left, right, 150, planar=True).collect()} == {(p[0], q[0]) for p in a for q in b if math.dist(p[1:], q[1:]) * 111 <= 150}
    assert {r.k: r.nearest for r in nearest.nearest(left, right, "k", "r").collect()} == {p[0]: min(b, key=lambda q: km(p, q))[0] for p in a}  # noqa: B023


def test_state(spark):
    costs = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 1.0)], "k int, c double")
    assert [r.k for r in state.budget_prefix(costs, F.col("c"), 7, [F.asc("k")], F.floor(F.col("k") / 2)).collect()] == [1]
    rows = spark.createDataFrame([(0, "x", True, "High", "2025-01", "t1"), (1, "x", False, "Not found", "", "t2"), (2, "y", False, "Low", "", "t3")], "row_idx int, rkey string, found boolean, label string, iso string, updated string")
    assert [(r.row_idx, r.iso) for r in state.propagate_found(rows).orderBy("row_idx").collect()] == [(0, "2025-01"), (1, "2025-01"), (2, "")]
    assert [r.row_idx for r in state.done_rows(rows, "missing").collect()] == [0]


def test_review(spark):
    got = [tuple(r[0]) for r in spark.createDataFrame([("2025-12",), ("2025",), ("soon",), ("2025-13",)], "v string").select(review.normalise_verdict(F.col("v"))).collect()]
    assert got == [("2025-12", "Dec 2025"), ("2025", "2025"), ("", ""), ("", "")]


def test_columns_and_queries(spark):
    roles = sheet.detect_columns(["Building Name", "Locality", "City", "Latitude", "Longitude", "RERA ID", "Completion Date", "longMinPrice", "longMaxPrice"])
    assert roles == {"name": "Building Name", "locality": "Locality", "city": "City", "lat": "Latitude", "lon": "Longitude", "rera": "RERA ID", "existing": "Completion Date", "min_price": "longMinPrice", "max_price": "longMaxPrice"}
    with pytest.raises(ValueError, match="building name"):
        sheet.detect_columns(["x"])


SHEET = [
    (0, "Prestige Lakeside Habitat", "Varthur", "Bangalore", "", "", "PRM123456", "Dec 2025", "8000000", ""),
    (1, "prestige lakeside habitat", "Varthur", "Bangalore", "", "", "PRM123456", "", "", ""),
    (2, "PG for men", "Varthur", "Bangalore", "", "", "", "", "", ""),
    (3, "", "", "", "", "", "", "", "", ""),
]
PLH = "Prestige Lakeside Habitat Varthur Bangalore"


def test_enrich_end_to_end(spark):
    raw = spark.createDataFrame(SHEET, "row_idx int, `Building Name` string, Locality string, City string, Latitude string, Longitude string, `RERA ID` string, `Completion Date` string, longMinPrice string, longMaxPrice string")
    roles = sheet.detect_columns([c for c in raw.columns if c != "row_idx"])
    e = sheet.entities(raw, roles)
    queries = sheet.search_queries(e, "full").cache()
    texts = [r.query for r in queries.orderBy("q").collect()]
    assert len(texts) == 4 and texts[0] == f"{PLH} price possession" and texts[2] == '"PRM123456"'
    results = [
        (PLH, "https://housing.com/in/buy/projects/page/1-plh", "Possession by Dec 2025. Rs 80 L - 1.2 Cr"),
        (f"{PLH} review", "https://www.99acres.com/plh", "possession date Dec 2025, Rs 82 L onwards"),
        ("10 projects in Bangalore", "https://housing.com/projects-in-bangalore", "Possession by Jan 2030"),
    ]
    cache = spark.createDataFrame([(texts[0], results)], "q string, results array<struct<title:string,url:string,snippet:string>>")
    html = f"<html><title>{PLH}</title><body><h1>{PLH}</h1><script>{{\"possessionDate\": \"2025-12-31\"}}</script><p>{PLH}: Possession by Dec 2025</p></body></html>"
    pages = spark.createDataFrame([("https://housing.com/in/buy/projects/page/1-plh", html)], "url string, html string")
    rows = materialize(enrich.enrich(e, cache, pages, queries, "full", TODAY), "rows")
    out = {r.row_idx: r for r in rows.collect()}
    for i in (0, 1):
        assert (out[i].iso, out[i].label, out[i].price_label, out[i].price_display) == ("2025-12", "High", "High", "₹80 L - ₹1.2 Cr")
        assert out[i].queries == 1
    assert (out[2].label, out[3].label, out[3].note) == ("Skipped", "Not found", "empty building name")
    assert recorded.uncached(queries, cache).count() == 3
    r = report.full_report(rows, TODAY).where("row_idx = 0").first()
    assert (r["Possession Date"], r["Web vs Sheet (date)"], r["Web vs Sheet (price)"], r["Sheet Price"]) == ("Dec 2025", "Match", "Match (within 15%)", "₹80 L")
    assert {r.Metric: r.Value for r in report.summary(rows).collect()}["Dates confirmed (High or Medium)"] == 2


def test_register_texts(spark):
    cert = "registration number : P02200003775 Project: X , Survey No.: 1, at Kukatpally, Kukatpally, Medchal- Malkajgiri, 500090; valid ending with 31/12/2027"
    c = spark.range(1).select(recorded.register_certificate(F.lit(cert)).alias("c")).first().c
    assert (c.rera_from_cert, c.locality, c.mandal, c.district, c.pin, c.proposed_completion) == ("P02200003775", "Kukatpally", "Kukatpally", "Medchal-Malkajgiri", "500090", "31/12/2027")
    page = "Project Information Project Type Residential Project Status New Project Approved Date 01/02/2022 Proposed Date of Completion 31/12/2026 Address Details District Hyderabad Mandal Ameerpet Village/City/Town Begumpet Street NA Locality Somajiguda Pin Code 500082"
    d = spark.range(1).select(recorded.register_detail(F.lit(page)).alias("d")).first().d
    assert (d.project_type, d.status, d.proposed_completion, d.district, d.mandal, d.village, d.street, d.locality, d.pin) == ("Residential", "New Project", "31/12/2026", "Hyderabad", "Ameerpet", "Begumpet", "", "Somajiguda", "500082")
    body = '{"organic": [{"title": "A", "link": "https://a", "snippet": "b <b>c</b>"}]}'
    assert [tuple(x) for x in spark.range(1).select(recorded.json_results(F.lit(body), "serper")).first()[0]] == [("A", "https://a", "b c")]
    listing = spark.range(1).select(recorded.listing_fields(F.lit("housing"), F.lit("https://housing.com/in/buy/projects/page/12-my-home-by-my-home-group-in-kokapet"), F.lit("My Home in Kokapet, Hyderabad"))).first()[0]
    assert tuple(listing) == ("my home", "Kokapet", "my home group")


def test_discovery(spark):
    known = spark.createDataFrame([("Green Valley", 17.40, 78.40, "P02400000001", 1), ("Blue Ridge Habitat", 17.45, 78.45, "", 2)], "building_name string, lat double, lon double, rera_norm string, seq long")
    register = spark.createDataFrame(
        [("a1", "Emerald Crest", "Crest Builders", 17.41, 78.41, "P02400000009", True, True), ("a2", "Anything", "B", 17.42, 78.41, "P02400000001", True, True), ("a3", "Blue Ridge Habitat", "C", 17.4501, 78.4501, "", True, True)],
        "key string, name string, promoter string, lat double, lon double, rera_no string, type_ok boolean, in_footprint boolean",
    )
    for c in ("revised_completion", "proposed_completion", "project_type", "locality", "village", "mandal", "district", "pin", "detail_url"):
        register = register.withColumn(c, F.lit(c[:3]))
    register = register.withColumn("seq", F.substring("key", 2, 1).cast("long"))
    found = spark.createDataFrame([("a:a1", "", "", "", "₹1 Cr", "")], "cid string, builder string, rera_no string, possession string, price string, price_sqft string")
    a = discovery.register_set(register, known, found)
    assert {r.key: r.onboarded for r in a.collect()} == {"a1": "", "a2": "Yes (same RERA number)", "a3": "Yes (name match 1.00, 0.0 km)"}
    listings = spark.createDataFrame(
        [(1, "u1", "housing", "Emerald Crest", "Kokapet", "", "", "", "", "Dec 2026"), (2, "u2", "99acres", "emerald crest", "Kokapet", "Crest", "", "₹90 L", "", ""), (3, "u3", "housing", "Sunny Meadow", "Kokapet", "", "", "₹70 L", "", "")],
        "seq long, url string, site string, name string, locality string, builder string, rera_no string, price string, price_sqft string, possession string",
    )
    geo = spark.createDataFrame([("kokapet", 17.41, 78.40)], "lkey string, lat double, lon double")
    c = discovery.listing_set(listings, known, geo, a, 3.0)
    got = {r.name: r for r in c.collect()}
    assert (got["Emerald Crest"].sites, got["Emerald Crest"].in_set_a, got["Emerald Crest"].price, got["Sunny Meadow"].in_set_a) == ("99acres, housing", "Yes", "₹90 L", "No")
    a2 = discovery.with_listing_values(a, c)
    new = discovery.all_new(a2, c)
    assert {(r["Project Name"], r["Found In"]) for r in new.collect()} == {("Emerald Crest", "RERA register + listing sites"), ("Sunny Meadow", "listing sites (housing)")}
    places = spark.createDataFrame([("c1", "Emerald Crest Apartments", "Apartment building", "x", 17.411, 78.411, 4.1, 10, "q"), ("c2", "Cafe", "Cafe", "x", 17.41, 78.41, 4.1, 10, "q")], "cid string, title string, category string, address string, lat double, lon double, rating double, reviews int, query string")
    b = discovery.place_set(places, known, found, a, 3.0).collect()
    assert [(r.cid, r.in_set_a, r.rera_no, r.price) for r in b] == [("c1", "Yes", "P02400000009", "₹1 Cr")]
    done = discovery.already_known(a, c, discovery.place_set(places, known, found, a, 3.0))
    assert {r.Set for r in done.collect()} == {"A - register"}


def test_evidence_pack_and_pages(spark):
    m = T.matcher(F.lit("Green Valley"), F.lit("Kokapet"), F.lit("Hyderabad"), T.strings([]))
    rows = [("g", 0, f"https://s{i}.com/p", "Green Valley Kokapet", "Hyderabad", i) for i in range(20)]
    r = spark.createDataFrame(rows, "gkey string, q int, url string, title string, snippet string, seq long").withColumn("m", m)
    assert evidence.pick_pages(r).count() == 3
    c = spark.createDataFrame([cand(i, "d", "2025-12", i / 100) for i in range(30)], CANDIDATES)
    pack = evidence.evidence_pack(r, c).first()
    assert len(pack.snippets) == 12 and [d.score for d in pack.dates] == [round(i / 100, 2) for i in range(29, 14, -1)]


def test_register_pairs_and_listing_sites(spark):
    """Changed completion dates near the name, and one page of each listing site."""
    m = T.matcher(F.lit("Green Valley"), F.lit("Kokapet"), F.lit("Hyderabad"), T.strings([]))
    text = "Green Valley Kokapet. Original Completion Date: 31-12-2024 Revised Proposed Date of Completion: 30/06/2026. Revised completion 01/01/2030"
    page = spark.createDataFrame([("g", "https://x.in/p", "Green Valley", text, 3)], "gkey string, url string, title string, text string, seq long").withColumn("m", m)
    pairs = evidence.register_pairs(page, TODAY).collect()
    assert [(tuple(p.orig), tuple(p.rev), p.relevance, p.seq) for p in pairs] == [((2024, 12), (2026, 6), 1.0, 3000)]
    rows = [
        ("squareyards", "https://www.squareyards.com/hyderabad-residential-property/lake-view/123/project", "Lake View, Kokapet, Hyderabad - Price List"),
        ("magicbricks", "https://www.magicbricks.com/lake-view-pdpid-4d42", "Lake View Price in Kokapet, Hyderabad"),
        ("99acres", "https://www.99acres.com/lake-view-kokapet-npxid-r1", "Lake View Kokapet, Hyderabad"),
        ("99acres", "https://www.99acres.com/search", "Flats"),
    ]
    frame = spark.createDataFrame(rows, "site string, url string, title string")
    got = [r[0] and tuple(r[0]) for r in frame.select(recorded.listing_fields(F.col("site"), F.col("url"), F.col("title"))).collect()]
    assert got == [("Lake View", "Kokapet", ""), ("Lake View", "Kokapet", ""), ("Lake View Kokapet", "", ""), None]
    none = spark.range(1).select(recorded.register_detail(F.lit("no labels")).alias("d"), recorded.register_certificate(F.lit("")).alias("c"), recorded.register_number(F.lit("P 0240 0000 123"))).first()
    assert set(none.d) == {""} and set(none.c) == {""} and none[2] == "P02400000123"


def test_copies_of_names_in_reach_are_compared_once(spark, monkeypatch):
    left = spark.createDataFrame([(i, ["Anika Heights", "Sai Residency", None][i % 3], 17.0 + i % 2, 78.0) for i in range(60)], "k long, name string, lat double, lon double")
    right = spark.createDataFrame([(900 - i, ["Anika Height", "Anika Hights", "Sai Residence", None][i % 4], 17.0 + i % 2, 78.001) for i in range(400)], "rk long, r_name string, r_lat double, r_lon double")
    pairs = matching.name_similarity(matching.radius_pairs(left, right, 25.0, True), "name", "r_name", 0.5)
    want = matching.best_match(pairs, ["k"], F.col("rk"), seq="rk", least=0.5)
    seen, plain = [], matching.name_similarity
    monkeypatch.setattr(matching, "name_similarity", lambda p, *a: seen.append(p.count()) or plain(p, *a))
    got = matching.best_in_radius(left, right, "k", "name", "rk", "r_name", 25.0, 0.5, True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 30
    assert seen[0] < 40


def test_register_dates_carry_no_other_columns(spark, monkeypatch):
    seen, plain = [], fusion.best_per_url
    monkeypatch.setattr(fusion, "best_per_url", lambda c: seen.append(c.columns) or plain(c))
    fusion.date_fusion(spark.createDataFrame([], CANDIDATES), dt.date(2025, 6, 15))
    assert sorted(seen[-1]) == ["gkey", "month", "precision", "score", "seq", "url", "year"]


def dated(spark, n):
    rng = random.Random(5)
    rows = [cand(i, f"d{rng.randrange(9)}", f"20{rng.randint(20, 27)}-{rng.randint(1, 12):02d}" if i % 4 else f"20{rng.randint(20, 29)}", rng.randrange(1, 10) / 10, i % 3 == 0, gkey=f"g{i % 7 if i % 2 else 0}") for i in range(n)]
    return spark.createDataFrame([(*r[:9], i % 5 == 0, *r[10:]) for i, r in enumerate(rows)], CANDIDATES)


def test_candidates_are_dealt_once_for_dates(spark):
    v = fusion.date_fusion(dated(spark, 600), TODAY)
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # all candidates, and those of the register


def test_crowded_entities_get_the_same_verdicts(spark):
    df = dated(spark, 600)
    assert fusion.crowded(df, 100) == [r[0] for r in df.where("gkey = 'g0'").select(F.xxhash64("gkey")).distinct().collect()]
    plain, apart = (sorted(map(str, fusion.date_fusion(df, TODAY, limit=n).collect())) for n in (1000, 100))
    assert plain == apart and len(plain) == 7


def test_names_in_reach_are_bounded_before_they_are_compared(spark, monkeypatch):
    rng = random.Random(8)
    words = ["Anika", "Anikka", "Heights", "Height", "Sai", "Residency", "Lake", "View", "Lakeview", "Towers", "Pvt", "Züri", "12", "no 7"]
    fixed_ones = ["", None, "The", "x", "Lake " * 30 + "Gardens", "q" * 300, "q" * 299 + "z", "q" * 70, "Sai Sai Residency"]
    name = lambda: rng.choice(fixed_ones) if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randint(1, 4))) + str(rng.randrange(40))
    place = lambda: (17.0 + rng.randrange(4) * 0.15, 78.0 + rng.randrange(4) * 0.15) if rng.random() < 0.95 else (None, 78.0)
    left = spark.createDataFrame([(i, name(), *place()) for i in range(80)], "k long, name string, lat double, lon double")
    right = spark.createDataFrame([(900 - i, name(), *place()) for i in range(300)], "rk long, r_name string, r_lat double, r_lon double")
    # Names that are wholly apart have 0 in common, which 0 allows.
    for planar, least in ((True, 0.5), (False, 0.8), (True, 0.0)):
        pairs = matching.name_similarity(matching.radius_pairs(left.where("name is not null"), right, 25.0, planar), "name", "r_name", least)
        want = matching.best_match(pairs, ["k"], F.col("rk"), seq="rk", least=least)
        with monkeypatch.context() as m:
            seen, plain = [], matching.name_similarity
            m.setattr(matching, "name_similarity", lambda p, *a, seen=seen, plain=plain: seen.append(p.count()) or plain(p, *a))
            got = matching.best_in_radius(left, right, "k", "name", "rk", "r_name", 25.0, least, planar)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 10
        assert seen[0] < pairs.count() / 3
    small = matching.best_in_blocks(left, right, "name", "rk", "r_name", 25.0, 0.5, True, block=16)
    best = matching.best_match(matching.name_similarity(small, "name", "r_name", 0.5), ["name", "lat", "lon"], F.col("rk"), seq="rk", least=0.5)
    whole = matching.best_in_blocks(left, right, "name", "rk", "r_name", 25.0, 0.5, True)
    same = matching.best_match(matching.name_similarity(whole, "name", "r_name", 0.5), ["name", "lat", "lon"], F.col("rk"), seq="rk", least=0.5)
    assert sorted(map(str, best.collect())) == sorted(map(str, same.collect())) and small.count() > whole.count()
