"""Scalar functions on worked examples."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidentia.functions import dates, geo, money
from evidentia.functions import text as T

TODAY = dt.date(2025, 6, 15)


def values(spark, inputs, *columns, schema="v string"):
    return [tuple(r) for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in inputs], schema).select(*columns).collect()]


def test_names_and_hosts(spark):
    v = F.col("v")
    assert values(spark, ["Élite & Co. (Phase-2)", None], T.norm(v)) == [("lite and co phase 2",), ("",)]
    assert values(spark, ["https://www.a.com:80/x", "nonsense", None], T.host(v)) == [("a.com:80",), ("",), ("",)]
    urls = ["https://rera.karnataka.gov.in/x", "https://reratracker.com", "https://www.housing.com/a", "https://blog.example.org", "https://x.com/a", "https://netflix.com"]
    assert [t for (t,) in values(spark, urls, T.tier(v))] == ["official", "rera-mirror", "portal", "other", "blocked", "other"]
    assert [w for (w,) in values(spark, urls, T.domain_weight(v))] == [1.0, 0.85, 0.9, 0.45, 0.45, 0.45]
    assert [t for (t,) in values(spark, [" NA ", "-", None, "x "], T.cell(v))] == ["", "", "", "x"]
    assert values(spark, ["Bank Auction Property - Anika Apartment", "Green Park (site visit)"], T.clean_name(v)) == [("Anika Apartment",), ("Green Park",)]
    assert values(spark, ["0123456789ABCDEF01 flat", "PG for girls", "Sai Residency"], T.not_a_project(v)) == [("PG / paying-guest listing",)] * 2 + [("",)]


def test_addresses_and_ids(spark):
    rows = [("2nd Cross Rd, Lokhandwala Complex, Andheri West, Mumbai, Maharashtra 400047", "Mumbai"), ("Ravet, Pimpri-Chinchwad, Pune", "Pune"), ("Sector 78, Noida", "Noida"), ("Kokapet", "x"), ("", "x"), (None, None)]
    got = values(spark, rows, T.short_locality(F.col("a"), F.col("c")), schema="a string, c string")
    assert got == [("Andheri West",), ("Ravet",), ("Sector 78",), ("Kokapet",), ("",), ("",)]
    v = F.col("v")
    assert values(spark, ["A, Sector 78, Noida, Uttar Pradesh 201305, India", "no state", None], T.city_from_address(v)) == [("Noida",), ("",), ("",)]
    ids = values(spark, ["UPRERAPRJ9689 | UPRERAPRJ9214", "TN/01/Layout/506/2021 dated 14/12/2021", "", None], T.split_ids(v))
    assert ids == [(["UPRERAPRJ9689", "UPRERAPRJ9214"],), (["TN/01/Layout/506/2021"],), ([],), ([],)]
    assert values(spark, ["P51800012345"], F.regexp_like(F.lit("see p51800099999."), T.id_shape(v)), F.regexp_like(F.lit("P518000123456"), T.id_shape(v))) == [(True, False)]


def matcher(name, loc, city, ids=()):
    return T.matcher(F.lit(name), F.lit(loc), F.lit(city), T.strings(list(ids)))


@pytest.mark.parametrize(
    ("name", "loc", "city", "ids", "text", "score"),
    [
        ("Prestige Lakeside Habitat", "Varthur", "Bangalore", (), "Prestige Lakeside Habitat in Bengaluru", 1.0),
        ("Prestige Lakeside Habitat", "Varthur", "Bangalore", (), "Prestige Lakeside Habitat", 0.8),
        ("Sai Residency", "Kokapet", "Hyderabad", (), "Sai homes", 1.0 / 1.5 * 0.8 * 0.6),
        ("Green Valley", "Kokapet", "Hyderabad", ("P02400001234",), "other page P0240 0001234", 1.0),
        ("the", "", "", (), "anything", 0.0),
    ],
)
def test_name_score(spark, name, loc, city, ids, text, score):
    assert spark.range(1).select(T.name_score(F.lit(text), matcher(name, loc, city, ids))).first()[0] == pytest.approx(score)


def test_reject(spark):
    m = matcher("Green Valley", "Kokapet", "Hyderabad", ("P02400001234",))
    rows = [
        ("https://x.com/a", "Green Valley", "", "blocked site"), ("https://a.in/flats-for-sale", "Green Valley", "", "list / search / resale page"),
        ("https://a.in/p", "12 Projects in town", "", "list page"), ("https://a.in/p", "Green Valley Pune", "", "different city"),
        ("https://a.in/p", "Green Valley", "number P02400009999", "different RERA number"), ("https://a.in/p", "Green Valley", "Kokapet", ""),
    ]
    df = spark.createDataFrame(rows, "url string, title string, text string, want string")
    got = df.select(T.reject_reason(F.col("url"), F.col("title"), F.col("text"), m), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    s = matcher("Sai Heights", "Sector 41", "Noida")
    assert spark.range(1).select(T.sector_conflict(F.lit("Sai Heights Sector 30"), s), T.sector_conflict(F.lit("Sector 41"), s)).first() == (True, False)


def test_dates(spark):
    cases = {
        "31 Dec 2025": (2025, 12, "day"), "Dec '26": (2026, 12, "month"), "Q3 2026": (2026, 9, "quarter"), "12/31/2025": (2025, 12, "day"), "05/2026": (2026, 5, "month"), "2027-03": (2027, 3, "month"),
        "2027-03-15": (2027, 3, "day"), "in 2024": (2024, None, "year"), "2060": None, "no": None, "45 Jan 2020": (2020, 1, "month"), "Sept 2030 or 2 May 2020": (2030, 9, "month"), None: None,
    }
    got = values(spark, list(cases), dates.first_date(F.col("v"), TODAY))
    assert [tuple(d) if d else None for (d,) in got] == list(cases.values())


def test_keyword_hits(spark):
    texts = ["Possession by Dec 2025, Price 1 Cr", "Possession of units from 2024", "ready to move since 2019 and RERA possession date: 30/06/2027", "", None]
    got = values(spark, texts, F.transform(dates.keyword_hits(F.col("v"), TODAY), lambda h: F.struct(h["kind"], h["year"], h["month"])))
    assert [[tuple(h) for h in hits or []] for (hits,) in got] == [[("possession", 2025, 12)], [], [("ready", 2027, 6), ("rera", 2027, 6)], [], []]


def test_sheet_dates(spark):
    cases = {"45000": (2023, 3), "2024": (2024, 1), "year 2024": (2024, 12), "Dec 2025": (2025, 12), "1700000000": (2023, 11), "1700000000000": (2023, 11), "": None, "nan": None, "31/12/2025": (2025, 12)}
    got = values(spark, list(cases), dates.sheet_date(F.col("v"), TODAY))
    assert [tuple(d) if d else None for (d,) in got] == list(cases.values())
    want = {"2025-12": "Match", "2026-03": "Close (within 3 months)", "2026-04": "Web is 4 months later", "2025": "Same year", "": "No web date"}
    sheet = F.struct(F.lit(2025).alias("year"), F.lit(12).alias("month"))
    assert [v for (v,) in values(spark, list(want), dates.compare_dates(sheet, F.col("v"))["verdict"])] == list(want.values())


def test_money(spark):
    got = values(spark, [8500000.0, 12345678.0, 9999999.0, 10000000.0], money.format_inr(F.col("v")), schema="v double")
    assert [x for (x,) in got] == ["₹85 L", "₹1.23 Cr", "₹100 L", "₹1 Cr"]
    assert [x for (x,) in values(spark, ["85 L", "1.2 Cr", "50000", "8,500,000", None], money.sheet_price(F.col("v")))] == [8.5e6, 1.2e7, None, 8.5e6, None]
    got = values(spark, [9.5e6, 10e6, 5e6, None], money.compare_price(F.lit(8.5e6), F.lit(None).cast("double"), F.col("v")), schema="v double")
    assert [x for (x,) in got] == ["Match (within 15%)", "Web higher by 18%", "Web lower by 41%", "No web price"]
    got = spark.range(1).select(money.listing_price(T.strings(["from ₹1.08 Cr - ₹2.14 Cr", "₹7,500 per sq.ft", "Rs 9,000/sq ft"]))).first()[0]
    assert tuple(got) == ("₹1.08 Cr - ₹2.14 Cr", "₹9,000/sq.ft")


def test_price_candidates(spark):
    m = matcher("Green Valley", "Kokapet", "Hyderabad")
    rows = ["Green Valley Rs 80 L - 1.2 Cr, ₹7,500/sq.ft", "EMI Rs 20 L for Green Valley", "Green Valley from ₹95 L onwards", "similar projects Rs 70 L", ""]
    got = [p for (p,) in values(spark, rows, money.price_candidates(F.col("v"), m))]
    assert [[(round(c.lo), round(c.hi), c.kind) for c in p.found] for p in got] == [[(8_000_000, 12_000_000, "range")], [], [(9_500_000, 9_500_000, "onwards")], [], []]
    assert got[0].per_sqft == 7500
    page = spark.createDataFrame([('<p>"lowPrice": "6000000", "highPrice": 9000000</p>', "Green Valley Kokapet Rs 66 L. " + "Quiet streets, tall trees and wide lawns. " * 3 + "Similar: Dhruv Valley Rs 70 L")], "html string, v string")
    got = page.select(money.price_candidates(F.col("v"), m, F.col("html")).alias("p")).first().p
    assert [(c.lo, c.hi, c.kind) for c in got.found] == [(6e6, 9e6, "page data"), (6.6e6, 6.6e6, "single")]


def test_geo(spark):
    rows = [(12.97, 77.59), (77.59, 12.97), (0.0, 0.0), (19.2183, 72.9781)]
    assert [c for (c,) in values(spark, rows, geo.city_from_coords(F.col("a"), F.col("o")), schema="a double, o double")] == ["Bangalore", "Bangalore", "", "Thane"]
    assert [c for (c,) in values(spark, ["77.38914312° E", "12.5° S", "", None], geo.parse_coord(F.col("v")))] == [77.38914312, -12.5, None, None]
    one = spark.range(1).select(geo.haversine_km(F.lit(17.4), F.lit(78.4), F.lit(17.4), F.lit(79.4)), geo.planar_km(F.lit(17.4), F.lit(78.4), F.lit(17.4), F.lit(79.4))).first()
    assert one[0] == pytest.approx(106.1, abs=0.1) and one[1] == pytest.approx(111.0)


def test_html(spark):
    html = "<html><title>A &amp; B</title><script>x()</script><h1>C</h1><p>one <b>two</b>&nbsp;three</p><style>z</style></html>"
    got = spark.range(1).select(T.html_text(F.lit(html)).alias("p")).first().p
    assert got.title == "A & B | C" and got.text == "A & B C one two three"


def test_html_text_reads_long_pages_whole(spark):
    page = spark.range(1).select(F.concat(F.lit("<title>T</title><p>"), F.repeat(F.lit("word "), 700_000), F.lit("end</p>")).alias("html"))
    row = page.select(T.html_text(F.col("html")).alias("p")).select("p.title", F.length("p.text").alias("n"), F.substring("p.text", -8, 8).alias("tail")).first()
    assert (row.title, row.n, row.tail) == ("T", 3_500_005, "word end")


def test_amounts_are_rounded_by_their_exact_value(spark):
    v = [500.0 * 73, 1.005e7, 1.125e7, 1.375e7, 2.675e7, 3.5e5, 1.45e3, 36500.0, 99999.999e5, 0.0, -1.45e3] + [i * 500.0 for i in range(1, 4000)]
    text = lambda x: "₹" + (f"{x / 1e7:.2f}".rstrip("0").rstrip(".") + " Cr" if x >= 1e7 else f"{x / 1e5:.2f}".rstrip("0").rstrip(".") + " L")
    assert [p for (p,) in values(spark, v, money.format_inr(F.col("v")), schema="v double")] == [text(x) for x in v]


def test_halves_of_per_cents_go_to_the_even_side(spark):
    got = values(spark, [262.5, 2625.5, 177.5, 100.0 - 16.5, 116.5], money.compare_price(F.lit(100.0), F.lit(None).cast("double"), F.col("v")), schema="v double")
    assert [p for (p,) in got] == ["Web higher by 162%", "Web higher by 2526%", "Web higher by 78%", "Web lower by 16%", "Web higher by 16%"]
