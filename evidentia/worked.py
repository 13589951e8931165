"""Queries of the text and planning operators: worked cases dealt to the rows of the driver's tables.

The tables hold no real-estate text, so each row gets one of a few cases by its
key and fills it with its own values. What the operators must find is written
into the SQL as plain values; the SQL knows nothing of their patterns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import money
from .functions import text as T
from .operators import evidence, fusion, review, state
from .plans import discovery, enrich, report
from .queries import _MON, _sql_norm, _t, candidates, query
from .session import materialize, spread
from .sources import recorded, sheet

TODAY = dt.date(2025, 6, 15)
LABELS = {"F": "Low", "O": "High", "P": "Skipped"}


def _value(v) -> str:
    return "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower()


class Cases:
    """Rows of texts that operators read (``given``) and of values that only the SQL sees (``wanted``)."""

    def __init__(self, given: str, wanted: str, rows: list[tuple]):
        self.given, self.wanted, self.rows = given.split(), wanted.split(), rows

    def deal(self, spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
        """Adds the given texts of the row's case."""
        schema = ", ".join(["case_no int", *(f"{c} string" for c in self.given)])
        few = spark.createDataFrame([(i, *r[: len(self.given)]) for i, r in enumerate(self.rows)], schema)
        return rows.withColumn("case_no", (F.col(key) % len(self.rows)).cast("int")).join(F.broadcast(few), "case_no")

    def sql(self, key: str) -> str:
        rows = ", ".join("(" + ", ".join(map(_value, (i, *r[len(self.given) :]))) + ")" for i, r in enumerate(self.rows))
        return f"(values {rows}) as w(case_no, {', '.join(self.wanted)}) on w.case_no = {key} % {len(self.rows)}"


def _filled(text: str, value: Column) -> Column:
    return F.replace(F.col(text), F.lit("{}"), value.cast("string"))


def _green_valley() -> Column:
    return T.matcher(F.lit("Green Valley"), F.lit("Kokapet"), F.lit("Hyderabad"), T.strings(["P02400001234"]))


ENTITIES = Cases(
    "a_name address town la lo cell",
    "name loc city ids lat lon skip_reason",
    [
        ("Bank Auction Property - Anika Apartment {}", "2nd Cross Rd, Lokhandwala Complex, Andheri West, Mumbai, Maharashtra 400047", "Mumbai", "12.97° N", "77.59° E", "UPRERAPRJ9689 | UPRERAPRJ9214",
         "Anika Apartment {}", "Andheri West", "Mumbai", "UPRERAPRJ9689|UPRERAPRJ9214", 12.97, 77.59, ""),
        ("Tower {} (site visit)", "A, Sector 78, Noida, Uttar Pradesh 201305, India", "", "", "", "TN/01/Layout/506/2021 dated 14/12/2021", "Tower {}", "Sector 78", "Noida", "TN/01/Layout/506/2021", None, None, ""),
        ("PG for men {}", "Kokapet", "", "12.9716", "77.5946", "-", "PG for men {}", "Kokapet", "Bangalore", "", 12.9716, 77.5946, "PG / paying-guest listing"),
        ("nan", "", "NA", "77.59", "12.97", "", "", "", "Bangalore", "", 77.59, 12.97, "empty building name"),
        ("Sai {} Residency", "Ravet, Pimpri-Chinchwad, Pune", "Pune", "", "12.5° S", None, "Sai {} Residency", "Ravet", "Pune", "", None, -12.5, ""),
    ],
)
HEADERS = {"Building Name": "a_name", "Locality": "address", "City": "town", "Latitude": "la", "Longitude": "lo", "RERA ID": "cell"}


@query(f"""with e as (select p_partkey as row_idx, replace(name, '{{}}', p_partkey::varchar) as name, loc, city, ids, lat::double as lat, lon::double as lon, skip_reason from part join {ENTITIES.sql("p_partkey")}),
    k as (select *, {_sql_norm("name")} || '|' || {_sql_norm("loc")} || '|' || {_sql_norm("city")} as rkey from e)
    select *, rkey || '|' || ids as gkey from k""")
def entity_rows(spark, sf_dir):
    dealt = ENTITIES.deal(spark, _t(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    raw = dealt.select(F.col("p_partkey").alias("row_idx"), *((_filled(c, F.col("p_partkey")) if c == "a_name" else F.col(c)).alias(h) for h, c in HEADERS.items()))
    e = sheet.entities(raw, sheet.detect_columns(list(HEADERS)))
    return e.select("row_idx", "name", "loc", "city", F.array_join("rera_ids", "|").alias("ids"), "lat", "lon", "rkey", "gkey", "skip_reason")


@query("""with e as (select c_custkey as k, 'Lake ' || c_custkey || ' View' as name, case when c_mktsegment = 'BUILDING' then 'P0240' || lpad(c_custkey::varchar, 8, '0') else '' end as id from customer),
    t as (select k, id, 0 as q, name || ' Kokapet Hyderabad price possession' as query from e
        union all select k, id, 1, name || ' Kokapet Hyderabad site:99acres.com OR site:magicbricks.com OR site:housing.com OR site:squareyards.com' from e
        union all select k, id, 2, case when id = '' then '"' || name || '" Hyderabad possession date price' else '"' || id || '"' end from e
        union all select k, id, 3, name || ' Hyderabad project price per sq.ft possession' from e)
    select 'lake ' || k || ' view|kokapet|hyderabad|' || id as gkey, q::bigint as q, query from t""")
def search_texts(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    rera = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("P0240"), F.lpad(key, 8, "0"))).otherwise("")
    e = _t(spark, sf_dir, "customer").select(F.concat(F.lit("Lake "), key, F.lit(" View")).alias("name"), F.lit("Kokapet").alias("loc"), F.lit("Hyderabad").alias("city"), rera.alias("rera"), F.lit("").alias("skip_reason"))
    e = e.withColumn("rera_ids", T.split_ids(F.col("rera")))
    e = e.withColumn("gkey", evidence.group_key(F.col("name"), F.col("loc"), F.col("city"), F.col("rera_ids")))
    return sheet.search_queries(e, "full").withColumn("q", F.col("q").cast("long"))


PAGES = Cases(
    "url title said name loc city id",
    "reason trusted dedicated",
    [
        ("https://x.com/a", "Green Valley", "", "Green Valley", "Kokapet", "Hyderabad", "P02400001234", "blocked site", False, 0.8),
        ("https://a.in/flats-for-sale", "Green Valley", "", "Green Valley", "Kokapet", "Hyderabad", "P02400001234", "list / search / resale page", False, 0.8),
        ("https://a.in/p", "12 Projects in town", "", "Green Valley", "Kokapet", "Hyderabad", "P02400001234", "list page", False, 0.0),
        ("https://a.in/p", "Green Valley Pune", "", "Green Valley", "Kokapet", "Hyderabad", "P02400001234", "different city", False, 0.8),
        ("https://a.in/p", "Green Valley", "number P02400009999", "Green Valley", "Kokapet", "Hyderabad", "P02400001234", "different RERA number", False, 0.8),
        ("https://a.in/p", "Green Valley", "number P02400001234", "Green Valley", "Kokapet", "Hyderabad", "P02400001234", "", False, 1.0),
        ("https://www.housing.com/in/p", "Green Valley Kokapet", "", "Green Valley", "Kokapet", "Hyderabad", "P02400001234", "", True, 1.0),
        ("https://green-valley.in/p", "Green Valley", "", "Green Valley", "Kokapet", "Hyderabad", "P02400001234", "", True, 0.8),
        ("https://www.99acres.com/sai", "Sai Heights Sector 30 Noida", "", "Sai Heights", "Sector 41", "Noida", "", "", False, 1.0),
        ("https://www.99acres.com/sai", "Sai Heights", "", "Sai Heights", "Sector 41", "Noida", "", "common name, locality not on page", True, 0.0),
    ],
)


@query(f"select doc_id, reason, trusted, dedicated::double as dedicated from documents join {PAGES.sql('doc_id')}")
def reject_reasons(spark, sf_dir):
    """Every document as a page's text, after a sentence of the case."""
    d = PAGES.deal(spark, _t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    m = T.matcher(F.col("name"), F.col("loc"), F.col("city"), T.split_ids(F.col("id")))
    d = d.select("doc_id", "url", "title", T.joined(F.col("said"), F.col("text")).alias("text"), m.alias("m"))
    url, title, text, m = (F.col(c) for c in ("url", "title", "text", "m"))
    return d.select("doc_id", T.reject_reason(url, title, text, m).alias("reason"), T.trusted(url, title, m).alias("trusted"), F.round(T.dedicated(title, text, m), 6).alias("dedicated"))


def _results(dealt: DataFrame, key: str, snippet: Column) -> DataFrame:
    """One search result on a trusted portal for each row, about the row's project; the project's matcher is worked out once, as a table of one row."""
    url = F.concat(F.lit("https://housing.com/in/buy/projects/page/"), F.col(key).cast("string"), F.lit("-green-valley"))
    entity = dealt.sparkSession.range(1).select(_green_valley().alias("m"))
    return dealt.select(F.col(key).alias("gkey"), url.alias("url"), F.lit("Green Valley Kokapet Hyderabad").alias("title"), snippet.alias("snippet"), F.col(key).alias("seq")).join(F.broadcast(entity))


DATED = Cases(
    "said",
    "kind month precision score is_rera",
    [
        ("Possession by Dec {}.", "possession", 12, "month", 0.765, False),
        ("Handover in Q3 {}", "handover", 9, "quarter", 0.5852, False),
        ("RERA possession date: 30/06/{}", "rera", 6, "day", 0.765, True),
        ("Possession of units from {}", None, None, None, None, None),
        ("built in {} by hand", "built", None, "year", 0.3729, False),
    ],
)


@query(f"""select c_custkey as gkey, kind, 2015 + c_custkey % 10 as year, month::bigint as month, precision, score::double as score, is_rera, true as trusted, 'housing.com' as domain
    from customer join {DATED.sql("c_custkey")} where kind is not null""")
def snippet_facts(spark, sf_dir):
    dealt = DATED.deal(spark, spread(_t(spark, sf_dir, "customer").select("c_custkey"), "customers"), "c_custkey")
    found = evidence.snippet_dates(evidence.matched_snippets(_results(dealt, "c_custkey", _filled("said", 2015 + F.col("c_custkey") % 10))), TODAY)
    return found.select("gkey", "kind", F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "precision", F.round("score", 4).alias("score"), "is_rera", "trusted", "domain")


AMOUNTS = Cases(
    "said",
    "kind lakhs high per_sqft",
    [
        ("Quoted at Rs {} L - 1.9 Cr today", "range", 1, 190, 0),
        ("from ₹{} L onwards", "onwards", 1, None, 0),
        ("Quoted at Rs {} L.", "single", 1, None, 0),
        ("EMI Rs {} L", None, None, None, None),
        ("similar projects Rs {} L", None, None, None, None),
        ("at ₹7,5{}/sq.ft", "per sq.ft only", 0, None, 7500),
    ],
)


@query(f"""with a as (select c_custkey as gkey, kind, lakhs * (60 + c_custkey % 40) as lo, high, case when per_sqft > 0 then per_sqft + 60 + c_custkey % 40 else 0 end as per from customer join {AMOUNTS.sql("c_custkey")})
    select gkey, kind, (lo * 100000)::double as lo, (coalesce(high, lo) * 100000)::double as hi, per::bigint as per_sqft from a where kind is not null""")
def snippet_prices(spark, sf_dir):
    dealt = AMOUNTS.deal(spark, spread(_t(spark, sf_dir, "customer").select("c_custkey"), "customers"), "c_custkey")
    found = evidence.prices(evidence.matched_snippets(_results(dealt, "c_custkey", _filled("said", 60 + F.col("c_custkey") % 40))), False)
    return found.select("gkey", "kind", "lo", "hi", F.col("per_sqft").cast("long").alias("per_sqft"))


CHANGED = Cases("said", "first", [("Original Completion Date: 31-12-2024", "Dec 2024"), ("Proposed Completion 30/06/{}", None), ("Sold out.", "")])


@query(f"""with r as (select c_custkey as gkey, 2025 + c_custkey % 8 as y, first from customer join {CHANGED.sql("c_custkey")} where coalesce(first, 'x') <> '')
    select gkey, coalesce(first, 'Jun ' || y) as rera_orig_display, y || '-06' as rera_current_iso, 'Jun ' || y as rera_current_display,
        case when first is null then 'No - revised date same as original' else 'Yes - extended Dec 2024 -> Jun ' || y end as extension_found from r""")
def registry_pairs(spark, sf_dir):
    year = 2025 + F.col("c_custkey") % 8
    dealt = CHANGED.deal(spark, spread(_t(spark, sf_dir, "customer").select("c_custkey"), "customers"), "c_custkey")
    revised = F.when(F.col("said") != "Sold out.", F.concat(F.lit(" Revised Proposed Date of Completion: 30/06/"), year.cast("string"))).otherwise("")
    found = materialize(evidence.matched_snippets(_results(dealt, "c_custkey", F.concat(F.lit("RERA P02400001234. "), _filled("said", year), revised))), "snippets")
    dates = materialize(evidence.snippet_dates(found, TODAY), "dates")
    out = fusion.registry_summary(dates, evidence.register_pairs(found, TODAY), TODAY)
    return out.select("gkey", "rera_orig_display", "rera_current_iso", "rera_current_display", "extension_found")


@query("""with r as (select o_custkey as gkey, o_orderkey as k, o_orderkey % 3 as q, o_orderpriority like '2%' as portal from orders where o_orderpriority <> '5-LOW' and o_orderstatus <> 'P'),
    n as (select *, row_number() over (partition by gkey, q order by portal desc, k) as n from r), t as (select *, row_number() over (partition by gkey order by q, n) as place from n where n <= 3)
    select gkey, case when portal then 'https://www.housing.com/in/p/' else 'https://site.in/p/' end || k as url, q, case when portal then 2.9 else 1.45 end::double as rank from t where place <= 8""")
def page_pick(spark, sf_dir):
    """Orders as search results of customers: files to skip, namesakes, portals and other sites."""
    p, key = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    url = F.when(p == "5-LOW", F.concat(F.lit("https://site.in/"), key, F.lit(".pdf"))).when(p.startswith("2"), F.concat(F.lit("https://www.housing.com/in/p/"), key)).otherwise(F.concat(F.lit("https://site.in/p/"), key))
    title = F.when(F.col("o_orderstatus") == "P", "Sunny Meadow").otherwise("Green Valley")
    r = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("gkey"), (F.col("o_orderkey") % 3).alias("q"), url.alias("url"), title.alias("title"), F.lit("Kokapet").alias("snippet"), F.col("o_orderkey").alias("seq"), _green_valley().alias("m"))
    return evidence.pick_pages(r).withColumn("rank", F.round("rank", 6))


@query("""with o as (select o_custkey as gkey, o_orderkey as option_id, round((o_orderkey % 50) * 1.11, 2)::double as km, o_orderstatus = 'F' as elsewhere, o_orderpriority as p from orders),
    n as (select *, row_number() over (partition by gkey order by km, option_id) as n from o)
    select gkey, arg_min(option_id, n) as option_id, arg_min(km, n) as km from n where n <= 2 and (p = '1-URGENT' or (p <> '5-LOW' and (km <= 3 or (km <= 8 and not elsewhere)))) group by gkey""")
def provider_accept(spark, sf_dir):
    """Orders as a provider's options: some have the entity's number, some another one, some name the city only."""
    e = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gkey"), _green_valley().alias("m"), F.lit(17.4).alias("lat"), F.lit(78.4).alias("lon"))
    p = F.col("o_orderpriority")
    rera = F.when(p == "1-URGENT", "P02400001234").when(p == "5-LOW", "P02400009999").otherwise("")
    o = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("gkey"), F.col("o_orderkey").alias("option_id"), F.lit("Green Valley").alias("title"), F.when(F.col("o_orderstatus") == "F", "Hyderabad").otherwise("Kokapet").alias("place"),
        rera.alias("rera"), (F.lit(17.4) + F.col("o_orderkey") % 50 / 100).alias("o_lat"), F.lit(78.4).alias("o_lon"),
    )
    return enrich.accept_provider_options(e, o).select("gkey", "option_id", F.round("km", 2).alias("km"))


RESULTS_SQL = f"""with r as (select o_orderkey as row_idx, {{key}} as rkey, case o_orderstatus {" ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items())} end as label, o_orderpriority <> '5-LOW' as found, strftime(o_orderdate, '%Y-%m') as iso,
    case when o_totalprice > 100000 then o_totalprice end as price_min, case when o_custkey % 2 = 0 then 'High' else 'Low' end as price_label, o_orderdate as updated from orders)"""


def _verdicts(spark, sf_dir) -> DataFrame:
    """Orders as finished verdicts."""
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[F.col("o_orderstatus")]
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_idx"), F.col("o_custkey").cast("string").alias("rkey"), label.alias("label"), (F.col("o_orderpriority") != "5-LOW").alias("found"), F.date_format("o_orderdate", "yyyy-MM").alias("iso"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price_min"), F.when(F.col("o_custkey") % 2 == 0, "High").otherwise("Low").alias("price_label"), F.col("o_orderdate").alias("updated"),
    )


@query(RESULTS_SQL.format(key="o_custkey::varchar") + """, d as (select 'missing' as mode, row_idx from r where found union all select 'low', row_idx from r where found and label in ('High', 'Medium')
    union all select 'skipped-only', row_idx from r where label = 'Skipped' union all select 'incomplete', row_idx from r where label = 'Skipped' or (found and label in ('High', 'Medium') and price_min is not null and price_label = 'High')
    union all select 'default', row_idx from r) select * from d""")  # fmt: skip
def retry_modes(spark, sf_dir):
    r = _verdicts(spark, sf_dir)
    modes = {"missing": "missing", "low": "low", "skipped-only": "skipped-only", "incomplete": "incomplete", "default": None}
    parts = [state.done_rows(r, mode).select(F.lit(name).alias("mode"), "row_idx") for name, mode in modes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(RESULTS_SQL.format(key="o_custkey::varchar") + """, v as (select rkey, arg_max(label, (updated, row_idx)) as l, arg_max(iso, (updated, row_idx)) as i from r where found group by rkey)
    select row_idx, coalesce(l, label) as label, coalesce(i, iso) as iso, found or l is not null as found from r left join v using (rkey)""")  # fmt: skip
def propagate_found(spark, sf_dir):
    return state.propagate_found(_verdicts(spark, sf_dir)).select("row_idx", "label", "iso", "found")


@query("""with n as (select o_custkey as k, count(*) as v from orders where o_orderstatus = 'F' group by o_custkey), o as (select c_custkey as k, 0::bigint as v from customer)
    select k, v from o where k not in (select k from n) union all select k, v from n""")
def keyed_upsert(spark, sf_dir):
    old = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("v"))
    new = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    return state.upsert(old, new, ["k"])


@query(RESULTS_SQL.format(key="o_custkey") + """
    select row_idx, label = 'High' as possession, false as rera, label = 'High' and price_label = 'High' and price_min is not null as "full" from r""")
def search_rounds(spark, sf_dir):
    """Whether a verdict ends the search, in each mode."""
    return _verdicts(spark, sf_dir).select("row_idx", *(enrich.conclusive(m).alias(m) for m in ("possession", "rera", "full")))


@query(RESULTS_SQL.format(key="o_custkey") + """, n as (select *, price_label = 'High' as noted from r), s as (select 'all' as scope, * from n where not noted union all select 'notfound', * from n where not noted and not found
    union all select 'unsure', * from n where not noted and (not found or label = 'Low'))
    select scope, row_idx, round(((rkey / 3.5::double + 900) * 3 + 1200 * 15) / 1e6 + 0.015::double, 9) as usd, round(((rkey / 3.5::double + 900) * 3 + 400 * 15) / 1e6 * 0.5::double, 9) as usd_batch from s""")  # fmt: skip
def review_scopes(spark, sf_dir):
    """Rows worth a second look, and what each would cost at once or in a batch."""
    r = _verdicts(spark, sf_dir).withColumn("note", F.when(F.col("price_label") == "High", "empty building name"))
    out = None
    for scope in ("all", "notfound", "unsure"):
        part = review.select_rows(r, scope).select(F.lit(scope).alias("scope"), "row_idx", "rkey")
        out = part if out is None else out.unionByName(part)
    chars = F.col("rkey").cast("long")
    return out.select("scope", "row_idx", F.round(review.estimate_usd(chars, 3.0, 15.0), 9).alias("usd"), F.round(review.estimate_usd(chars, 3.0, 15.0, True), 9).alias("usd_batch"))


SAID = Cases("said", "form", [("{}-12", "month"), ("{}", "year"), ("soon", ""), ("{}-13", "")])


@query(f"""with v as (select o_orderkey as row_idx, strftime(o_orderdate, '%Y-%m') as iso, case when o_orderstatus = 'F' then case form when 'month' then (2020 + o_custkey % 9) || '-12' when 'year' then (2020 + o_custkey % 9)::varchar else '' end end as said from orders join {SAID.sql("o_orderkey")})
    select row_idx, coalesce(nullif(said, ''), iso) as final_iso, case when coalesce(said, '') = '' then '' when length(said) = 7 then {_MON}[12] || ' ' || substr(said, 1, 4) else said end as display from v""")
def review_verdicts(spark, sf_dir):
    """A model's dates before our own, where they are dates."""
    o = SAID.deal(spark, _t(spark, sf_dir, "orders"), "o_orderkey").withColumn("row_idx", F.col("o_orderkey"))
    v = review.normalise_verdict(_filled("said", 2020 + F.col("o_custkey") % 9))
    reviews = o.where("o_orderstatus = 'F'").select("row_idx", v["iso"].alias("iso"), v["display"].alias("display"))
    out = review.final_answer(o.select("row_idx", F.date_format("o_orderdate", "yyyy-MM").alias("iso")), reviews)
    return out.join(reviews.select("row_idx", "display"), "row_idx", "left").select("row_idx", "final_iso", F.coalesce("display", F.lit("")).alias("display"))


@query("""with l as (select o_orderkey as seq, 'https://l.in/' || o_orderkey as url, substr(o_orderpriority, 3) as site, 'Emerald ' || o_custkey as name, case when o_orderstatus = 'O' then 'B' || o_orderkey else '' end as builder,
        case when o_totalprice > 200000 then floor(o_totalprice)::bigint || ' L' end as price from orders)
    select 'emerald ' || substr(name, 9) || '|kokapet' as lkey, array_to_string(list_sort(list(distinct site)), ', ') as sites, arg_min(url, seq) as url, arg_min(builder, case when builder <> '' then seq end) as builder,
        arg_min(price, case when price is not null then seq end) as price, min(seq) as seq from l group by name""")  # fmt: skip
def listing_merge(spark, sf_dir):
    """Orders as listings of a customer's project, its name in either case."""
    key, name = F.col("o_orderkey").cast("string"), F.concat(F.lit("Emerald "), F.col("o_custkey").cast("string"))
    rows = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("https://l.in/"), key).alias("url"), F.substr("o_orderpriority", F.lit(3)).alias("site"), F.when(F.col("o_orderstatus") == "F", F.upper(name)).otherwise(name).alias("name"), F.lit("Kokapet").alias("locality"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("B"), key)).otherwise("").alias("builder"), F.lit("").alias("rera_no"), F.when(F.col("o_totalprice") > 200000, F.concat(F.floor("o_totalprice").cast("long").cast("string"), F.lit(" L"))).alias("price"),
        F.lit("").alias("price_sqft"), F.lit("").alias("possession"),
    )
    return discovery.merged_listings(rows).select("lkey", "sites", "url", "builder", "price", "seq")


_SITES = "(values ('99acres', '99acres.com'), ('magicbricks', 'magicbricks.com'), ('housing', 'housing.com'), ('squareyards', 'squareyards.com')) as s(site, domain)"


@query(f"""with q as (select n_name as locality, site, 'site:' || domain || ' ' || n_name || ' Hyderabad' as query, n_regionkey from nation, {_SITES})
    select site, locality, query from q where not (site = 'housing' and n_regionkey = 1) union all
    select t, n_name, t || ' in ' || n_name || ' Hyderabad' from nation, (values ('apartment complex'), ('gated community'), ('commercial building')) as t(t)""")
def discovery_queries(spark, sf_dir):
    """Site searches that are still to do, whatever the spelling of those done, and map searches."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("locality"), "n_regionkey")
    done = n.where("n_regionkey = 1").select(F.lit("housing").alias("site"), F.concat(F.lower("locality"), F.lit(" !")).alias("locality"))
    q = discovery.listing_queries(n.select("locality"), done).select("site", "locality", "query")
    return q.unionByName(discovery.place_queries(n.select("locality")).select(F.col("term").alias("site"), "locality", "query"))


@query("""with s as (select c_custkey as k, 16.5::double + (c_custkey % 200) / 100.0::double as la, 77.5::double + (c_custkey % 190) / 100.0::double as lo, c_nationkey as n from customer)
    select k::varchar as building_name, la as lat, lo as lon, 'P0' || lpad(k::varchar, 10, '0') as rera_norm from s where n % 3 <> 0 and la between 16.9::double and 18.0::double and lo between 77.9::double and 79.1::double""")
def known_projects(spark, sf_dir):
    """Customers as projects on file, some with latitude and longitude in each other's place."""
    la, lo = F.lit(16.5) + F.col("c_custkey") % 200 / 100, F.lit(77.5) + F.col("c_custkey") % 190 / 100
    turned = F.col("c_nationkey") % 2 == 1
    key = F.col("c_custkey").cast("string")
    s = _t(spark, sf_dir, "customer").select(
        key.alias("building_name"), F.lit("x").alias("locality"), F.when(F.col("c_nationkey") % 3 == 0, "Pune").otherwise(" hyderabad").alias("city"),
        F.when(turned, lo).otherwise(la).cast("string").alias("latitude"), F.when(turned, la).otherwise(lo).cast("string").alias("longitude"), F.concat(F.lit("p0"), F.lpad(key, 10, "0"), F.lit(" (old)")).alias("rera_id"),
    )
    return sheet.known_projects(s).select("building_name", "lat", "lon", "rera_norm")


@query("""select c_custkey, 'Residential' as project_type, 'New Project' as status, '31/12/' || (2026 + c_custkey % 5) as proposed, c_mktsegment as district, '' as street, lpad(c_custkey::varchar, 6, '5') as pin,
        'P02' || lpad(c_custkey::varchar, 9, '0') as cert_id, 'Kukatpally' as mandal, '50' || lpad((c_custkey % 10000)::varchar, 4, '0') as cert_pin, 'P02' || lpad(c_custkey::varchar, 9, '0') as split_id, true as type_ok from customer""")
def register_texts(spark, sf_dir):
    """A register page, a certificate and a number with spaces for each customer."""
    key = F.col("c_custkey").cast("string")
    number = F.concat(F.lit("P02"), F.lpad(key, 9, "0"))
    page = F.concat(F.lit("Project Information Project Type Residential Project Status New Project Approved Date 01/02/2022 Proposed Date of Completion 31/12/"), (2026 + F.col("c_custkey") % 5).cast("string"),
                    F.lit(" Address Details District "), F.col("c_mktsegment"), F.lit(" Mandal Ameerpet Village/City/Town Begumpet Street NA Locality Somajiguda Pin Code "), F.lpad(key, 6, "5"))
    cert = F.concat(F.lit("registration number : "), number, F.lit(" Project: X , Survey No.: 1, at Kukatpally, Kukatpally, Medchal- Malkajgiri, 50"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit("; valid ending with 31/12/2027"))
    spaced = F.concat(F.lit("No. "), F.substr(number, F.lit(1), F.lit(5)), F.lit(" "), F.substr(number, F.lit(6)))
    texts = _t(spark, sf_dir, "customer").select("c_custkey", recorded.register_detail(page).alias("d"), recorded.register_certificate(cert).alias("c"), recorded.register_number(spaced).alias("split_id"))
    return texts.select(
        "c_custkey", "d.project_type", "d.status", F.col("d.proposed_completion").alias("proposed"), "d.district", "d.street", "d.pin", F.col("c.rera_from_cert").alias("cert_id"), "c.mandal", F.col("c.pin").alias("cert_pin"),
        "split_id", recorded.register_type_ok(F.col("d.project_type")).alias("type_ok"),
    )


TAILS = Cases(
    "said",
    "cut found",
    [("Lake {} View Kokapet", "Lake {} View", "Kokapet"), ("Lake {} Jubilee Hills", "Lake {}", "Jubilee Hills"), ("Lake {} banjara hills road", "Lake {}", "Banjara Hills Road"), ("Lake {} Hills", "Lake {} Hills", "")],
)


@query(f"select c_custkey::varchar as url, replace(cut, '{{}}', c_custkey::varchar) as name, found as locality from customer join {TAILS.sql('c_custkey')}")
def tail_locality(spark, sf_dir):
    dealt = TAILS.deal(spark, _t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    listings = dealt.select(F.col("c_custkey").cast("string").alias("url"), _filled("said", F.col("c_custkey")).alias("name"), F.lit("").alias("locality"))
    known = spark.createDataFrame([(x,) for x in ("Kokapet", "Jubilee Hills", "Banjara Hills Road")], "locality string").withColumn("lkey", T.norm(F.col("locality")))
    return recorded.split_tail_locality(listings, known).select("url", "name", "locality")


@query("""select p_partkey, '₹' || (5 + p_partkey % 90) || ' L - ₹2.14 Cr' as price, '₹9,' || lpad((p_partkey % 1000)::varchar, 3, '0') || '/sq.ft' as price_sqft, ((5 + p_partkey % 90) * 100000)::double as cell_lakh,
    case when p_partkey % 100 > 0 then (p_partkey % 100) * 100000.0 end::double as cell_plain from part""")
def listing_prices(spark, sf_dir):
    """Prices over several snippets of a listing, and of sheet cells."""
    lakhs, thousand = (5 + F.col("p_partkey") % 90).cast("string"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    texts = F.array(F.concat(F.lit("from ₹"), lakhs, F.lit(" L - ₹2.14 Cr")), F.lit("₹7,500 per sq.ft"), F.concat(F.lit("Rs 9,"), thousand, F.lit("/sq ft")))
    plain = F.concat((F.col("p_partkey") % 100).cast("string"), F.lit("00,000"))
    return _t(spark, sf_dir, "part").select("p_partkey", money.listing_price(texts).alias("p"), money.sheet_price(F.concat(lakhs, F.lit(" L"))).alias("cell_lakh"), money.sheet_price(plain).alias("cell_plain")).select("p_partkey", "p.*", "cell_lakh", "cell_plain")


@query("""with r as (select c_custkey as k, case c_custkey % 3 when 0 then 'serper' when 1 then 'brave' else 'google' end as engine, c_mktsegment as seg from customer)
    select k::varchar as gkey, engine, 0::bigint as q, 'Lake ' || k as title, 'https://a.in/' || k as url, 'by ' || seg as snippet, 0::bigint as seq from r where seg <> 'MACHINERY'""")
def recorded_answers(spark, sf_dir):
    """Answers of three engines, recorded for all segments but one, found again by their search; the second result is no web page."""
    c, key = _t(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    engine = F.get(F.array(F.lit("serper"), F.lit("brave"), F.lit("google")), (F.col("c_custkey") % 3).cast("int"))

    def body(link: str, text: str, path: tuple[str, str]) -> Column:
        item = F.format_string(f'{{"title": "Lake %s", "{link}": "https://a.in/%s", "{text}": "by <b>%s</b>"}}, {{"title": "x", "{link}": "ftp://a.in", "{text}": null}}', key, key, F.col("c_mktsegment"))
        return F.concat(F.lit(path[0] + "["), item, F.lit("]" + path[1]))

    results = (
        F.when(engine == "serper", recorded.json_results(body("link", "snippet", ('{"organic": ', "}")), "serper"))
        .when(engine == "brave", recorded.json_results(body("url", "description", ('{"web": {"results": ', "}}")), "brave"))
        .otherwise(recorded.json_results(body("link", "snippet", ('{"items": ', "}")), "google"))
    )
    cache = c.where("c_mktsegment <> 'MACHINERY'").select(F.concat(F.lit("search "), key).alias("q"), results.alias("results"))
    queries = c.select(key.alias("gkey"), F.lit(0).alias("q"), F.concat(F.lit("search "), key).alias("query"))
    found = recorded.cached_results(queries, cache).join(c.select(key.alias("gkey"), engine.alias("engine")), "gkey")
    return found.select("gkey", "engine", F.col("q").cast("long").alias("q"), "title", "url", "snippet", (F.col("seq") - F.col("q") * 1000).alias("seq"))


@query("""select c_custkey::varchar as gkey from customer where c_mktsegment = 'MACHINERY'""")
def unanswered(spark, sf_dir):
    """Searches without a recorded answer."""
    key = F.concat(F.lit("search "), F.col("c_custkey").cast("string"))
    c = _t(spark, sf_dir, "customer")
    cache = c.where("c_mktsegment <> 'MACHINERY'").select(key.alias("q"))
    return recorded.uncached(c.select(F.col("c_custkey").cast("string").alias("gkey"), key.alias("query")), cache).select("gkey")


STATUS = Cases(
    "said",
    "ready building",
    [("Ready to move homes. Ready to move now, ready to move in, immediate possession.", 3, 0), ("Under construction; a new launch.", 0, 2), ("Ready for possession, tower B under-construction.", 1, 1), ("Quiet streets.", 0, 0)],
)


@query(f"""with s as (select o_custkey as gkey, ready, building from orders join {STATUS.sql("o_orderkey")})
    select gkey, 'Ready to Move' as label, sum(ready)::bigint as n from s group by gkey having sum(ready) > 0 union all select gkey, 'Under Construction', sum(building)::bigint from s group by gkey having sum(building) > 0""")
def status_words(spark, sf_dir):
    """Status words of each customer's orders as pages, three at most of each kind and page."""
    o = STATUS.deal(spark, _t(spark, sf_dir, "orders"), "o_orderkey").select(F.col("o_custkey").alias("gkey"), F.col("said").alias("text"))
    return evidence.status_counts(o).withColumn("n", F.col("n").cast("long"))


@query("""with c as (select l_partkey as gkey, l_orderkey::varchar as url, l_linestatus = 'O' as reg, l_extendedprice / 60000 as score, l_orderkey * 10 + l_linenumber as seq,
        case when l_linenumber < 4 then strftime(l_shipdate, '%Y-%m') else strftime(l_shipdate, '%Y') end as date from lineitem),
    n as (select *, row_number() over (partition by gkey, reg order by score desc, seq) as n from c), t as (select *, least(10, count(*) filter (reg) over (partition by gkey)) as own from n where n <= 15),
    d as (select gkey, string_agg(date || '@' || url, ';' order by not reg, n) as dates from t where case when reg then n <= 10 else n <= greatest(15 - own, 5) end group by gkey),
    u as (select gkey, url, min(seq) as seq from c group by gkey, url), s as (select *, row_number() over (partition by gkey order by seq) as n from u)
    select d.gkey, dates, urls from d join (select gkey, string_agg(url, ';' order by n) as urls from s where n <= 12 group by gkey) using (gkey)""")
def evidence_packs(spark, sf_dir):
    """What a reviewer of each part sees, with its order lines as search results and dates."""
    c = candidates(spark, sf_dir)
    r = c.select("gkey", "url", "seq", F.lit("Green Valley").alias("title"), F.lit("Kokapet").alias("snippet"), _green_valley().alias("m"))
    p = evidence.evidence_pack(r, c)
    return p.select("gkey", F.array_join(F.transform("dates", lambda d: F.concat_ws("@", d["date"], d["url"])), ";").alias("dates"), F.array_join(F.transform("snippets", lambda x: x["url"]), ";").alias("urls"))


@query(RESULTS_SQL.format(key="o_custkey") + """, m as (select count(*) as a, count(*) filter (found) as b, count(*) filter (found and label = 'High') as c, count(*) filter (found and label = 'Low') as d, count(*) filter (price_label = 'High') as e,
        count(*) filter (label = 'Skipped') as f, coalesce(sum(rkey % 5), 0)::bigint as g from r)
    select 'Rows' as "Metric", a as "Value" from m union all select 'Dates found', b from m union all select 'Dates confirmed (High or Medium)', c from m union all select 'Dates unconfirmed (Low)', d from m union all select 'Prices confirmed', e from m
    union all select 'Skipped', f from m union all select 'Searches', g from m""")  # fmt: skip
def report_summary(spark, sf_dir):
    return report.summary(_verdicts(spark, sf_dir).withColumn("queries", F.col("rkey").cast("long") % 5))


def _projects(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suppliers as registered projects 5 km apart, the projects on file and what was looked up.

    Of three, one is on file with its number, one with its name, one isn't.
    """
    key, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey")
    number, empty = F.concat(F.lit("P02"), F.lpad(key, 9, "0")), F.lit("")
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", key.alias("k"), F.concat(F.lit("Crest"), key).alias("name"), (F.lit(17.0) + k % 20 * 0.05).alias("lat"), (F.lit(78.0) + F.floor(k / 20) * 0.05).alias("lon"), number.alias("rera_no"))
    fields = {c: empty for c in ("revised_completion", "proposed_completion", "project_type", "locality", "village", "mandal", "district", "pin", "detail_url")}
    register = s.withColumns({"key": F.col("k"), "seq": k, "promoter": F.concat(F.lit("B"), "k"), "type_ok": F.lit(True), "in_footprint": k % 7 != 0} | fields)
    known = s.where(k % 3 != 2).select(
        F.when(k % 3 == 1, F.col("name")).otherwise(F.concat(F.lit("Known"), "k")).alias("building_name"), "lat", "lon", F.when(k % 3 == 0, F.col("rera_no")).otherwise("").alias("rera_norm"), k.alias("seq"),
    )
    found = s.select(F.concat(F.lit("a:"), "k").alias("cid"), *(empty.alias(c) for c in ("builder", "rera_no", "possession", "price_sqft")), F.when(k % 2 == 0, "₹1 Cr").otherwise("").alias("price"))
    return register, known, found


def _listings(register: DataFrame) -> DataFrame:
    empty = F.lit("")
    return register.select(
        F.col("s_suppkey").alias("seq"), F.concat(F.lit("https://l.in/"), "k").alias("url"), F.lit("housing").alias("site"), F.upper("name").alias("name"), F.concat(F.lit("Loc "), "k").alias("locality"),
        *(empty.alias(c) for c in ("builder", "rera_no", "price_sqft", "possession")), F.when(F.col("s_suppkey") % 5 == 0, "₹90 L").otherwise("").alias("price"),
    )


@query("""select s_suppkey::varchar as key, case s_suppkey % 3 when 0 then 'Yes (same RERA number)' when 1 then 'Yes (name match 1.00, 0.0 km)' else '' end as onboarded,
    case s_suppkey % 3 when 0 then 'Known' || s_suppkey when 1 then 'Crest' || s_suppkey else '' end as onboarded_as, case when s_suppkey % 2 = 0 then '₹1 Cr' else '' end as price from supplier where s_suppkey % 7 <> 0""")
def register_matches(spark, sf_dir):
    register, known, found = _projects(spark, sf_dir)
    return discovery.register_set(register, known, found).select("key", "onboarded", "onboarded_as", "price")


@query("""select case when s_suppkey % 7 <> 0 then 'Crest' || s_suppkey else 'CREST' || s_suppkey end as name, case when s_suppkey % 7 <> 0 then 'RERA register + listing sites' else 'listing sites (housing)' end as found_in,
    case when s_suppkey % 7 <> 0 then 'P02' || lpad(s_suppkey::varchar, 9, '0') else '' end as rera_id, case when s_suppkey % 5 = 0 then '₹90 L' when s_suppkey % 7 <> 0 and s_suppkey % 2 = 0 then '₹1 Cr' else '' end as price
    from supplier where s_suppkey % 3 = 2 or (s_suppkey % 7 = 0 and s_suppkey % 3 = 0)""")
def new_projects(spark, sf_dir):
    """Registered and listed projects that are not on file; the localities past the 440th have no coordinates."""
    register, known, found = _projects(spark, sf_dir)
    geo = register.where("s_suppkey < 440").select(F.concat(F.lit("loc "), "k").alias("lkey"), "lat", "lon")
    a = discovery.register_set(register, known, found)
    c = discovery.listing_set(_listings(register), known, geo, a, 10.0)
    new = discovery.all_new(discovery.with_listing_values(a, c), c)
    return new.select(F.col("Project Name").alias("name"), F.col("Found In").alias("found_in"), F.col("RERA ID").alias("rera_id"), F.col("Price").alias("price"))


@query("""with s as (select s_suppkey as k, s_suppkey % 7 <> 0 as a, s_suppkey % 2 = 0 as twin from supplier where s_nationkey % 4 <> 0)
    select k::varchar as cid, case when a then 'Yes' else 'No' end as in_set_a, case when a then case when twin then 'P03' else 'P02' end || lpad(k::varchar, 9, '0') else '' end as rera_no,
        case when a then case when twin then 'T' else 'B' end || k else '' end as builder,
        case when k % 3 = 1 then 'Yes (name match 1.00, 0.0 km)' when k % 3 = 0 and a and not twin then 'Yes (same RERA number)' else '' end as onboarded from s""")
def place_matches(spark, sf_dir):
    """Map places where the projects stand; some are cafes. Every project has a twin of its name, which the register lists before it if its key is even, else after it."""
    register, known, found = _projects(spark, sf_dir)
    k = F.col("s_suppkey")
    twins = register.withColumns({"key": F.concat(F.lit("t"), "k"), "seq": F.when(k % 2 == 0, -k).otherwise(k + 1_000_000_000), "promoter": F.concat(F.lit("T"), "k"), "rera_no": F.concat(F.lit("P03"), F.lpad("k", 9, "0"))})
    category = F.when(F.col("s_nationkey") % 4 == 0, "Cafe").otherwise("Apartment building")
    nations = _t(spark, sf_dir, "supplier").select("s_suppkey", category.alias("category"))
    places = register.join(nations, "s_suppkey").select(F.col("k").alias("cid"), F.col("name").alias("title"), "category", F.lit("x").alias("address"), "lat", "lon", F.lit(4.1).alias("rating"), F.lit(10).alias("reviews"), F.lit("q").alias("query"))
    b = discovery.place_set(places, known, found, discovery.register_set(register.unionByName(twins), known, found), 10.0)
    return b.select("cid", "in_set_a", "rera_no", "builder", "onboarded")
