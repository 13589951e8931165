"""Partial dates in text, sheet cells and page data, as column expressions.

``today`` is always an argument: it bounds the years that count (1950 to twelve
years ahead), and decides between "Under Construction" and "Ready to Move".
A partial date is ``struct<year, month, precision>``; month is null for a bare year.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import between, cell, let, occurrences, squeeze

DATE_TYPE = "struct<year:int,month:int,precision:string>"
PLACED_TYPE = "struct<start:int,rank:int,year:int,month:int,precision:string>"
PRECISIONS = ["day", "month", "quarter", "year"]

# The forms of months and days in dates.
_NAME = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DAY = r"(0?[1-9]|[12]\d|3[01])"
_MONTH = r"(0?[1-9]|1[0-2])"


def _numbers(first: int, last: int, digits: int) -> str:
    """A group that matches the numbers of a range, a branch for each ten."""
    tens = ((t, max(first, t * 10) % 10, min(last, t * 10 + 9) % 10) for t in range(first // 10, last // 10 + 1))
    return "(" + "|".join(f"{t:0{digits - 1}d}[{lo}-{hi}]" for t, lo, hi in tens) + ")"


def _patterns(today: dt.date) -> list[tuple[str, str, int, str]]:
    """Precision, pattern, group of the year, kind of the month. Only valid days, months and years match."""
    last = today.year + fixed.YEARS_AHEAD
    year = _numbers(fixed.MIN_YEAR, min(last, 2049), 4)
    short = _numbers(0, min(last, 2099) - 2000, 2)
    return [
        ("day", rf"(?i)\b{_DAY}(?:st|nd|rd|th)?[\s\-/.,]*{_NAME}[\s\-/.,']*{year}\b", 3, "name2"),
        ("month", rf"(?i)\b{_NAME}[\s\-/.,']*{year}\b", 2, "name1"),
        ("month", rf"(?i)\b{_NAME}\s*['’`]\s*{short}\b", 2, "name1"),
        ("day", rf"\b(?:{_DAY}[/\-.]{_MONTH}|{_MONTH}[/\-.]{_DAY})[/\-.]{year}\b", 5, "number2or3"),
        ("ymd", rf"\b{year}[/\-.]{_MONTH}(?:[/\-.](\d{{1,2}}))?\b", 1, "number2"),
        ("month", rf"(?<![\d/\-.]){_MONTH}[/\-]{year}\b", 2, "number1"),
        ("quarter", rf"(?i)\bQ([1-4])\s*[,\-']?\s*(?:FY\s*)?{year}\b", 2, "quarter1"),
        ("year", rf"\b{year}\b", 1, ""),
    ]


def placed_date(s: Column, today: dt.date) -> Column:
    """The first date in ``s`` with its place: earliest start, then finest precision; a bare year only if nothing else is there."""
    # Every form has a year of two digits at least.
    return let(s, lambda s: F.when(s.rlike("[0-9]{2}"), _placed_date(s, today)))


def _placed_date(s: Column, today: dt.date) -> Column:
    found = []
    for precision, rx, year_group, kind in _patterns(today):
        part = lambda g: F.regexp_extract(s, rx, g)  # noqa: B023, E731
        year = part(year_group).try_cast("int")
        year = F.when(year < 100, year + 2000).otherwise(year)
        if kind.startswith("name"):
            month = F.array_position(F.array(*map(F.lit, fixed.MONTHS)), F.lower(F.substring(part(int(kind[-1])), 1, 3))).cast("int")
        elif kind == "number2or3":
            month = F.coalesce(part(2).try_cast("int"), part(3).try_cast("int"))
        elif kind.startswith("number"):
            month = part(int(kind[-1])).try_cast("int")
        elif kind.startswith("quarter"):
            month = part(1).try_cast("int") * 3
        else:
            month = F.lit(None).cast("int")
        name = F.when(part(3) != "", "day").otherwise("month") if precision == "ymd" else F.lit(precision)
        rank = F.array_position(F.array(*map(F.lit, PRECISIONS)), name).cast("int")
        read = lambda start: F.when(start >= 0, F.struct(start.alias("start"), rank.alias("rank"), year.alias("year"), month.alias("month"), name.alias("precision")).cast(PLACED_TYPE))  # noqa: B023, E731
        found.append(let(F.regexp_instr(s, F.lit(rx)) - 1, read))
    return F.coalesce(F.array_min(F.filter(F.array(*found[:-1]), lambda d: d.isNotNull())), found[-1])


def first_date(s: Column, today: dt.date) -> Column:
    return let(placed_date(s, today), lambda d: F.when(d.isNotNull(), F.struct(d["year"].alias("year"), d["month"].alias("month"), d["precision"].alias("precision"))))


def epoch_date(v: Column, today: dt.date) -> Column:
    """Seconds (10 digits) or milliseconds (13) since 1970, UTC; precise to the month."""
    n = v.try_cast("long")
    at = F.timestamp_seconds(F.when(F.length(v) >= 13, F.floor(n / 1000).cast("long")).otherwise(n))
    ok = F.year(at).between(fixed.MIN_YEAR, today.year + fixed.YEARS_AHEAD)
    return F.when(ok, F.struct(F.year(at).alias("year"), F.month(at).alias("month"), F.lit("month").alias("precision")))


def keyword_hits(text: Column, today: dt.date) -> Column:
    """Every keyword followed within 60 characters by a date, before any stop word.

    ``array<struct<kind, weight, pos, year, month, precision, context>>`` in page order.
    """
    every = r"(?i)\b(?:" + "|".join(p for _, _, p in fixed.DATE_KEYWORDS) + r")\b"

    def kind_of(m: Column) -> Column:
        return F.coalesce(*(F.when(m.rlike(rf"(?i)^(?:{p})$"), F.struct(F.lit(k).alias("kind"), F.lit(w).alias("weight"))) for k, w, p in fixed.DATE_KEYWORDS))

    def in_text(text: Column) -> Column:
        def one(o: Column) -> Column:
            end = o["pos"] + F.length(o["match"])
            window = F.regexp_replace(between(text, end, end + fixed.WINDOW), "(?is)(?:" + fixed.STOP_PATTERN + ").*$", "")
            return F.struct(o["pos"].alias("pos"), o["match"].alias("match"), placed_date(window, today).alias("d"))

        def shown(h: Column) -> Column:
            context = squeeze(between(text, h["pos"] - 50, h["pos"] + F.length(h["match"]) + h["d"]["start"] + 25))
            row = lambda k: F.struct(k["kind"].alias("kind"), k["weight"].alias("weight"), h["pos"].alias("pos"), h["d"]["year"].alias("year"), h["d"]["month"].alias("month"), h["d"]["precision"].alias("precision"), context.alias("context"))
            return let(kind_of(h["match"]), row)

        hits = F.transform(occurrences(text, every), one)
        return F.transform(F.filter(hits, lambda h: h["d"].isNotNull() & ~((h["d"]["precision"] == "year") & (h["d"]["start"] > 25))), shown)

    return let(text, in_text)


def precision_factor(p: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in fixed.PRECISION_FACTOR.items() for x in pair)), p)


def date_key(year: Column, month: Column) -> Column:
    return F.when(month.isNull(), F.lpad(year.cast("string"), 4, "0")).otherwise(F.format_string("%04d-%02d", year.cast("int"), month.cast("int")))


def month_name(month: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, fixed.MONTH_NAMES)), month.cast("int"))


def display(year: Column, month: Column, precision: Column) -> Column:
    named = F.concat_ws(" ", month_name(month), year.cast("string"))
    quarter = F.concat(named, F.lit(" (Q"), (F.floor((month - 1) / 3) + 1).cast("string"), F.lit(")"))
    return F.when(month.isNull(), year.cast("string")).when(precision == "quarter", quarter).otherwise(named)


def ordinal(key: Column) -> Column:
    """Months since year 0 of a YYYY-MM key; null for a bare year."""
    return F.when(F.length(key) == 7, F.substring(key, 1, 4).try_cast("int") * 12 + F.substring(key, 6, 2).try_cast("int"))


def sheet_date(v: Column, today: dt.date) -> Column:
    """``struct<year, month>`` of a sheet cell: epoch, spreadsheet serial, text or a plain day; null if none."""

    def read(v: Column) -> Column:
        n = v.try_cast("double")
        epoch = F.timestamp_seconds(F.when(F.length(v) >= 12, F.floor(n / 1000)).otherwise(n).cast("long")).cast("date")
        serial = F.date_add(F.lit(dt.date(1899, 12, 30)), F.floor(n).cast("int"))
        bare = F.when(v.rlike(r"^\d{4}$"), F.make_date(v.try_cast("int"), F.lit(1), F.lit(1)))
        day = F.coalesce(*(F.try_to_timestamp(v, F.lit(f)) for f in ("d/M/yyyy", "d-M-yy", "d/M/yy"))).cast("date")
        at = F.when(v.rlike(r"^(?:\d{12,13}|\d{9,10})$"), epoch).when(v.rlike(r"^\d{5}(?:\.\d+)?$"), serial)
        worded = F.when(at.isNull(), first_date(v, today))
        return F.struct(at.alias("at"), F.coalesce(bare, day).alias("plain"), worded.alias("worded"))

    def choose(r: Column) -> Column:
        w, at, plain = r["worded"], r["at"], r["plain"]
        ym = lambda y, m: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"))
        valid = lambda d: F.when(F.year(d).between(fixed.MIN_YEAR, 2100), ym(F.year(d), F.month(d)))
        return F.when(at.isNotNull(), valid(at)).when(w["month"].isNotNull(), ym(w["year"], w["month"])).when(plain.isNotNull(), valid(plain)).when(w.isNotNull(), ym(w["year"], F.lit(12)))

    return let(cell(v), lambda c: let(read(c), choose))


def compare_dates(sheet: Column, iso: Column) -> Column:
    """``struct<shown, verdict, months>`` of the sheet's date against a found YYYY-MM or YYYY."""
    iso = F.coalesce(iso, F.lit(""))
    diff = ordinal(iso) - (sheet["year"] * 12 + sheet["month"])
    has = sheet.isNotNull()
    verdict = (
        F.when(iso == "", F.when(has, "No web date").otherwise(""))
        .when(~has, "No sheet date")
        .when(F.length(iso) == 4, F.when(iso.try_cast("int") == sheet["year"], "Same year").otherwise("Different year"))
        .when(diff == 0, "Match")
        .when(F.abs(diff) <= 3, "Close (within 3 months)")
        .otherwise(F.concat(F.lit("Web is "), F.abs(diff).cast("string"), F.when(diff > 0, " months later").otherwise(" months earlier")))
    )
    shown = F.when(has, F.concat_ws(" ", month_name(sheet["month"]), sheet["year"].cast("string"))).otherwise("")
    return F.struct(shown.alias("shown"), verdict.alias("verdict"), F.when(has, diff).alias("months"))
