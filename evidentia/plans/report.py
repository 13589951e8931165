"""Wide reports and summary metrics."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import compare_dates, sheet_date
from ..functions.money import compare_price, format_inr, sheet_price

# The headings of the reports' columns, here and in full_report.
POSSESSION_COLUMNS = {
    "display": "Possession Date", "iso": "Possession (YYYY-MM)", "precision": "Date Precision", "status": "Project Status",
    "label": "Confidence", "confidence": "Confidence Score", "sources": "Sources Agreeing", "rera_date": "RERA Date",
    "best_url": "Best Source", "evidence": "Evidence", "alternatives": "Other Dates Seen", "queries": "Queries Run", "note": "Scrape Note",
}


def possession_report(rows: DataFrame) -> DataFrame:
    return rows.select("row_idx", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in POSSESSION_COLUMNS.items()))


def full_report(rows: DataFrame, today: dt.date) -> DataFrame:
    """Confirmed (High, Medium) apart from unconfirmed (Low) answers, and both against the sheet."""
    done = F.col("label").isNotNull()
    sure, low = F.col("found") & F.col("label").isin("High", "Medium"), F.col("found") & (F.col("label") == "Low")
    priced, cheap = F.coalesce(F.col("price_label").isin("High", "Medium"), F.lit(False)), F.coalesce(F.col("price_label") == "Low", F.lit(False))
    lo, hi = sheet_price(F.col("sheet_min")), sheet_price(F.col("sheet_max"))
    when = lambda cond, c: F.coalesce(F.when(cond, F.col(c).cast("string")), F.lit(""))
    against = compare_dates(sheet_date(F.col("existing"), today), F.when(sure, F.col("iso")))
    shown = F.array_distinct(F.filter(F.array(lo, hi), lambda p: p.isNotNull()))
    columns = {
        "Possession Date": F.when(F.col("label") == "Skipped", "Skipped - not a project").when(sure, F.col("display")).when(done, "Not found").otherwise(""),
        "Possession (YYYY-MM)": when(sure, "iso"), "Project Status": when(sure, "status"), "Possession Confidence": when(done, "label"),
        "Possession Source URL": when(sure, "best_url"), "Possession Evidence": when(sure, "evidence"), "RERA Date": when(sure, "rera_date"),
        "Price": F.when(priced, F.coalesce("price_display", F.lit(""))).when(done & ~cheap, "Not found").otherwise(""),
        "Price Min (Rs)": when(priced, "price_min"), "Price Max (Rs)": when(priced, "price_max"), "Price per sq.ft": when(priced, "price_sqft"),
        "Price Confidence": F.when(done, F.coalesce("price_label", F.lit("Not found"))).otherwise(""), "Price Source URL": when(priced, "price_url"),
        "Price Evidence": when(priced, "price_evidence"), "Sheet Completion Date": against["shown"], "Web vs Sheet (date)": against["verdict"],
        "Date Difference (months)": F.coalesce(against["months"].cast("string"), F.lit("")),
        "Sheet Price": F.array_join(F.transform(shown, format_inr), " - "),
        "Web vs Sheet (price)": compare_price(lo, hi, F.when(priced, F.col("price_min").cast("double"))),
        "Unconfirmed Possession (check)": when(low, "display"), "Unconfirmed Possession Source": when(low, "best_url"),
        "Unconfirmed Price (check)": F.when(cheap, F.coalesce("price_display", "price_sqft", F.lit(""))).otherwise(""), "Unconfirmed Price Source": when(cheap, "price_url"),
        "Other Dates Seen": when(done, "alternatives"), "Other Prices Seen": when(done, "price_alternatives"), "Searches Used": when(done, "queries"), "Note": when(done, "note"),
    }
    return rows.select("row_idx", *(c.alias(k) for k, c in columns.items()))


def summary(rows: DataFrame) -> DataFrame:
    """Counts as ``Metric, Value`` rows."""
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    metrics = {
        "Rows": F.count("*"),
        "Dates found": n(F.col("found")),
        "Dates confirmed (High or Medium)": n(F.col("found") & F.col("label").isin("High", "Medium")),
        "Dates unconfirmed (Low)": n(F.col("found") & (F.col("label") == "Low")),
        "Prices confirmed": n(F.col("price_label").isin("High", "Medium")),
        "Skipped": n(F.col("label") == "Skipped"),
        "Searches": F.coalesce(F.sum("queries"), F.lit(0)),
    }
    return rows.agg(*(c.cast("long").alias(k) for k, c in metrics.items())).unpivot([], list(metrics), "Metric", "Value")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_tabs(tabs: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Each table as CSV in a folder of its own below ``path``, named by its tab; gives the folders.

    Letters, digits, dots, dashes and underscores of a name stay, all else becomes an
    underscore; two tabs of one folder are an error. An empty table leaves its header.
    """
    folders = {name: f"{path.rstrip('/')}/{re.sub(r'[^A-Za-z0-9._-]+', '_', name).strip('_')}" for name in tabs}
    if len({f.lower() for f in folders.values()}) < len(tabs):
        raise ValueError(f"tabs share a folder: {sorted(tabs)}")
    for name, df in tabs.items():
        write_csv(df, folders[name])
    return folders


def table_counts(tables: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """``Metric, Value`` rows: the rows of each table, and of those that meet each named condition (null: not met)."""
    out = None
    for name, (df, conditions) in tables.items():
        counts = {name: F.count("*"), **{f"{name}: {k}": F.count_if(F.coalesce(c, F.lit(False))) for k, c in conditions.items()}}
        one = df.agg(*(c.alias(k) for k, c in counts.items())).unpivot([], [F.col(f"`{k}`") for k in counts], "Metric", "Value")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out
