"""Second look at doubtful rows by an outside model: selection, prompts, spending and its recorded verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dates import display


def select_rows(results: DataFrame, scope: str = "unsure") -> DataFrame:
    r = results.where(F.coalesce(F.col("note"), F.lit("")) != "empty building name")
    wanted = {"all": F.lit(True), "notfound": ~F.col("found"), "unsure": ~F.col("found") | (F.col("label") == "Low")}
    return r.where(wanted[scope])


def prompt(name: Column, place: Column, snippets: Column, dates: Column) -> Column:
    """Evidence as text: one line for each snippet and date."""
    lines = F.transform(snippets, lambda s: F.concat_ws(" | ", s["title"], s["url"], s["snippet"]))
    seen = F.transform(dates, lambda d: F.concat_ws(" | ", d["date"], d["kind"], d["url"], d["text"]))
    return F.concat_ws("\n", F.concat(F.lit("Building: "), name), F.concat(F.lit("Place: "), place), F.lit("Search results:"), F.array_join(lines, "\n"), F.lit("Dates found:"), F.array_join(seen, "\n"))


def estimate_usd(chars: Column, usd_in: float, usd_out: float, batch: bool = False) -> Column:
    """Expected price of a row; ``usd_*`` for a million tokens."""
    tokens = chars / fixed.TOKENS_PER_CHAR + fixed.PROMPT_TOKENS
    usd = (tokens * usd_in + (400 if batch else 1200) * usd_out) / 1e6
    return usd * fixed.BATCH_DISCOUNT if batch else usd + 1.5 * fixed.SEARCH_USD


def spend(usage: DataFrame, price: DataFrame) -> DataFrame:
    """Tokens and dollars by model. ``usage``: model, input, output, cache_write, cache_read, searches, batch; ``price``: model, usd_in, usd_out."""
    tokens_in = F.col("input") + fixed.CACHE_WRITE * F.col("cache_write") + fixed.CACHE_READ * F.col("cache_read")
    usd = (tokens_in * F.col("usd_in") + F.col("output") * F.col("usd_out")) / 1e6
    usd = F.when(F.col("batch"), usd * fixed.BATCH_DISCOUNT).otherwise(usd) + F.col("searches") * fixed.SEARCH_USD
    return usage.join(price, "model").groupBy("model").agg(F.sum(tokens_in).alias("tokens_in"), F.sum("output").alias("tokens_out"), F.sum("searches").alias("searches"), F.sum(usd).alias("usd"))


def normalise_verdict(date: Column) -> Column:
    """``struct<iso, display>`` of a model's date; anything but YYYY-MM or YYYY becomes empty."""
    month = F.substring(date, 6, 2).try_cast("int")
    ok = date.rlike(r"^\d{4}-(?:0[1-9]|1[0-2])$") | date.rlike(r"^\d{4}$")
    shown = display(F.substring(date, 1, 4).try_cast("int"), F.when(F.length(date) == 7, month), F.lit("month"))
    return F.struct(F.when(ok, date).otherwise("").alias("iso"), F.coalesce(F.when(ok, shown), F.lit("")).alias("display"))


def final_answer(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review verdicts, where there are any, before our own."""
    r = reviews.select("row_idx", F.col("iso").alias("review_iso"))
    return results.join(r, "row_idx", "left").withColumn("final_iso", F.coalesce(F.nullif("review_iso", F.lit("")), "iso"))
