"""Work selection, budgets and rows that replace others by key; ``keyed_table`` keeps such rows in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def todo(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(done.select(*key), key, "left_anti")


def done_rows(results: DataFrame, retry: str | None = None) -> DataFrame:
    """Finished rows under a retry mode: missing, low, skipped-only, incomplete, or all."""
    label, found = F.col("label"), F.coalesce("found", F.lit(False))
    conditions = {
        None: F.lit(True),
        "missing": found,
        "low": found & label.isin("High", "Medium"),
        "skipped-only": label == "Skipped",
        "incomplete": (label == "Skipped") | (found & label.isin("High", "Medium") & F.col("price_min").isNotNull() & F.col("price_label").isin("High", "Medium"))
        if "price_min" in results.columns
        else (label == "Skipped") | (found & label.isin("High", "Medium")),
    }
    return results.where(conditions[retry])


def work_order(searched: Column, metro: Column, dated: Column) -> list[Column]:
    """Unsearched rows first, metros before others, rows without a date before dated ones."""
    return [F.asc(searched), F.desc(metro), F.asc(dated)]


def budget_prefix(df: DataFrame, cost: Column, budget: float, order: list[Column], block: Column) -> DataFrame:
    """Rows in order while their costs, all positive, add up to ``budget`` at most.

    ``block`` is a monotone coarse form of the order (a day, an id range): blocks are
    summed first, so no task sorts the whole table.
    """
    sized = df.withColumns({"_cost": cost, "_block": block})
    sums = sized.groupBy("_block").agg(F.sum("_cost").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select("_block", before.alias("_before"))
    inside = F.sum("_cost").over(Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sized.join(sums, "_block").withColumn("running", F.col("_before") + inside).where(F.col("running") <= budget).drop("_cost", "_block", "_before")


def chunks(df: DataFrame, order: Column, block: Column, size: int = 10_000) -> DataFrame:
    """Adds ``chunk``: 0, 1, ... for each ``size`` rows in order."""
    sized = df.withColumn("_block", block)
    counts = sized.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_block", before.alias("_before"))
    n = F.row_number().over(Window.partitionBy("_block").orderBy(order)) + F.col("_before") - 1
    return sized.join(counts, "_block").withColumn("chunk", F.floor(n / size).cast("long")).drop("_block", "_before")


def propagate_found(results: DataFrame) -> DataFrame:
    """Each row key's latest found verdict for all rows of the key; others keep their own."""
    latest = results.where("found").groupBy("rkey").agg(F.max_by(F.struct("label", "iso"), F.struct("updated", "row_idx")).alias("v"))
    out = results.join(latest, "rkey", "left")
    return out.withColumns({"label": F.coalesce("v.label", "label"), "iso": F.coalesce("v.iso", "iso"), "found": F.col("found") | F.col("v").isNotNull()}).drop("v")
