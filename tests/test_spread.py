"""Narrow tables of few bytes are worked on by several tasks, and shared values are worked out once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidentia import worked
from evidentia.functions import dates
from evidentia.functions import text as T
from evidentia.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["snippet_facts", "snippet_prices", "entity_rows"])
def test_rows_of_one_file_are_dealt_to_tasks(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() > 1


def test_register_dates_and_pairs_read_snippets_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(worked, "materialize", lambda df, name, write=worked.materialize: names.append((name, df.rdd.getNumPartitions())) or write(df, name), raising=False)
    read = []
    monkeypatch.setattr(worked.evidence, "register_pairs", lambda found, *a, by=worked.evidence.register_pairs: read.append(found) or by(found, *a))
    QUERIES["registry_pairs"](spark, SF)
    assert [n for n, _ in names] == ["snippets", "dates"] and names[0][1] > 1
    assert "regexp" not in read[0]._jdf.queryExecution().optimizedPlan().toString().lower()  # a written table, not the work itself


def test_the_window_after_a_keyword_is_cut_once(spark):
    plan = spark.createDataFrame([("",)], "v string").select(dates.keyword_hits(F.concat(F.col("v"), F.lit("needle")), dt.date(2025, 6, 15)).alias("h"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("launch|registration") == 1 and plan.count("needle") == 1


@pytest.mark.parametrize("rx", [r"(?i)\bab?\b", r"(a)(b)?", r"(?<!x)a", "b\n|a"])
def test_occurrences(spark, rx):
    import re

    texts = ["", "ab a\nb A xa", "b\nb\na😀ab", "none", "a" * 50 + "\nab"]
    got = [r.o for r in spark.createDataFrame([(t,) for t in [*texts, None]], "v string").coalesce(1).select(T.occurrences(F.col("v"), rx).alias("o")).collect()]
    assert [[(x.pos, x.match) for x in o] for o in got] == [[(m.start(), m.group()) for m in re.finditer(rx, t)] for t in texts] + [[]]


def test_demoted_pages_are_found_by_sorting(spark):
    """Tables of all pages, partial and final, would be held in a task's memory at once."""
    plan = QUERIES["namesake_demote"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "min(gap" in line]
    assert lines and all("SortAggregate" in line for line in lines)
