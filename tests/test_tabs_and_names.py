import pytest
from pyspark.sql import functions as F

from evidentia.functions import text as T
from evidentia.operators.evidence import web_names
from evidentia.plans.report import table_counts, write_tabs


def test_first_builder_and_number_of_results_about_the_entity(spark):
    rows = [
        (1, 1, "https://a.example", "Aurelia Heights by May 2025 | flats", None),
        (1, 3, "https://a.example", "Aurelia Heights by Vasavi Group | Kokapet", "P02400001234"),
        (1, 2, "https://own.example", "Aurelia Heights by Own Homes", "P02400000001"),
        (1, 4, None, "Aurelia Heights by Later Ltd, Kokapet", "P02400009999"),
        (2, 1, "https://a.example", "Quartz Towers by Other in Kokapet", "P02400005555"),
        (3, 1, None, None, None),
    ]
    results = spark.createDataFrame(rows, "gkey long, seq long, url string, title string, snippet string")
    m = T.matcher(F.lit("Aurelia Heights"), F.lit("Kokapet"), F.lit("Hyderabad"), F.array().cast("array<string>"))
    found = web_names(results.withColumn("m", m), own=("own.example",))
    assert sorted(map(tuple, found.collect())) == [(1, "Vasavi Group", "P02400001234"), (2, "", ""), (3, "", "")]
    assert web_names(results.where("false").withColumn("m", m)).count() == 0


def test_tabs_are_folders(spark, tmp_path):
    some, none = spark.createDataFrame([(1, 'a "b", c')], "k long, v string"), spark.createDataFrame([], "k long, v string")
    folders = write_tabs({"A - new": some, "Summary": none}, str(tmp_path))
    assert set(folders) == {"A - new", "Summary"} and folders["A - new"].endswith("/A_-_new")
    back = spark.read.option("header", True).option("escape", '"').csv(folders["A - new"])
    assert [tuple(r) for r in back.collect()] == [("1", 'a "b", c')]
    assert spark.read.option("header", True).csv(folders["Summary"]).columns == ["k", "v"]
    with pytest.raises(ValueError, match="share a folder"):
        write_tabs({"a b": some, "A/B": some}, str(tmp_path))


def test_counts_of_tables(spark):
    t = spark.createDataFrame([(1, True), (2, None), (3, False)], "k long, x boolean")
    found = table_counts({"t": (t, {"x": F.col("x")}), "none": (t.where("false"), {"x": F.col("x")})})
    assert {r.Metric: r.Value for r in found.collect()} == {"t": 3, "t: x": 1, "none": 0, "none: x": 0}
