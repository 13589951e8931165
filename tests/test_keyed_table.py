"""Keyed tables with several writers, and the stream of candidates that keeps its state in them."""

import datetime as dt
import random
import tempfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidentia.operators.fusion import date_fusion
from evidentia.operators.keyed_table import KeyedTable
from evidentia.streaming import ingest

TODAY = dt.date(2026, 6, 1)


def rows_of(table):
    return sorted(map(tuple, table.current().collect()), key=str)


def test_upserts_removals_and_new_columns(spark):
    t = KeyedTable(spark, f"{tempfile.mkdtemp()}/t", ["k"], buckets=8)
    assert t.current() is None and t.version() == -1 and t.lookup(spark.range(1).selectExpr("1 as k")) is None
    assert t.write(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")) == 0
    t.write(spark.createDataFrame([(2, "c"), (3, "d"), (None, "m")], "k int, v string"))
    assert rows_of(t) == sorted([(1, "a"), (2, "c"), (3, "d"), (None, "m")], key=str)
    t.write(spark.createDataFrame([(3, 7.0)], "k long, w double"))
    assert rows_of(t) == sorted([(1, "a", None), (2, "c", None), (3, None, 7.0), (None, "m", None)], key=str)
    t.remove(spark.createDataFrame([(1,), (None,), (99,)], "k long"))
    assert rows_of(t) == sorted([(2, "c", None), (3, None, 7.0)], key=str)
    t.write(spark.createDataFrame([(1, "z")], "k long, v string"))
    assert sorted(r.k for r in t.lookup(spark.createDataFrame([(1,), (2,)], "k int")).collect()) == [1, 2]
    before = rows_of(t)
    assert t.compact(2) and rows_of(t) == before and not t.compact(2)
    t.vacuum(older_s=-1, versions=1)
    assert rows_of(t) == before == sorted([(1, "z", None), (2, "c", None), (3, None, 7.0)], key=str)
    with pytest.raises(ValueError, match="8 buckets"):
        KeyedTable(spark, t.path, ["k"], buckets=4).current()
    with pytest.raises(ValueError, match="_run"):
        t.write(spark.createDataFrame([(1, "x")], "k long, _run string"))


def test_of_rows_of_one_key_the_latest_holds(spark):
    from pyspark.sql import functions as F

    t = KeyedTable(spark, f"{tempfile.mkdtemp()}/t", ["k"], buckets=2)
    t.write(spark.createDataFrame([(1, "a", 3), (1, "b", 9), (1, "c", 5), (2, "d", 1)], "k long, v string, at int"), F.col("at"))
    assert rows_of(t) == [(1, "b", 9), (2, "d", 1)]
    empty = KeyedTable(spark, f"{tempfile.mkdtemp()}/t", ["k"], buckets=2)
    empty.write(spark.createDataFrame([], "k long, v string"))
    assert rows_of(empty) == []


def test_two_writers_at_once_lose_nothing(spark):
    path = f"{tempfile.mkdtemp()}/t"

    def write(who):
        t = KeyedTable(spark, path, ["k"], buckets=4)
        for i in range(6):
            t.write(spark.createDataFrame([(100 * who + i, f"{who}-{i}"), (-1, f"{who}-{i}")], "k long, v string"))
            if i == 3:
                t.compact(3)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    t = KeyedTable(spark, path, ["k"], buckets=4)
    got = dict(t.current().collect())
    assert {k: v for k, v in got.items() if k >= 0} == {100 * who + i: f"{who}-{i}" for who in range(3) for i in range(6)}
    assert got[-1] in {f"{who}-5" for who in range(3)}
    assert t.version() >= 17  # each write is a version of its own


def test_a_write_costs_what_its_rows_cost(spark):
    t = KeyedTable(spark, f"{tempfile.mkdtemp()}/t", ["k"], buckets=100)
    t.write(spark.range(50_000).selectExpr("id as k", "uuid() as v"))
    size = lambda: sum(p.stat().st_size for p in Path(t.path).rglob("*.parquet"))
    whole = size()
    few = t.current().where("k < 5")
    t.write(few)
    assert len(t.manifest()["runs"][1]["buckets"]) <= 5 and size() - whole < 0.02 * whole
    assert t.current().count() == 50_000
    # Only the buckets asked for are read: the files of all others may be broken.
    asked = few.select("k").collect()
    for p in Path(t.path).rglob("*.parquet"):
        if int(p.parent.name.split("=")[1]) not in t.manifest()["runs"][1]["buckets"]:
            p.write_bytes(b"broken")
            p.with_name(f".{p.name}.crc").unlink()
    assert t.lookup(spark.createDataFrame(asked, "k long")).count() == 5


def test_a_batch_is_written_once(spark):
    t = KeyedTable(spark, f"{tempfile.mkdtemp()}/t", ["k"], buckets=4)
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    assert t.write(one, writer="s", batch=4) == 0 and t.write(one, writer="s", batch=4) is None and t.write(one, writer="s", batch=3) is None
    assert t.write(one, writer="other", batch=0) == 1 and t.write(one, writer="s", batch=5) == 2


def candidates(seed, n, entities):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        domain = rng.choice(["housing.com", "99acres.com", "blog.example", "rera.example"])
        year, month = rng.choice([2025, 2026, 2027]), rng.choice([None, 1, 6, 12])
        out.append((f"g{rng.randrange(entities)}", f"https://{domain}/{rng.randrange(4)}", domain, year, month, "month" if month else "year", rng.choice(["snippet", "structured"]),
                    rng.randrange(1, 10) / 10, f"c{i}", domain.startswith("rera"), domain != "blog.example", "", seed * 10_000 + i))
    return out


def test_stream_with_restarts_equals_fusing_everything(spark, monkeypatch):
    monkeypatch.setattr(ingest, "COMPACT_EVERY", 2)
    home = tempfile.mkdtemp()
    source, state = f"{home}/in", f"{home}/state"
    run = lambda: ingest.follow_candidates(spark, source, state, f"{home}/cp", TODAY, buckets=8).awaitTermination()
    add = lambda seed: spark.createDataFrame(candidates(seed, 120, 20), ingest.CANDIDATES).coalesce(1).write.mode("append").parquet(source)
    add(1)
    run()
    add(2)
    # The second batch ends after its candidates are kept, before its verdicts are.
    broken = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with monkeypatch.context() as m:
        m.setattr(ingest, "date_fusion", broken)
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    add(3)
    run()
    run()
    every = spark.createDataFrame([r for seed in (1, 2, 3) for r in candidates(seed, 120, 20)], ingest.CANDIDATES)
    stored = ingest.candidate_table(spark, state, 8).current()
    assert stored.count() == every.count() == 360
    expected = sorted(map(str, date_fusion(every, TODAY).collect()))
    assert sorted(map(str, ingest.verdict_table(spark, state, 8).current().select(date_fusion(every, TODAY).columns).collect())) == expected


def test_a_batch_touches_only_its_entities_buckets(spark):
    home = tempfile.mkdtemp()
    run = lambda: ingest.follow_candidates(spark, f"{home}/in", f"{home}/state", f"{home}/cp", TODAY, buckets=64).awaitTermination()
    spark.createDataFrame(candidates(1, 600, 300), ingest.CANDIDATES).write.mode("append").parquet(f"{home}/in")
    run()
    spark.createDataFrame(candidates(2, 2, 300), ingest.CANDIDATES).coalesce(1).write.mode("append").parquet(f"{home}/in")
    run()
    for table in (ingest.candidate_table(spark, f"{home}/state", 64), ingest.verdict_table(spark, f"{home}/state", 64)):
        first, second = table.manifest()["runs"]
        assert len(first["buckets"]) > 50 and len(second["buckets"]) <= 2


def test_rows_are_dealt_once_on_their_way_to_verdicts(spark):
    """One shuffle writes candidates; one of them and one of the keys asked for lead to the verdicts, with another where the register's are read apart."""
    home = tempfile.mkdtemp()
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    table, written, plain = ingest.candidate_table(spark, home, 4), [], KeyedTable._write_run
    table._write_run = lambda rows, gone: written.append(exchanges(rows)) or plain(table, rows, gone)
    for seed in (1, 2):
        rows = spark.createDataFrame(candidates(seed, 120, 20), ingest.CANDIDATES)
        table.write(rows, F.struct("score", "kind", "context"))
        every = table.lookup(rows.select("gkey"))
        assert exchanges(every) == 2 and exchanges(date_fusion(every, TODAY, dealt=True)) == 4
    assert written == [1, 1]
    every = spark.createDataFrame([r for seed in (1, 2) for r in candidates(seed, 120, 20)], ingest.CANDIDATES)
    found = date_fusion(table.lookup(every.select("gkey")), TODAY, dealt=True)
    assert sorted(map(str, found.collect())) == sorted(map(str, date_fusion(every, TODAY).collect()))
