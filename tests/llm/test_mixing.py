import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.llm.mixing import GROUP, mix, targets, word_count

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, source string, copies string"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    want, full = share * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        level = (want - sum(most * sizes[s] for s in full)) / (sum(weight[s] for s in open_) or 1)
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return {s: most * sizes[s] if s in full else level * weight[s] for s in names}
        full.update(over)


def test_documents_near_targets_and_rerun(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mix(docs).collect()
    size = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == size and len(rows) == len(size)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sizes = {s: sum(r["size"] for r in own) for s, own in by.items()}
    want = brute_targets(sizes)
    for s, own in by.items():
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.01 * want[s] + 100
        assert all(0 <= r.taken <= 2 * r["size"] for r in own)
    assert sorted((r.doc_id, r.taken) for r in mix(docs.repartition(5)).collect()) == sorted((r.doc_id, r.taken) for r in rows)


def test_odd_rows(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, "a\tb\x0bc\u00a0d", None), (4, "a\tb\x0bc\u00a0d", None), (None, "a b", "x"), (5, "w " * 100_000, "z")]
    out = mix(spark.createDataFrame([(*r, "c") for r in rows], DOCS)).collect()
    assert len(out) == len(rows) and {r.doc_id: r["size"] for r in out} == {1: 3, 2: 0, 3: 0, 4: 3, None: 2, 5: 100_000}
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def test_targets_cascade(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 40, "é": 7000, None: 300, "zero": 0}
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in targets(frame).collect()}
    want = brute_targets(sizes)
    assert got == {s: pytest.approx(t) for s, t in want.items()}


def test_unbiased_over_groups(spark):
    """Several levels of the tree; each document's chance is its fraction."""
    n = 3 * GROUP
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.lit("s").alias("source"))
    taken = [mix(docs, seed=seed).select("doc_id", "copies", "size").toPandas() for seed in (1, 2)]
    for t in taken:
        assert abs((t.copies * t["size"]).sum() - 1.5 * t["size"].sum()) <= 7
        assert set(t.copies) == {1, 2}
        assert abs(t.groupby("size").copies.mean() - 1.5).max() < 0.06
    assert (taken[0].merge(taken[1], on="doc_id").eval("copies_x == copies_y").mean() - 0.5) < 0.1


def test_word_count(spark):
    row = spark.range(1).select(word_count(F.lit(" a\u00a0b \t c\r\nd ")).alias("n")).first()
    assert row.n == 3


def test_repeats_of_one_row_make_no_large_group(spark):
    from pyspark.sql import functions as F

    from evidentia.llm.mixing import GROUP, _dealt, _slot

    docs = spark.range(20_000).selectExpr("7L as doc_id", "'a b c' as text", "'s' as source").unionByName(spark.range(5000).selectExpr("id as doc_id", "'a b' as text", "'s' as source")).repartition(8)
    dealt = _dealt(docs.selectExpr("doc_id", "source", "cast(3 as long) as size"))
    assert dealt.count() == 25_000
    groups = dealt.groupBy(_slot(7, 1)).count().agg(F.max("count")).first()[0]
    assert groups <= 3 * GROUP and dealt.groupBy("doc_id", "chunk").count().agg(F.max("count")).first()[0] <= GROUP
    out = mix(docs)
    assert out.count() == 25_000
    total, target = out.agg(F.sum("taken"), F.max("target")).first()
    assert abs(total - target) <= 6 and out.where("taken > 2 * size").isEmpty()
    assert sorted(map(tuple, mix(docs).select("doc_id", "taken").collect())) == sorted(map(tuple, out.select("doc_id", "taken").collect()))
