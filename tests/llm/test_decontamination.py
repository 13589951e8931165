"""Planted benchmark items are found, wherever they stand; other documents stay."""

import random

import numpy as np

from evidentia.llm import decontamination

WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for i in range(900)]


def test_planted_items_and_only_those(spark):
    rng = random.Random(5)

    def prose(n):
        return rng.choices(WORDS, k=n)

    items = [prose(rng.randint(24, 50)) for _ in range(12)]
    docs, planted = [(100 + i, " ".join(prose(rng.randint(1, 300)))) for i in range(80)], set()
    for i, item in enumerate(items):
        near = [w for j, w in enumerate(item) if j % 7 != 3]  # six words of seven
        for j, (copy, at) in enumerate(((item, 0), (item, 113), (near, 60))):
            around = prose(at), prose((0, 41, 150)[(i + j) % 3])
            docs.append((1000 + 10 * i + j, " ".join([*around[0], *copy, *around[1]]).upper()))
            planted.add((1000 + 10 * i + j, i))
    docs += [(1, None), (2, ""), (3, " \n"), (None, "short one")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*((i, " ".join(x)) for i, x in enumerate(items)), (50, None), (51, "")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, bench).collect()}
    assert found == planted
    left = {r.doc_id for r in decontamination.clean(frame, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in planted}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(docs, none).count() == 0
    assert decontamination.clean(docs, none).count() == 1
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0


def test_long_items_against_brute_force(spark, monkeypatch):
    """Far more passages than the rank, in two blocks: copies of every kind are found as by comparing each pair."""
    monkeypatch.setattr(decontamination, "RANK", 40)
    monkeypatch.setattr(decontamination, "PASSAGES", 250)
    rng = random.Random(8)
    words = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=7)) for i in range(6000)]
    items = [rng.choices(words, k=rng.randint(200, 280)) for _ in range(24)]
    docs = [rng.choices(words, k=300) for _ in range(20)]
    for item in items:
        for share, spaced in ((1.0, False), (0.77, False), (0.63, False), (0.5, False), (1.0, True), (0.8, True)):
            kept = [w if i >= len(item) - 5 or rng.random() < share else rng.choice(words) for i, w in enumerate(item)]
            kept = [x for w in kept for x in (w, rng.choice(words))] if spaced else kept
            docs.append([*rng.choices(words, k=rng.randint(0, 40)), *kept, *rng.choices(words, k=20)])
    texts = [" ".join(x) for x in docs]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    number = {w: i for i, w in enumerate(words)}
    coded = [[np.array([number[w] for w in x]) for x in part] for part in (items, docs)]
    brute = {(d, i) for i, item in enumerate(coded[0]) for d, doc in enumerate(coded[1]) if len(np.intersect1d(item, doc)) > 50 and decontamination.judge(item, doc)[2]}
    assert len(brute) > 60
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, bench).collect()} == brute


def test_blocks_close_by_passages_and_keep_items_whole(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASSAGES", 2560)
    texts = ["word " * 12 * 2000, "word " * 12 * 700, "word " * 12 * 3000, *["a b c"] * 3000]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert [len(ids) for ids, _ in decontamination._blocks(bench)] == [1, 1, 1, 2560, 440]


def brute(docs, items):
    """Every window of every text judged against every item that has enough of its words there."""
    found = set()
    for d, text in docs:
        h, _ = decontamination._hashes([(text or "").lower().encode()])
        there = set(h.tolist())
        for i, item in items:
            words, _ = decontamination._hashes([(item or "").lower().encode()])
            if not len(words) or sum(x in there for x in words.tolist()) < decontamination.PARAPHRASE * len(words):
                continue
            for w in range(int(decontamination.windows(np.array([len(h)]))[0])):
                if decontamination.judge(words, decontamination.around(h, 6 * w, words))[2]:
                    found.add((d, i))
                    break
    return found


def test_real_tables_against_brute_force(spark):
    """All documents by all items of sf0.01, and paraphrases of the items: the rank is below the passages, recall is at least 0.98."""
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    rng = random.Random(4)
    prose = [w for _, text in docs[:50] for w in (text or "").split()]
    for i, item in items:
        for j, share in enumerate((0.95, 0.85, 0.75, 0.65)):
            words = [w if rng.random() < share else rng.choice(prose) for w in item.split()]
            docs.append((10**6 + 10 * i + j, " ".join([*rng.choices(prose, k=rng.randrange(60)), *words, *rng.choices(prose, k=rng.randrange(60))])))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    space = decontamination.fit_space(bench, *decontamination.document_frequencies(frame))
    passages = sum(len(decontamination.passages_of(len(decontamination._hashes([t.lower().encode()])[0]))) for _, t in items)
    assert space.weighted.shape[1] <= passages // 2
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, bench).collect()}
    expected = brute(docs, items)
    assert len(expected) > 100
    assert found <= expected
    assert len(found) >= 0.98 * len(expected)


def test_order_and_neighbours_change_nothing(spark):
    """Items spread by filler words, in rows of any order and partitioning."""
    rng = random.Random(6)
    items = [rng.choices(WORDS, k=40) for _ in range(5)]
    docs = []
    for i in range(120):
        words = [x for w in items[i % 5] for x in (w, *rng.choices(WORDS, k=rng.choice((0, 0, 1, 2))))]
        docs.append((i, " ".join([*rng.choices(WORDS, k=rng.randrange(50)), *words])))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    seen = []
    for parts in (1, 5):
        rng.shuffle(docs)
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
        seen.append({tuple(r) for r in decontamination.find_leaks(frame, bench).collect()})
    assert seen[0] == seen[1]


def test_odd_rows(spark):
    """Repeated rows and items, very long texts, and columns whose names clash with those of the result."""
    item = " ".join(WORDS[:30])
    long = " ".join(random.Random(2).choices(WORDS[100:], k=200_000))
    docs = [(1, item, "x", 0.5), (1, item, "x", 0.5), (2, long, None, None), (3, f"{long} {item}", "y", None), (4, None, "z", 1.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string, coverage double")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "?!"), (None, item)], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, bench).collect())
    assert found == [(1, 7)] * 4 + [(3, 7)] * 2
    left = decontamination.clean(frame, bench)
    assert left.columns == frame.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 4]
