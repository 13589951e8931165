import random
from collections import defaultdict

import pytest

from evidentia.llm.components import connected_components
from evidentia.llm.near_dedup import near_duplicates

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, source string, component_id string, kept string"


def brute(rows, k, percent):
    """Exact sets, every pair that shares a shingle, union by smallest id."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    shared = defaultdict(int)
    for ids in by.values():
        ids = sorted(ids)
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                shared[a, b] += 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), both in shared.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_documents_match_brute_force(spark, k, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], k, percent)
    assert result(near_duplicates(docs, k, percent)) == expected


def test_chains_and_families(spark):
    """Near copies that drift, so that the ends of a chain aren't alike, and families just below the threshold."""
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(9):
            rows.append((n, " ".join(words), "s", "x", "y"))
            n += 1
            words = list(words)
            words[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
            if rng.random() < 0.4:
                words[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
    docs = spark.createDataFrame(rows, DOCS)
    assert result(near_duplicates(docs, 3, 85)) == brute([r[:2] for r in rows], 3, 85)


def test_large_family_around_the_threshold(spark):
    """Copies of one text with up to nine edits, edits of edits, and copies with parts cut off: most pairs are just below the threshold."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]

    def edited(words, many):
        words = list(words)
        for _ in range(many):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        return words

    middle = [edited(base, 5) for _ in range(12)]
    texts = [edited(base, rng.randrange(3, 10)) for _ in range(350)] + [edited(rng.choice(middle), rng.randrange(5)) for _ in range(250)]
    texts += [base[rng.randrange(40) : 160 - rng.randrange(40)] for _ in range(150)]
    rows = [(i, " ".join(t), "s", "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    assert result(near_duplicates(docs, 3, 85)) == brute([r[:2] for r in rows], 3, 85)
    assert result(near_duplicates(docs, 5, 80)) == brute([r[:2] for r in rows], 5, 80)


def test_two_texts_of_one_document(spark):
    """Rows that share a doc_id are one vertex: what links with either text is linked."""
    words = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    rows = [(9, " ".join(words)), (7, " ".join(words[:59])), (7, " ".join(other)), (8, " ".join(other[1:])), (3, "on its own")]
    for given in (rows, rows[::-1]):
        found = near_duplicates(spark.createDataFrame(given, "doc_id long, text string"), 3, 85).collect()
        assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (7, 7), (7, 7), (8, 7), (9, 7)]


def test_odd_rows(spark):
    rows = [
        (5, "A b C"), (3, "a B c"), (9, "a b"), (8, "A  B"), (1, ""), (2, None), (7, " \t\n"),
        (4, "x " * 50_000 + "end"), (6, "x " * 50_000 + "end"), (None, "a b c"), (11, "é É"), (12, "É É"), (13, "a\u00a0b"),
    ]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS)
    out = near_duplicates(docs, 3, 85).collect()
    got = {r.doc_id: (r.component_id, r.kept) for r in out}
    assert got == {
        5: (3, False), 3: (3, True), 9: (8, False), 8: (8, True), 1: (1, True), 2: (2, True), 7: (7, True),
        4: (4, True), 6: (4, False), None: (None, True), 11: (11, True), 12: (12, True), 13: (13, True),
    }
    assert {r.doc_id: r.n_shingles for r in out}[2] == 0


def test_empty_and_repeated(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d", "s", "", ""), (1, "a b c d", "s", "", "")], DOCS)
    assert [(r.component_id, r.kept) for r in near_duplicates(docs).collect()] == [(1, True)] * 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (50, 50)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.vertex: r.comp for r in found.collect()} == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


def test_pairs_of_a_family_below_the_threshold_grow_in_proportion(spark, monkeypatch):
    """Copies with six edits each, drawn from few places and words: hardly any link, but all share some edits with many."""
    from evidentia.llm import near_dedup

    kept, rows = near_dedup.materialize, {}

    def counting(df, name):
        out = kept(df, name)
        if name == "pairs":
            rows[n] = rows.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counting)
    for n in (300, 1200):
        rng = random.Random(3)
        places = sorted(rng.sample(range(5, 115), 12))
        texts = []
        for i in range(n):
            words = [f"w{j}" for j in range(120)]
            for p in rng.sample(places, 6):
                words[p] = f"v{rng.randrange(3)}"
            texts.append((i, " ".join(words)))
        near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(8), 3, 85).count()
    assert rows[1200] < 6 * rows[300]  # all pairs would be sixteen times as many


def test_hubs_of_bounded_size_make_no_prefixes(spark, monkeypatch):
    """A family just below the threshold, too large for pairs by units, is settled in one group."""
    from evidentia.llm import near_dedup

    kept, names = near_dedup.written, []
    monkeypatch.setattr(near_dedup, "written", lambda df, name, **totals: names.append(name) or kept(df, name, **totals))
    rng = random.Random(5)
    rows = []
    for i in range(330):
        words = [f"w{j}" for j in range(120)]
        for p in rng.sample(range(5, 115), rng.randrange(3, 8)):
            words[p] = f"v{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert result(near_duplicates(docs, 5, 80, whole=1024)) == brute(rows, 5, 80)
    assert "links" in names and "prefixes" not in names


def around_the_threshold(n):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        words = [f"w{j}" for j in range(120)]
        for p in rng.sample(range(5, 115), rng.randrange(3, 8)):
            words[p] = f"v{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_hubs_of_several_blocks(spark, monkeypatch, k, percent):
    """A family of more members than one block: each two blocks are a group, and every link is found without prefixes."""
    from evidentia.llm import near_dedup

    kept, names = near_dedup.written, []
    monkeypatch.setattr(near_dedup, "written", lambda df, name, **totals: names.append(name) or kept(df, name, **totals))
    rows = around_the_threshold(330)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert result(near_duplicates(docs, k, percent, whole=64, blocks=8)) == brute(rows, k, percent)
    assert "links" in names and "prefixes" not in names


def test_op10_settles_families_without_prefixes(spark, monkeypatch, tmp_path):
    from evidentia.llm import entry, near_dedup

    kept, names = near_dedup.written, []
    monkeypatch.setattr(near_dedup, "written", lambda df, name, **totals: names.append(name) or kept(df, name, **totals))
    rows = around_the_threshold(330)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert result(entry.op10_minhash(spark, str(tmp_path))) == brute(rows, 3, 85)
    assert "links" in names and "prefixes" not in names


def test_tokens_in_common(monkeypatch):
    """Frequent and rare tokens, in runs that end within a token, equal the product of whole matrices."""
    import numpy as np

    from evidentia.llm import near_dedup

    rng = np.random.default_rng(1)
    for shape, tokens in (((40, 50), 300), ((3, 3), 5), ((0, 5), 3)):
        y, z = (rng.random((n, tokens)) < rng.random(tokens) / 4 for n in shape)
        for often in (1, 64, 10**9):
            monkeypatch.setattr(near_dedup, "OFTEN", often)
            monkeypatch.setattr(near_dedup, "MEET", 7)
            monkeypatch.setattr(near_dedup, "BLOCK", 16)
            found = near_dedup._shared(y.nonzero(), z.nonzero(), shape, tokens)
            assert (found == y.astype(int) @ z.astype(int).T).all()


def test_near_duplicates_of_a_large_family_make_no_prefixes(spark, monkeypatch):
    """Over 1,024 members of one hub, most beyond the threshold, meet in groups of two blocks."""
    import corpus_pipeline
    from evidentia.llm import near_dedup

    kept, names = near_dedup.written, []
    monkeypatch.setattr(near_dedup, "written", lambda df, name, **totals: names.append(name) or kept(df, name, **totals))
    rng = random.Random(7)
    rows = [(0, " ".join(f"w{j}" for j in range(60)))]
    for i in range(1, 1300):
        words = rows[0][1].split()
        for p in rng.sample(range(5, 55), rng.randrange(2, 4)):
            words[p] = f"v{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()
    assert {r.doc_id for r in found} == {i for i, (_, _, first) in brute(rows, 5, 80).items() if first}
    assert "links" in names and "prefixes" not in names


def test_tasks_have_one_python_worker_and_small_batches(spark, monkeypatch):
    """Workers are kept and used in turn, so a second one for each task would double the memory that all stages hold."""
    from evidentia.llm import near_dedup

    plans, bounds = [], set()

    def seen(kept):
        def apply(df, *args, **totals):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            bounds.add(int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
            return kept(df, *args, **totals)

        return apply

    for name in ("materialize", "written"):
        monkeypatch.setattr(near_dedup, name, seen(getattr(near_dedup, name)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    rows = [*around_the_threshold(60), (100, None), (101, " "), *((200 + i, f"alone {i} of them all") for i in range(40))]
    docs = spark.createDataFrame([*rows, (None, "without a name")], "doc_id long, text string").repartition(8)
    found = result(near_duplicates(docs))
    assert found.pop(None) == (1, None, True)
    assert found == brute(rows, 5, 80)
    made = [p for p in plans if "MapInArrow" in p]
    assert len(made) >= 3 and not any("EvalPython" in p for p in plans)
    assert max(bounds) <= 4 << 20
