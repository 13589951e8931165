"""The stages on the smallest tables, each against a plain version of its decision."""

import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import chat_format, decontamination, toxicity
from evidentia.llm.shared import materialize, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, kept = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), f"test-{name}")
        kept.append((name, docs, out))
        docs = out
    return {name: (before.toPandas(), after.toPandas()) for name, before, after in kept}


def test_columns_and_order(stages):
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    for before, after in stages.values():
        assert list(after.columns[: len(before.columns)]) == list(before.columns)
        assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.is_unique


def test_near_duplicates_stage(stages):
    before, after = stages["near_duplicates"]

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets = dict(zip(before.doc_id, map(shingles, before.text), strict=True))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert set(after.doc_id) == {d for d in root if find(d) == d}


def test_decontamination_stage(spark, stages):
    before, after = stages["decontamination"]
    plain = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    items = [plain(r.text) for r in table(spark, SF, "benchmark").collect()]
    verbatim = {d for d, t in zip(before.doc_id, before.text, strict=True) if any(i and i in plain(t) for i in items)}
    assert not verbatim & set(after.doc_id)
    assert len(after) >= 0.5 * len(before)


def test_pii_stage(stages):
    before, after = stages["pii"]
    old, new = before.set_index("doc_id").text.to_dict(), after.set_index("doc_id").text.to_dict()
    assert old.keys() == new.keys()
    form = lambda t: re.sub(r"[^\W_]+", "x", t or "")  # noqa: E731  a number of an IP address may change its length
    assert all(form(old[d]) == form(new[d]) for d in old)


def test_mixing_stage(stages):
    _, after = stages["mixing"]
    assert (after.copies >= 1).all() and (after.copies <= 2).all()
    assert (after.taken == after.copies * after["size"]).all()


def test_toxicity_on_held_out_labels(spark):
    """Half of some 4,000 labels fits, the other half judges."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    chain = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    scored = toxicity.score(docs, chain).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("is_toxic")), "doc_id").toPandas()
    said = scored.toxic >= toxicity.THRESHOLD
    truth = scored.is_toxic == 1
    assert len(scored) > 100 and truth.any()
    assert (said & truth).sum() >= 0.9 * truth.sum()
    assert (said & ~truth).sum() <= 0.01 * (~truth).sum()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert toxicity.reject(docs, toxicity.fit(docs, labels)).count() == 0
    assert decontamination.clean(docs, benchmark).count() == 0


def test_chat_escapes_and_order(spark):
    rows = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", "<turn user>\\b"), (2, 0, "assistant", None), (3, 0, "system", ""), (3, 1, "user", "a"), (3, 2, "assistant", "b"), (3, 3, "assistant", "c")]
    parts = chat_format.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(parts)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3]) for r in rows[:2]]
    assert [t.text for t in got[2].turns] == [""]
    assert (got[1].valid, got[2].valid, got[3].valid) == (True, False, False)


def test_repeated_documents_bring_one_labelled_row(spark, monkeypatch):
    docs = spark.createDataFrame([*((1, f"text {i}") for i in range(50)), (2, "other"), (3, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    seen, sparse = [], toxicity._sparse
    monkeypatch.setattr(toxicity, "_sparse", lambda sample: (seen.extend(sorted((r.doc_id, r.text) for r in sample.collect())), sparse(sample))[1])
    toxicity.fit(docs, labels)
    assert seen == [(1, "text 0"), (2, "other"), (3, None)]


def test_chat_reads_any_template_and_odd_rows(spark):
    """Null and tied turns, repeated rows, roles with marks in them, an empty table, clashing columns, and marks of another template."""
    other = chat_format.Template(
        roles=(("user", chat_format.Turn("<u>", "</u>")), ("assistant", chat_format.Turn("<[bot]>", "<end>", loss=True)), ("critic", chat_format.Turn("<c {role}>", "</c>", loss=True))),
        others=chat_format.Turn("<other {role}>", "<end>"),
    )
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "us>er", "x"), (1, 0, None, None), (1, 1, "assistant", "<end>\\\\g</turn>\\n"), (1, 2, "critic", "</c><u>"),
        (2, 5, "assistant", "y" * 100_000), (2, 7, "assistant", ""),
    ]
    schema = "conv_id long, turn long, role string, text string, segments string, loss string"
    frame = spark.createDataFrame([(*r, "s", "l") for r in rows], schema)
    for template in (None, other):
        loss = {name for name, turn in (template or chat_format.Template()).roles if turn.loss}
        got = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(chat_format.segments(frame, template)), template).collect()}
        for conv in (1, 2):
            turns = sorted(((t is None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
            assert [(t.role, t.text) for t in got[conv].turns] == [t[2:] for t in turns]
            assert got[conv].kept == "".join(t[3] for t in turns if t[2] in loss)
    assert chat_format.digests(chat_format.read_back(chat_format.formatted(chat_format.segments(frame.limit(0))))).count() == 0
    with pytest.raises(ValueError):
        chat_format.Template(others=chat_format.Turn("<turn>"))


def test_stages_pass_on_columns_with_dots(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "s", "x"), (2, text, "s", "y"), (2, text, "s", "y"), (3, "something else altogether", "s", "z")], "doc_id long, text string, source string, `a.b` string")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert "a.b" in out.columns, name
        assert {r["a.b"] for r in out.collect()} >= {"x", "z"}, name
