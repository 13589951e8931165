import random
import re
from itertools import permutations

import pytest

from evidentia.llm import filter_audit
from evidentia.llm.filter_audit import audit, copies, features

DOCS = "doc_id long, text string, source string, mask int, `a.b` string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """The filters applied in turn, for every order."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    docs = []
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        good, toxic = (any(j == i and v == 1 for j, v in ((x[0], x[k]) for x in labels if i is not None)) for k in (1, 2))
        docs.append((source or "", fails, good, toxic))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {d[0] for d in docs}:
        own, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in orders:
            left = own
            for step, f in enumerate(order, 1):
                here = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                total[f] += len(here)
                earlier = sum(d[1][f] and any(d[1][x] for x in order[: step - 1]) for d in own)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                out[part, order, step] = [len(left), len(here), earlier, alone, sum(d[2] for d in here), sum(d[3] for d in here)]
        for order in orders:
            for step, f in enumerate(order, 1):
                out[part, order, step].append(total[f])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def odd_rows():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(90)]
    texts = [" ".join(rng.choice(words[: rng.choice([3, 40, 90])]) for _ in range(rng.randrange(30, 80))) for _ in range(40)]
    texts += [t.upper() for t in texts[:5]] + [t + " 50 %" for t in texts[5:10]] + ["", None, "\x0b \t", "é" * 60, "É " * 60, "x" * 5000, "x" * 4999 + "y", "y" + "x" * 4999]
    texts += ["z" * 70_000 + c + "z" * 500 for c in "abc"]  # differ in the third block only
    rows = [(rng.choice([i, i, rng.randrange(50)]), rng.choice(texts), rng.choice(["s", "s", "t", None, ""])) for i in range(400)]
    rows += [(None, texts[0], "s"), (None, texts[0], None), (3, texts[0], "s"), (3, texts[0], "s"), (3, texts[1], "s")]
    labels = [(rng.choice([None, *range(400)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)]
    return rows, labels


# With one or two bits the hashes of all texts collide, so comparing decides everything.
@pytest.mark.parametrize("bits", [64, 2, 1])
def test_matches_filters_applied_in_turn(spark, bits):
    rows, labels = odd_rows()
    docs = spark.createDataFrame([(*r, 99, "x") for r in rows], DOCS)
    assert result(audit(docs, spark.createDataFrame(labels, LABELS), bits=bits)) == brute(rows, labels)


def test_copies_of_long_texts_and_hot_groups(spark):
    rows = [(i, "same words again " * 20, "s") for i in range(3000)] + [(5000 + i, ("long " * 20_000) + str(i // 2), "t") for i in range(6)]
    docs = spark.createDataFrame([(*r, 99, "x") for r in rows], DOCS).repartition(8)
    got = {r.doc_id for r in copies(docs, features(docs)).collect()}
    assert got == {*range(1, 3000), 5001, 5003, 5005}


def test_words_of_long_texts_are_cut_between_words(monkeypatch):
    raw = " ".join(f"w{i % 97}" for i in range(5000)).encode() + b"\x0b\tend"
    whole = filter_audit.word_counts(raw)
    monkeypatch.setattr(filter_audit, "PIECE", 10)
    assert filter_audit.word_counts(raw) == whole == (5001, 98)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert audit(none, spark.createDataFrame([], LABELS)).count() == 0
    one = spark.createDataFrame([(None, None, None, None, None)], DOCS)
    assert result(audit(one, spark.createDataFrame([], LABELS))) == brute([(None, None, None)], [])
