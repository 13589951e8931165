import random
from collections import Counter
from difflib import SequenceMatcher

from evidentia.functions import fixed
from evidentia.plans.localities import asked_keys, like_before, localities, met_in_blocks, own_keys


def alike(new, old):
    return SequenceMatcher(None, new, old).ratio() >= 0.85 or (len(new) >= 6 and (new in old or old in new))


def names(n, seed):
    """Names of few syllables with small changes, so that many are alike and chains are long."""
    rng = random.Random(seed)
    parts = ["ban", "jara", "koka", "pet", "gachi", "bowli", "nara", "singi", "mad", "hapur", "kon", "da", "pur", "mia", "lal", "guda", "nagar", "hills", "tolly", "chow", "ki", "ameer"]
    out = []
    while len(out) < n:
        name = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", " nagar", " hills", " colony x"])
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(name))
            name = name[:i] + rng.choice(["", name[i] * 2, rng.choice("aeiou")]) + name[i + 1 :]
        out.append(name[:26].strip() or "koka")
    return out


def test_like_names_share_a_key():
    found = sorted(set(names(700, 1)) | {"abcd", "abcdefgh", "xxabcdyy", "nagars", "abc"})
    for new in found:
        for old in found:
            if new != old and alike(new, old):
                assert own_keys(old) & asked_keys(new) or own_keys(new) & asked_keys(old), (new, old)


def test_pairs_match_brute_force(spark):
    found = list(dict.fromkeys(names(900, 2)))
    df = spark.createDataFrame(list(enumerate(found)), "seq long, name string")
    expected = {(j, i) for j in range(len(found)) for i in range(j) if alike(found[j], found[i])}
    assert {(r.seq, r.before) for r in like_before(df).collect()} == expected


def test_taken_as_one_after_the_other(spark):
    known = [n.title() for n in names(150, 3)] + ["Hyderabad", "ab", "Kokapet", "kokapet"]
    register = [n.upper() if i % 3 else n for i, n in enumerate(names(2500, 4))] + ["KOKAPET", "", None, "WARD NO11", "a name that is far too long to be one"]
    out, keys = [], []
    for n in known:
        k = " ".join("".join(c if c.isalnum() else " " for c in n.lower()).split())
        if k not in keys and k not in fixed.WIDE_PLACES and len(k) > 2:
            keys.append(k)
            out.append(n)
    sound = {r.n: r.c for r in clean(spark, register)}
    for n in register:
        c = sound.get(n, "")
        k = " ".join("".join(x if x.isalnum() else " " for x in c.lower()).split())
        if not k or k in keys or any(alike(k, x) for x in keys):
            continue
        keys.append(k)
        out.append(c.title() if c.isupper() else c)
    a = spark.createDataFrame(list(enumerate(known, 1000)), "seq long, locality string").repartition(3)
    b = spark.createDataFrame(list(enumerate(register)), "seq long, locality string").repartition(3)
    got = [r.name for r in localities(a, b).orderBy("seq").collect()]
    assert got == out and len(out) > 300


def clean(spark, texts):
    from pyspark.sql import functions as F

    from evidentia.functions.text import clean_locality

    return spark.createDataFrame([(t,) for t in texts], "n string").select("n", clean_locality(F.col("n")).alias("c")).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "seq long, locality string")
    some = spark.createDataFrame([(1, "MADHAPUR-EAST")], "seq long, locality string")
    assert localities(none, none).count() == 0
    assert [tuple(r) for r in localities(none, some).collect()] == [(1, "Madhapur-East", False)]
    assert [r.name for r in localities(some, none).collect()] == ["MADHAPUR-EAST"]


def test_few_names_meet_but_like_ones():
    """Names of 8 to 12 letters from few syllables: hardly any are alike, though all share pairs of letters."""
    rng = random.Random(5)
    found = sorted({"".join(rng.choice(["an", "er", "in", "th", "ou", "st", "le", "de"]) for _ in range(rng.randrange(4, 7))) for _ in range(3000)})
    own, asked = Counter(k for n in found for k in own_keys(n)), Counter(k for n in found for k in asked_keys(n))
    meetings = sum(many * asked[k] for k, many in own.items()) - sum(len(own_keys(n) & asked_keys(n)) for n in found)
    assert meetings < 60 * len(found)


def long_names(n, seed):
    """Names of 15 to 80 letters from few syllables, some of them a few changes off one before."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        name = "".join(rng.choice(["an", "er", "in", "th", "ou", "st", "le", "de", "heit ", "ment"]) for _ in range(rng.randrange(7, rng.choice([9, 12, 28]))))
        if out and rng.random() < 0.5:
            name = rng.choice(out)
            for _ in range(rng.randrange(1, 9)):
                i = rng.randrange(len(name))
                name = name[:i] + rng.choice(["", name[i] * 2, rng.choice("aeiou")]) + name[i + 1 :]
        out.append(name[:80].strip())
    return list(dict.fromkeys(out))


def test_long_names_match_brute_force(spark):
    found = long_names(600, 7)
    df = spark.createDataFrame(list(enumerate(found)), "seq long, name string")
    expected = {(j, i) for j in range(len(found)) for i in range(j) if alike(found[j], found[i])}
    assert {(r.seq, r.before) for r in like_before(df).collect()} == expected
    assert sum(min(map(len, (found[j], found[i]))) > 63 for j, i in expected) > 5 and len(expected) > 300


def test_few_long_names_meet_but_like_ones(spark):
    """By parts of three letters, thousands of pairs met that were not alike."""
    found = [n for n in long_names(600, 9) if len(n) < 64]
    free = [i % 3 == 0 for i in range(len(found))]
    df = spark.createDataFrame([(i, free[i], n) for i, n in enumerate(found)], "seq long, free boolean, name string")
    expected = {(j, i) for j in range(len(found)) for i in range(j) if not free[j] and max(len(found[j]), len(found[i])) >= 20 and SequenceMatcher(None, found[j], found[i]).ratio() >= 0.85}
    for blocks in ((2048, 16384), (50, 90)):
        met = [(r.seq, r.before) for r in met_in_blocks(df, blocks).collect()]
        assert len(met) == len(set(met)) and expected <= set(met) and len(met) < 4 * len(expected)
