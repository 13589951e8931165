import hashlib
import math
import random

from evidentia.llm.vector_codes import compress, encode, fit

VECTORS = "vec_id long, embedding array<float>, label int, code string, `a.b` int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Plain loops over rows (vec_id, embedding, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = len(min((r for r in kept if r[0] is not None), key=lambda r: r[0])[1])
    width = dim // parts
    seeds = {}
    for i, v, _ in kept:
        if i is not None and len(v) == dim:
            seeds[i] = min(seeds.get(i, v), v)
    seeds = [seeds[i] for i in sorted(seeds)[:entries]]
    books = [[tuple(v[p * width : (p + 1) * width]) for v in seeds] for p in range(parts)]

    def assigned():
        out = []
        for i, v, label in kept:
            if len(v) != dim:
                out.append((i, v, label, None, None))
                continue
            best = [min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e, strict=True)), n) for n, e in enumerate(books[p])) for p in range(parts)]
            out.append((i, v, label, [n for _, n in best], sum(d for d, _ in best)))
        return out

    for _ in range(rounds):
        sums = {}
        for _, v, _, codes, _ in assigned():
            for p, n in enumerate(codes or []):
                sums.setdefault((p, n), []).append(v[p * width : (p + 1) * width])
        for (p, n), own in sums.items():
            books[p][n] = tuple(sum(column) // len(own) for column in zip(*own, strict=True))
    done = assigned()
    by_label = {}
    for _, _, label, _, error in done:
        if error is not None:
            by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{n:02x}" for n in codes) if codes else None, error, by_label.get(label), digest) for i, _, label, codes, error in done), key=str)


def result(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def test_odd_rows_match_plain_loops(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.4) for _ in range(32)], rng.choice([1, 2, 3, None])) for i in rng.sample(range(-50, 400), 150)]
    rows += [(900 + i, rows[0][1], 1) for i in range(200)]  # copies tie everywhere
    rows += [(i, [0.25] * 32, 2) for i in (7, 7, 7)] + [(None, [0.5] * 32, None)]
    rows += [(500, None, 1), (501, [None] * 32, 1), (502, [float("nan")] + [0.0] * 31, 1), (503, [float("inf")] * 32, 1), (504, [0.1] * 31, 9), (505, [], 1), (506, [1000.0, -1000.0] * 16, 3)]
    rows = [(i, v and [None if x is None else float(x) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(i, v, label, "clash", 1) for i, v, label in rows], VECTORS).repartition(5)
    single = {r.vec_id: r.embedding for r in df.where("vec_id >= 900 or vec_id < 500").collect()}  # as single-precision floats
    rows = [(i, single.get(i, v) if v and i is not None and i != 7 else v, label) for i, v, label in rows]
    out = compress(df)
    assert out.columns == ["vec_id", "label", "a.b", "code", "error", "label_error", "codebooks_sha256"]
    assert result(out) == brute(rows)


def test_few_and_no_rows(spark):
    few = [(i, [i / 7.0] * 16, 1) for i in range(3)]
    df = spark.createDataFrame([(*r, "x", 0) for r in few], "vec_id long, embedding array<double>, label int, code string, `a.b` int")
    assert result(compress(df)) == brute(few)
    assert compress(spark.createDataFrame([], VECTORS)).count() == 0
    odd = spark.createDataFrame([(1, [0.5] * 10, 1, "x", 0), (2, [], 1, "x", 0)], VECTORS)  # nothing can be cut
    assert [(r.code, r.error, r.label_error) for r in compress(odd).collect()] == [(None, None, None)] * 2


def test_extreme_components_do_not_overflow(spark):
    rows = [(i, [3e38 * (-1) ** i] * 64, i % 2) for i in range(8)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], VECTORS)
    assert {r.error for r in compress(df).collect()} == {0}  # held at the bound


def test_codes_stand_for_near_vectors(spark):
    import numpy as np

    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    books = fit(df)
    coded = {r.vec_id: r.code for r in encode(df, books).collect()}
    for r in df.limit(50).collect():
        code = np.array([[int(coded[r.vec_id][i : i + 2], 16) for i in range(0, 32, 2)]])
        held = books.decode(code)[0]
        assert np.linalg.norm(held - np.array(r.embedding)) < 0.8 * np.linalg.norm(r.embedding)
