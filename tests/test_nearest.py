import math
import random

import pytest

from evidentia.operators import nearest


def km(p, q):
    a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(a)))


def frames(spark, left, right):
    return (
        spark.createDataFrame([(i, *p) for i, p in enumerate(left)], "k int, lat double, lon double"),
        spark.createDataFrame([(i, *p) for i, p in enumerate(right)], "r int, r_lat double, r_lon double"),
    )


@pytest.mark.parametrize("leaf", [2, 32])
def test_equal_to_brute_force_everywhere_on_the_globe(spark, monkeypatch, leaf):
    monkeypatch.setattr(nearest, "LEAF", leaf)
    rng = random.Random(leaf)
    spot = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    town = [(17.4 + rng.gauss(0, 0.05), 78.4 + rng.gauss(0, 0.05)) for _ in range(300)]
    right = [spot() for _ in range(60)] + town + town[:20] + [(90.0, 10.0), (-90.0, 0.0), (10.0, 179.999), (10.0, -179.9995), (0.0, 0.0)]
    left = [spot() for _ in range(120)] + [(17.4 + rng.gauss(0, 0.08), 78.4 + rng.gauss(0, 0.08)) for _ in range(120)] + town[:10] + [(90.0, -50.0), (10.0, 180.0), (89.9, 0.0), (17.4, 78.4), (17.4, 78.4)]
    l, r = frames(spark, left, right)
    l = l.unionByName(spark.createDataFrame([(-1, None, 5.0), (-2, 5.0, None)], "k int, lat double, lon double"))
    got = {x.k: (x.nearest, x.nearest_km) for x in nearest.nearest(l, r, "k", "r").collect()}
    assert set(got) == set(range(len(left)))
    for i, p in enumerate(left):
        best = min(km(p, q) for q in right)
        assert got[i][1] == pytest.approx(best, abs=1e-6)
        assert km(p, right[got[i][0]]) == pytest.approx(best, abs=1e-6)
        assert got[i][0] == min(j for j, q in enumerate(right) if q == right[got[i][0]])  # of equal places the smallest


def test_order_settles_ties_and_limits(spark):
    l, r = frames(spark, [(10.0, 10.0), (50.0, 50.0)], [(10.0, 10.5), (10.0, 10.5), (10.0, 10.5)])
    r = r.selectExpr("*", "-r as seq")
    assert {x.k: x.nearest for x in nearest.nearest(l, r, "k", "r", "seq").collect()} == {0: 2, 1: 2}
    assert {x.k: x.nearest for x in nearest.nearest(l, r, "k", "r", most_km=100).collect()} == {0: 0}
    assert nearest.nearest(l, r.limit(0), "k", "r").count() == 0 == nearest.nearest(l.limit(0), r, "k", "r").count()


def test_rows_meet_few_points_in_a_city_and_far_from_it(spark, monkeypatch):
    """A city of 100,000 points: what the last join makes is bounded, for rows within and 3,000 km away."""
    seen = {}
    kept = nearest.materialize

    def counting(df, name):
        out = kept(df, name)
        seen.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(nearest, "materialize", counting)
    city = spark.range(100_000).selectExpr("cast(id as int) as r", "17.4 + randn(1) * 0.05 as r_lat", "78.4 + randn(2) * 0.05 as r_lon")
    left = spark.range(2000).selectExpr("cast(id as int) as k", "if(id < 1000, 17.4 + randn(3) * 0.05, 40 + randn(3)) as lat", "if(id < 1000, 78.4 + randn(4) * 0.05, 60 + randn(4)) as lon")
    assert nearest.nearest(left, city, "k", "r").count() == 2000
    front = seen["front"][-1]
    assert seen["front"][-1].count() < 2000 * 12  # leaves a row meets, of up to LEAF points each
    assert max(f.groupBy("lat", "lon").count().agg({"count": "max"}).first()[0] for f in seen["front"]) < 200
    assert front.where("not leaf").isEmpty()
