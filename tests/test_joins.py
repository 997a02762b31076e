import random

from pyspark.sql import functions as F

from tessera.operators import joins


def test_as_of_joins_agree_with_brute_force(spark):
    rng = random.Random(1)
    pick = lambda n: None if rng.random() < 0.05 else rng.randint(0, n)
    left = [(i, pick(4), pick(30)) for i in range(200)]
    right = [(pick(4), pick(30), pick(100), "x") for _ in range(150)]
    a = spark.createDataFrame(left, "id int, k int, _time int").repartition(5)
    b = spark.createDataFrame(right, "k int, _row int, v int, w string").repartition(5)
    got = {r.id: (r.v, r.w) for r in joins.as_of(a, b, ["k"], "_time", "_row", ["v", "w"]).collect()}
    assert len(got) == 200
    for i, k, at in left:
        fitting = [(t, (-1 if v is None else v)) for kk, t, v, _ in right if kk is not None and kk == k and t is not None and at is not None and t <= at]
        want = max(fitting)[1] if fitting else None
        assert got[i][0] == (None if want in (None, -1) else want) and got[i][1] == ("x" if fitting else None)
    assert joins.as_of(a, b.limit(0), ["k"], "_time", "_row", ["v"]).where(F.col("v").isNotNull()).count() == 0


def test_range_joins_agree_with_brute_force(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-50, 50)) for i in range(150)] + [(999, None), (998, 10.0)]
    ranges = [(i, (low := rng.uniform(-60, 60)), low + rng.uniform(-5, 30)) for i in range(60)] + [(61, 10.0, 10.0), (62, None, 5.0)]
    a = spark.createDataFrame(points, "p int, x double")
    b = spark.createDataFrame(ranges, "r int, low double, high double")
    want = {(p, r) for p, x in points if x is not None for r, low, high in ranges if low is not None and low <= x <= high}
    for width in (3, 1000):
        rows = joins.in_ranges(a, b, "x", "low", "high", width).select("p", "r").collect()
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
