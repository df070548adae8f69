import math
import random
import statistics
from decimal import Context, Decimal
from fractions import Fraction

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from asofkit.operators import exact


def brute(xs, ys):
    n, xs, ys = len(xs), [Fraction(v) for v in xs], [Fraction(v) for v in ys]
    mx, my = sum(xs) / n, sum(ys) / n
    return mx, sum((v - mx) ** 2 for v in xs) / n, sum((a - mx) * (b - my) for a, b in zip(xs, ys)) / n


def near(f, digits=34):
    return Context(prec=digits).divide(Decimal(f.numerator), Decimal(f.denominator))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    some = [0.0, -0.0, 5e-324, -2.0**-1060, 1.0, -1.0, 2.0**27, 2.0**-27, 2.0**54 - 2, 1e16, -1e16, 0.1, 1e300, -1e300, math.nextafter(2.0**27, 0), 3.5e-310]
    make = lambda: rng.choice([rng.choice(some), rng.gauss(0, 1), rng.gauss(0, 1) * 10.0 ** rng.randrange(-30, 30)])
    return [(rng.choice("aab"), make(), make(), i) for i in range(3000)] + [("a", None, 1.0, -1), ("b", 1.0, None, -2), ("none", None, None, -3)]


def test_doubles_are_exact_whatever_their_order(spark, rows):
    df = spark.createDataFrame(rows, "g string, x double, y double, i int")
    many = [exact.moments(d, ["g"], "x", "y").orderBy("g").collect() for d in (df.coalesce(1), df.repartition(64), df.orderBy(F.desc("i")))]
    assert many[0] == many[1] == many[2] and [r["g"] for r in many[0]] == ["a", "b"]
    text = {r["g"]: r for r in exact.moments(df, ["g"], "x", "y", text=True).collect()}
    for r in many[0]:
        pairs = [(x, y) for g, x, y, _ in rows if g == r["g"] and x is not None and y is not None]
        mean, variance, covariance = brute(*zip(*pairs))
        assert r["n"] == len(pairs)
        assert [Decimal(text[r["g"]][k]) for k in ("mean_x", "variance_x", "covariance")] == [near(mean), near(variance), near(covariance)]
        assert r["mean_x"] == float(near(mean))


def test_usual_figures(spark):
    rng = random.Random(5)
    xs = [rng.gauss(1e9, 1.0) for _ in range(500)]  # where E[x^2] - E[x]^2 in doubles fails
    ys = [x * 2 + rng.gauss(0, 1) for x in xs]
    r = exact.moments(spark.createDataFrame(list(zip(xs, ys)), "x double, y double"), [], "x", "y").first()
    assert r["deviation_x"] == pytest.approx(statistics.pstdev(xs), rel=1e-15) and r["variance_y"] == statistics.pvariance(ys)
    assert r["correlation"] == pytest.approx(statistics.correlation([x - 1e9 for x in xs], [y - 2e9 for y in ys]), rel=1e-9)


def test_decimals_and_sums_of_parts(spark):
    rng = random.Random(6)
    rows = [(Decimal(rng.randrange(-(10**27), 10**27)).scaleb(-4), Decimal(rng.randrange(-999, 999)).scaleb(-2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "x decimal(28,4), y decimal(5,2)")
    mean, variance, covariance = brute(*zip(*rows))
    r = exact.moments(df, [], "x", "y", text=True).first()
    assert [Decimal(r[k]) for k in ("mean_x", "variance_x", "covariance")] == [near(mean), near(variance), near(covariance)]
    left, right = (exact.sums(spark.createDataFrame(part, df.schema), [], "x", "y") for part in (rows[:150], rows[150:]))
    assert exact.quotients(exact.added([right, left], []), [], 4, 2, text=True).first() == r


def test_edges(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "g string, x double, y double")
    assert exact.moments(make(), ["g"], "x").count() == 0
    assert exact.moments(make(), [], "x", "y").first()["n"] == 0
    constant = exact.moments(make((None, 2.0, 1.0), (None, 2.0, 5.0)), ["g"], "x", "y").first()
    assert constant["g"] is None and constant["variance_x"] == 0.0 and constant["correlation"] is None and constant["mean_y"] == 3.0
    for bad in (float("nan"), float("inf"), -float("inf")):
        with pytest.raises(PySparkException, match="not finite"):
            exact.moments(make(("a", bad, 1.0)), ["g"], "x").collect()
    with pytest.raises(ValueError):
        exact.sums(spark.createDataFrame([(Decimal(1),)], "x decimal(38,4)"), [], "x")
