import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from asofkit.functions import numbers as n


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def text_of(x):
    out = format(x, "f")
    return "0" if x == 0 else out.rstrip("0").rstrip(".") if "." in out else out


def invented(rng, k):
    out = ["0", "-0", "0.000", "1", "-1", "9" * 30, "-" + "9" * 31 + ".5", "5E-40", "1e25", "100", ".5", "5.", "999999.9999995", "+12", " 7 \n", "-000.00100"]
    while len(out) < k:
        digits = "".join(rng.choices("0123456789", [3] + [1] * 8 + [4], k=rng.randint(1, 40)))
        cut = rng.randint(0, len(digits))
        out.append(rng.choice(["", "-"]) + (digits[:cut] or "0") + rng.choice([".", "." + digits[cut:]]) + rng.choice(["", "", f"e{rng.randint(-30, 30)}"]))
    return out


def test_numbers_equal_decimals(spark):
    rng = random.Random(2)
    texts = invented(rng, 300)
    rows = [(i, t, rng.choice(texts), rng.randint(-12, 14), rng.choice([None, "-", ""]), rng.randint(-35, 45)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, a string, b string, scale int, sign string, decimals int")
    a, b = n.parse(F.col("a")), n.parse(F.col("b"))
    got = df.select("i", n.plain(a), n.plain(n.folded(F.col("a"), F.col("scale"), F.col("sign"))), n.plain(n.added(a, b)), n.compared(a, b), n.plain(n.rounded(a, F.col("decimals"))), n.plain(n.added(a, n.negated(a)))).collect()
    with localcontext() as c:
        c.prec = 400
        for r in got:
            i, x, y, scale, sign, decimals = rows[r[0]]
            x, y = Decimal(x.strip()), Decimal(y.strip())
            q = Decimal(10) ** -decimals
            near = (x / q).quantize(Decimal(1), rounding=ROUND_HALF_UP) * q
            assert tuple(r)[1:] == (text_of(x), text_of(x.scaleb(scale) * (-1 if sign == "-" else 1)), text_of(x + y), (x > y) - (x < y), text_of(near), "0"), rows[r[0]]


def test_what_is_no_number(spark):
    assert [one(spark, n.plain(n.parse(F.lit(t)))) for t in ("", " ", "x", "NaN", "Infinity", "1,000", "1e", ".", "1 2", "--1", "0x1", None)] == [None] * 12
    assert one(spark, n.plain(n.parse(F.lit("1,000.5"), commas=True))) == "1000.5"
    assert one(spark, n.plain(n.folded(F.lit("5"), F.lit(-12), F.lit(None)))) == "0.000000000005"
    assert one(spark, n.plain(n.folded(F.lit("123456789012345678901234567890"), F.lit(3), F.lit("-")))) == "-123456789012345678901234567890000"
    assert one(spark, n.folded(F.lit("text"), F.lit("x"), F.lit("?"))) is None
    for scale, sign in (("x", None), ("1.5", None), ("0", "+")):
        with pytest.raises(Exception, match="bad scale or sign"):
            one(spark, n.folded(F.lit("1"), F.lit(scale), F.lit(sign)))
    with pytest.raises(Exception, match="too many places"):
        one(spark, n.plain(n.parse(F.lit("1e9999999"))))


def test_totals_are_exact_in_any_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcd"), t) for t in invented(rng, 2000)] + [("none", None), ("zero", "0"), ("a", None)]
    df = spark.createDataFrame(rows, "g string, t string").withColumn("x", n.parse(F.col("t")))
    want = {}
    with localcontext() as c:
        c.prec = 400
        for g, t in rows:
            k, total = want.get(g, (0, None))
            want[g] = (k, total) if t is None else (k + 1, (total or Decimal(0)) + Decimal(t.strip()))
        want = {g: (k, t if t is None else text_of(t)) for g, (k, t) in want.items()}
    for parts in (1, 64):
        made = n.totals(df.repartition(parts, F.rand(parts)), ["g"], "x").select("g", "n", n.plain(F.col("total")).alias("t"))
        assert {r["g"]: (r["n"], r["t"]) for r in made.collect()} == want
    assert n.totals(df.limit(0), ["g"], "x").count() == 0


def test_order_keys_sort(spark):
    texts = invented(random.Random(5), 300)
    df = spark.createDataFrame([(t,) for t in texts], "t string").orderBy(n.order_key(n.parse(F.col("t"))))
    assert [Decimal(r["t"].strip()) for r in df.collect()] == sorted(Decimal(t.strip()) for t in texts)


def test_limbs_of_large_sums(spark):
    for vs in ([(0, 9_223_362_036_854_775_807), (1, 9_223_362_036_854_000_000)], [(0, -9_223_362_036_854_775_807), (3, 5)], [(-2, 1), (-2, -1)], [(0, -1)]):
        held = F.array(*[F.struct(F.lit(a).cast("bigint").alias("at"), F.lit(v).cast("bigint").alias("v")) for a, v in vs])
        with localcontext() as c:
            c.prec = 100
            assert one(spark, n.plain(n.from_limbs(held))) == text_of(sum(Decimal(v).scaleb(6 * a) for a, v in vs))
