"""Means, variances, covariances and correlations that depend neither on the order of rows nor on their partitions.

Each value is cut into whole-number pieces on a fixed grid (doubles: three pieces of 27 bits below the bin of their exponent; decimals: groups of nine
digits), and the pieces and their products are added as whole numbers. These sums are a table that can be stored, united with others and added again; only
the last step makes quotients of them, one row for each group, rounded once. One pass, no second look at the mean, no cancellation.
"""

from __future__ import annotations

import decimal
from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

#: Bits of a double's piece; 40 bins reach below its smallest number, 37 above its largest.
BITS = 27
LOWEST = -40
#: Decimal digits of a decimal's piece, and the digits of results given as text (rounded half to even).
DIGITS = 9
FIGURES = 34
MOST_DIGITS = 28
_SUM = "decimal(38,0)"


def _binned(x: Column) -> tuple[Column, Column]:
    """The bin of a double's exponent, and the double over 2^(27 bin): below 2^28, no bit lost."""
    power = lambda step: F.get(F.array(*[F.lit(2.0 ** (-step * b)) for b in range(LOWEST, 38)]), F.col("_bin") - LOWEST)
    size = F.greatest(F.least(F.floor(F.log2(F.abs(x)) / BITS), F.lit(37)), F.lit(LOWEST))
    at = F.when(x == 0, 0).otherwise(size).cast("int")
    scaled = x * power(BITS // 2) * power(BITS - BITS // 2)  # in two steps: 2^1080 is no double
    return at, scaled


def _pieces(df: DataFrame, name: str, tag: str) -> tuple[DataFrame, int]:
    """df with the bin and the pieces of a column, and how many pieces there are."""
    kind = df.schema[name].dataType
    if isinstance(kind, DecimalType):
        if kind.precision > MOST_DIGITS:
            raise ValueError(f"{name} has {kind.precision} digits; {MOST_DIGITS} are the most")
        n = -(-kind.precision // DIGITS)
        whole = (F.col(name) * F.lit(decimal.Decimal(10**kind.scale))).cast(_SUM)
        text = F.lpad(F.abs(whole).cast("string"), n * DIGITS, "0")
        piece = lambda i: F.substring(text, i * DIGITS + 1, DIGITS).cast("bigint") * F.when(F.col(name) < 0, -1).otherwise(1)
        return df.withColumns({f"_b{tag}": F.lit(0)} | {f"_{tag}{i}": piece(i) for i in range(n)}), n
    x = F.col(name).cast("double")
    finite = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("a value is not finite")).cast("double")).otherwise(x)
    at, scaled = _binned(F.col(f"_v{tag}"))
    df = df.withColumn(f"_v{tag}", finite).withColumn("_bin", at).withColumn(f"_b{tag}", F.col("_bin")).withColumn("_s", scaled)
    rest = 2.0**BITS
    for i in range(3):
        df = df.withColumn(f"_{tag}{i}", F.col("_s").cast("bigint")).withColumn("_s", (F.col("_s") - F.col(f"_{tag}{i}")) * rest)
    return df.drop("_bin", "_s", f"_v{tag}"), 3


def sums(df: DataFrame, by: Sequence[str], x: str, y: str | None = None) -> DataFrame:
    """by, bx, by_bin, n and the sums of pieces and of their products, of the rows where x (and y) are known: a table of few rows for each group (one for
    each exponent bin that occurs). Sums of parts of the rows, united, are added by `added`. A value that is not finite is an error."""
    names = [x] if y is None else [x, y]
    rows = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])).select(*by, *[F.col(c).alias(f"_in{t}") for t, c in zip("xy", names)])
    counts = {}
    for t, _ in zip("xy", names):
        rows, counts[t] = _pieces(rows, f"_in{t}", t)
    if y is None:
        rows = rows.withColumn("_by", F.lit(0))
    made = {f"s_{t}_{i}": F.col(f"_{t}{i}") for t, n in counts.items() for i in range(n)}
    made |= {f"q_{t}_{i}_{j}": F.col(f"_{t}{i}") * F.col(f"_{t}{j}") for t, n in counts.items() for i, j in combinations_with_replacement(range(n), 2)}
    if y is not None:
        made |= {f"c_{i}_{j}": F.col(f"_x{i}") * F.col(f"_y{j}") for i, j in product(range(counts["x"]), range(counts["y"]))}
    total = [F.sum(c.cast("decimal(20,0)")).cast(_SUM).alias(k) for k, c in made.items()]
    return rows.groupBy(*by, F.col("_bx").alias("x_bin"), F.col("_by").alias("y_bin")).agg(F.count("*").alias("n"), *total)


def added(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """The sums of all parts, whatever their order."""
    both = reduce(DataFrame.unionByName, parts)
    values = [c for c in both.columns if c[:2] in ("s_", "q_", "c_")]
    return both.groupBy(*by, "x_bin", "y_bin").agg(F.sum("n").alias("n"), *[F.sum(c).cast(_SUM).alias(c) for c in values])


def _scale(scale: int | None, n: int):
    """Weight of piece i in bin b as a whole number, and the unit it is counted in: value = sum of piece * weight / unit."""
    if scale is None:
        return (lambda b, i: 1 << (BITS * (b - LOWEST + 2 - i))), 1 << (BITS * (2 - LOWEST))
    return (lambda b, i: 10 ** (DIGITS * (n - 1 - i))), 10**scale


def _quotients(parts, names: list[str], x_scale: int | None, y_scale: int | None) -> tuple[int, dict[str, tuple[int, int]]]:
    """n and exact quotients of one group: mean, variance and, of two columns, covariance."""
    count = lambda t: 1 + max((int(k.split("_")[2]) for k in names if k.startswith(f"s_{t}_")), default=-1)
    wx, ux = _scale(x_scale, count("x"))
    wy, uy = _scale(y_scale, count("y"))
    n, s, q, c = 0, {"x": 0, "y": 0}, {"x": 0, "y": 0}, 0
    for row in parts:
        bins, weight = {"x": row["x_bin"], "y": row["y_bin"]}, {"x": wx, "y": wy}
        n += row["n"]
        for k in names:
            kind, *at = k.split("_")
            v = int(row[k])
            if kind == "s":
                s[at[0]] += v * weight[at[0]](bins[at[0]], int(at[1]))
            elif kind == "q":
                i, j = int(at[1]), int(at[2])
                w, b = weight[at[0]], bins[at[0]]
                q[at[0]] += v * w(b, i) * w(b, j) * (1 if i == j else 2)
            else:
                c += v * wx(bins["x"], int(at[0])) * wy(bins["y"], int(at[1]))
    if not n:
        return 0, {}
    out = {}
    for t, u in (("x", ux), ("y", uy)):
        out[f"mean_{t}"], out[f"variance_{t}"] = (s[t], n * u), (n * q[t] - s[t] ** 2, n * n * u * u)
    out["covariance"] = (n * c - s["x"] * s["y"], n * n * ux * uy)
    return n, out


def _rounded(value: tuple[int, int] | None, root: bool = False) -> decimal.Decimal | None:
    if value is None:
        return None
    with decimal.localcontext(decimal.Context(prec=3 * FIGURES, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)) as wide:
        v = decimal.Decimal(value[0]) / decimal.Decimal(value[1]) if root else None
        v = wide.sqrt(v) if root else None
    near = decimal.Context(prec=FIGURES, rounding=decimal.ROUND_HALF_EVEN, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)
    return near.plus(v) if root else near.divide(decimal.Decimal(value[0]), decimal.Decimal(value[1]))


def moments(df: DataFrame, by: Sequence[str], x: str, y: str | None = None, text: bool = False) -> DataFrame:
    """by, n, mean_x, variance_x, deviation_x and, with y, the same of y, covariance and correlation (population forms; null where a variance is 0).

    Doubles, each the nearest to the exact value; as text, 34 digits of it. Rows where a value is null are left out; a group without rows gives none."""
    scales = [df.schema[c].dataType.scale if isinstance(df.schema[c].dataType, DecimalType) else None for c in (x, y or x)]
    return quotients(sums(df, by, x, y), by, *scales, text=text)


def quotients(parts: DataFrame, by: Sequence[str], x_scale: int | None = None, y_scale: int | None = None, text: bool = False) -> DataFrame:
    """`moments` of sums (the scales of decimal columns; None for doubles). The bins of a group are few (78 for a column), whatever its rows."""
    names = [c for c in parts.columns if c[:2] in ("s_", "q_", "c_")]
    pair = any(c.startswith("c_") for c in names)
    fields = [f"{m}_{t}" for t in ("xy" if pair else "x") for m in ("mean", "variance", "deviation")] + (["covariance", "correlation"] if pair else [])
    kind = "string" if text else "double"

    def one(rows):
        n, out = _quotients(rows or [], names, x_scale, y_scale)
        got = {k: _rounded(out.get(k)) for k in fields if k.split("_")[0] in ("mean", "variance", "covariance")}
        for t in "xy":
            got[f"deviation_{t}"] = _rounded(out.get(f"variance_{t}"), root=True)
        if n and out["variance_x"][0] and out["variance_y"][0]:
            (c, cu), (vx, xu), (vy, yu) = out["covariance"], out["variance_x"], out["variance_y"]
            r = _rounded((c * c * xu * yu, cu * cu * vx * vy), root=True)
            got["correlation"] = -r if c < 0 else r
        write = str if text else float
        return (n, *[None if got.get(k) is None else write(got[k]) for k in fields])

    last = F.udf(one, f"struct<n:bigint,{','.join(f'{k}:{kind}' for k in fields)}>")
    held = parts.groupBy(*by).agg(F.collect_list(F.struct("x_bin", "y_bin", "n", *names)).alias("_parts"))
    return held.select(*by, last("_parts").alias("_m")).select(*by, "_m.*")
