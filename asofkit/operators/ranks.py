"""Ranks, buckets and percentiles within a date of any size.

Each does what its namesake in `panels` does by a window, which takes a date's whole cross-section into one task. Here rows get their places over ranges of
(date, value, member), so a date of most rows is many tasks; percentiles are read off at places, so no state holds a date's values. A sort and a written table
are paid for that: for dates that fit a task the windows are quicker.

Unknown (null) values have no place: their rank, bucket and clipped value are null. Added columns replace columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .ordered import numbered, running


def _placed(df: DataFrame, date: Sequence[str], value: str, members: Sequence[str]) -> DataFrame:
    """Rows of known value with _place (0, 1, ...) in their date."""
    return numbered(df.where(F.col(value).isNotNull()), [F.col(value).asc(), *[F.col(m).asc_nulls_first() for m in members]], "_place", within=date)


def _with_unknown(made: DataFrame, df: DataFrame, value: str) -> DataFrame:
    return made.unionByName(df.where(F.col(value).isNull()), allowMissingColumns=True)


def _joined(rows: DataFrame, table: DataFrame, date: Sequence[str]) -> DataFrame:
    """rows with the columns of a table of one row a date, nulls meeting nulls."""
    named = table.select(*[F.col(c).alias(f"_d{i}") for i, c in enumerate(date)], *[c for c in table.columns if c not in date])
    same = F.lit(True)
    for i, c in enumerate(date):
        same = same & F.col(c).eqNullSafe(F.col(f"_d{i}"))
    return rows.join(named, same).drop(*[f"_d{i}" for i in range(len(date))])


def ordinal_rank(df: DataFrame, date: Sequence[str], value: str, members: Sequence[str]) -> DataFrame:
    """rank 1..n ascending over known values, ties by the members."""
    made = _placed(df, date, value, members).withColumn("rank", F.col("_place") + 1).drop("_place")
    return _with_unknown(made, df.drop("rank"), value)


def average_rank(df: DataFrame, date: Sequence[str], value: str) -> DataFrame:
    """average_rank: equal values share the mean of their ranks. Ranks are given to distinct values, with their counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*date, value).agg(F.count("*").alias("_n"))
    totals = running(counts, [*[F.col(c).asc_nulls_first() for c in date], F.col(value).asc()], {"_before": F.col("_n")})
    totals = _joined(totals, totals.groupBy(*date).agg(F.min("_before").alias("_start")), date)
    ranked = totals.select(*date, value, (F.col("_before") - F.col("_start") + (F.col("_n") + 1) / F.lit(2.0)).alias("average_rank"))
    made = _joined(df.drop("average_rank").where(F.col(value).isNotNull()), ranked, [*date, value])
    return _with_unknown(made, df.drop("average_rank"), value)


def quantile_buckets(df: DataFrame, date: Sequence[str], value: str, members: Sequence[str], n: int, per_bucket: int = 1) -> DataFrame:
    """bucket floor(i n / count) of the row at place i by (value, members); null where a date has fewer than n x per_bucket known rows."""
    rows = _placed(df, date, value, members)
    sized = _joined(rows, rows.groupBy(*date).agg(F.count("*").alias("_count")), date)
    bucket = F.when(F.col("_count") >= n * per_bucket, F.call_function("div", F.col("_place") * n, F.col("_count")))
    return _with_unknown(sized.withColumn("bucket", bucket).drop("_place", "_count"), df.drop("bucket"), value)


def _at(p: float, count: Column) -> Column:
    return F.lit(float(p)) * (count - 1)


def percentiles(df: DataFrame, date: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """date, n and p0, p1, ...: percentiles interpolated at p (n - 1), from the rows at the places beside."""
    rows = _placed(df.select(*date, value), date, value, [])
    sized = _joined(rows, rows.groupBy(*date).agg(F.count("*").alias("_count")), date)
    spots = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(_at(p, F.col("_count"))), F.ceil(_at(p, F.col("_count")))) for p in ps])))
    found = sized.where(F.array_contains(spots, F.col("_place")))
    at = lambda place: F.max(F.when(F.col("_place") == place, F.col(value).cast("double")))
    made = found.groupBy(*date).agg(F.max("_count").alias("n"), *[x for i, p in enumerate(ps) for x in (at(F.floor(_at(p, F.col("_count")))).alias(f"_l{i}"), at(F.ceil(_at(p, F.col("_count")))).alias(f"_h{i}"))])
    mixed = lambda i, p: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (_at(p, F.col("n")) - F.floor(_at(p, F.col("n"))))
    return made.select(*date, "n", *[mixed(i, p).alias(f"p{i}") for i, p in enumerate(ps)])


def winsorize(df: DataFrame, date: Sequence[str], value: str, lower: float, upper: float) -> DataFrame:
    """winsorized: values clipped at two percentiles of their date."""
    bounds = written(percentiles(df, date, value, [lower, upper]))
    clipped = F.least(F.greatest(F.col(value), F.col("p0")), F.col("p1"))
    made = _joined(df.drop("winsorized").where(F.col(value).isNotNull()), bounds.drop("n"), date).withColumn("winsorized", clipped).drop("p0", "p1")
    return _with_unknown(made, df.drop("winsorized"), value)
