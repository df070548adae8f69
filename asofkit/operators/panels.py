"""Panels over periods: windows within a member, and transforms across members of a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import cell, div


def _in_time(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def growth(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """growth cell: (v - prev) / prev; the current value is checked before the one before it."""
    prev = F.lag(value).over(_in_time(keys, order))
    return df.withColumn("_prev", prev).withColumn("growth", cell(div(F.col(value) - F.col("_prev"), F.col("_prev")), (F.col(value).isNull(), "missing_input"), (F.col("_prev").isNull(), "missing_input"), (F.col("_prev") == 0, "divide_by_zero"))).drop("_prev")


def average_balance(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    return df.withColumn("average", (F.col(value) + F.lag(value).over(_in_time(keys, order))) / 2)


def trailing_sum(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int = 4) -> DataFrame:
    """ttm: the sum of exactly n values up to this one, null if any is missing."""
    w = _in_time(keys, order).rowsBetween(-(n - 1), 0)
    return df.withColumn("ttm", F.when(F.count(value).over(w) == n, F.sum(value).over(w)))


def level_vs_history(df: DataFrame, keys: Sequence[str], order: str, value: str, n: int, reference: str = "median") -> DataFrame:
    """level: v less the median, min or max of the known ones among the n rows before it; null with fewer rows before, or none known."""
    w = _in_time(keys, order)
    frame = w.rowsBetween(-n, -1)
    if reference == "median":  # which Spark has not over a frame
        held = F.array_sort(F.collect_list(value).over(frame))
        size = F.size(held)
        base = (F.get(held, F.floor((size - 1) / 2).cast("int")) + F.get(held, F.floor(size / 2).cast("int"))) / 2
    else:
        base = {"min": F.min, "max": F.max}[reference](value).over(frame)
    return df.withColumn("level", F.when(F.row_number().over(w) > n, F.col(value) - base))


def forward_return(df: DataFrame, keys: Sequence[str], order: str, close: str, n: int = 1) -> DataFrame:
    """fwd: close n observations later over this one, less 1; null unless this one is above 0."""
    return df.withColumn("fwd", F.when(F.col(close) > 0, div(F.lead(close, n).over(_in_time(keys, order)), F.col(close)) - 1))


def period_return(df: DataFrame, keys: Sequence[str], order: str, close: str) -> DataFrame:
    return df.withColumn("ret", div(F.col(close), F.lag(close).over(_in_time(keys, order))) - 1)


def _across(date: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*date)


def ordinal_rank(df: DataFrame, date: Sequence[str], value: str, member: str) -> DataFrame:
    """rank 1..n ascending over known values, ties by member."""
    rank = F.row_number().over(_across([*date, "_known"]).orderBy(value, member))
    return df.withColumn("_known", F.col(value).isNotNull()).withColumn("rank", F.when(F.col("_known"), rank).cast("long")).drop("_known")


def zscore(df: DataFrame, date: Sequence[str], value: str) -> DataFrame:
    """Population z-score; null where all values are equal."""
    w = _across(date)
    spread = F.max(value).over(w) > F.min(value).over(w)
    return df.withColumn("zscore", F.when(spread, div(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w))))


def minmax(df: DataFrame, date: Sequence[str], value: str) -> DataFrame:
    w = _across(date)
    return df.withColumn("minmax", div(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)))


def winsorize(df: DataFrame, date: Sequence[str], value: str, lower: float, upper: float) -> DataFrame:
    """Values clipped at percentiles interpolated at p (n - 1). The percentiles are aggregated by date and joined back."""
    bounds = df.groupBy(*date).agg(F.percentile(value, F.array(F.lit(lower), F.lit(upper))).alias("_b"))
    clipped = F.least(F.greatest(F.col(value), F.col("_b")[0]), F.col("_b")[1])
    return df.join(bounds, list(date)).withColumn("winsorized", F.when(F.col(value).isNotNull(), clipped)).drop("_b")


def average_rank(value: str, date: Sequence[str]) -> Column:
    """Fractional rank: ties share the mean of their ranks."""
    w = _across(date)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(_across([*date, value])) - 1) / F.lit(2.0)


def quantile_buckets(df: DataFrame, date: Sequence[str], value: str, member: str, n: int, per_bucket: int = 1) -> DataFrame:
    """bucket floor(i n / count) of the row at place i by (value, member); null where there are fewer than n x per_bucket rows.

    Diagnostics take one row a bucket, portfolios two."""
    i, count = F.row_number().over(_across(date).orderBy(value, member)) - 1, F.count("*").over(_across(date))
    return df.withColumn("bucket", F.when(count >= n * per_bucket, F.floor(i * n / count)).cast("long"))


def bucket_means(df: DataFrame, date: Sequence[str], bucket: str, ret: str, n: int) -> DataFrame:
    """date, bucket 0..n-1, n, mean, reason: a row for each bucket of each date, EMPTY_BUCKET where it has no row."""
    found = df.where(F.col(bucket).isNotNull()).groupBy(*date, bucket).agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"))
    all_ = df.select(*date).distinct().withColumn(bucket, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    out = all_.join(found, [*date, bucket], "left").fillna(0, ["n"])
    return out.withColumn("reason", F.when(F.col("n") == 0, "EMPTY_BUCKET"))


def mean_of_means(means: DataFrame, bucket: str) -> DataFrame:
    """bucket, n_dates, mean: over the dates that have one."""
    return means.where(F.col("mean").isNotNull()).groupBy(bucket).agg(F.count("*").alias("n_dates"), F.avg("mean").alias("mean"))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with all columns known, and one row of counts: n, kept and, for each column, the rows dropped for it (the first that is missing)."""
    reason = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    marked = df.withColumn("_missing", reason)
    counts = marked.agg(F.count("*").alias("n"), F.count_if(F.col("_missing").isNull()).alias("kept"), *[F.count_if(F.coalesce(F.col("_missing") == c, F.lit(False))).alias(f"dropped_{c}") for c in columns])
    return marked.where(F.col("_missing").isNull()).drop("_missing"), counts


def moments(x: Column, y: Column) -> list[Column]:
    """What a correlation of x and y needs, summed."""
    ok = x.isNotNull() & y.isNotNull()
    v = lambda c: F.when(ok, c)
    return [F.count(v(x)).alias("n"), F.avg(v(x)).alias("mx"), F.avg(v(y)).alias("my"), F.var_pop(v(x)).alias("vx"), F.var_pop(v(y)).alias("vy"), F.covar_pop(v(x), v(y)).alias("cxy"), (F.max(v(x)) > F.min(v(x))).alias("dx"), (F.max(v(y)) > F.min(v(y))).alias("dy")]


def correlation(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """by, n, ic, ic_reason: Pearson correlation; a constant x is told before a constant y."""
    m = df.groupBy(*by).agg(*moments(F.col(x), F.col(y)))
    reason = F.when(F.col("n") < 2, "INSUFFICIENT_MEMBERS").when(~F.col("dx"), "ZERO_SIGNAL_VARIANCE").when(~F.col("dy"), "ZERO_RETURN_VARIANCE")
    value = F.when(reason.isNull(), div(F.col("cxy"), F.sqrt(F.col("vx") * F.col("vy"))))
    return m.select(*by, "n", value.alias("ic"), reason.alias("ic_reason"))


def spread_by_date(df: DataFrame, date: Sequence[str], bucket: str, ret: str, n: int) -> DataFrame:
    """Top less bottom bucket's mean return by date: one aggregation, both legs at once."""
    leg = lambda b: F.avg(F.when(F.col(bucket) == b, F.col(ret)))
    return df.groupBy(*date).agg(leg(n - 1).alias("top"), leg(0).alias("bottom")).withColumn("spread", F.col("top") - F.col("bottom"))


def long_short(df: DataFrame, date: Sequence[str], signal: str, member: str, ret: str, n: int) -> DataFrame:
    """date, long, short, ret, reason: mean returns of the last and the first of n buckets; INSUFFICIENT_MEMBERS below two rows a bucket."""
    ok = df.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    legs = spread_by_date(quantile_buckets(ok, date, signal, member, n, per_bucket=2), date, "bucket", ret, n)
    return legs.select(*date, F.col("top").alias("long"), F.col("bottom").alias("short"), F.col("spread").alias("ret"), F.when(F.col("top").isNull(), "INSUFFICIENT_MEMBERS").alias("reason"))
