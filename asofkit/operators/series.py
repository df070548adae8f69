"""Statistics of return series, one aggregation by series; all dispersion is population dispersion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import div
from .pit import asof_join


def summary(df: DataFrame, by: Sequence[str], ret: str, per_year: int = 12, risk_free: float = 0.0) -> DataFrame:
    """n, mean, vol, sharpe (annualised), t_stat, hit_rate, cumulative, best, worst, downside, sortino, skew, kurtosis (excess); central moments, so
    nothing cancels."""
    r = F.col(ret)
    base = df.where(r.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("_sd"), F.skewness(r).alias("_skew"), F.kurtosis(r).alias("_kurtosis"),
        F.max(r).alias("best"), F.min(r).alias("worst"), F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.product(r + 1).alias("growth"), F.sqrt(F.avg(F.pow(F.least(r - risk_free, F.lit(0.0)), 2))).alias("downside"),
    )
    m, some = F.col("mean"), F.col("best") > F.col("worst")
    root = F.lit(float(per_year) ** 0.5)
    out = base.withColumn("vol", F.when(some, F.col("_sd")))
    return out.select(
        *by, "n", "mean", "vol", (div(m - risk_free, F.col("vol")) * root).alias("sharpe"), (div(m, F.col("vol")) * F.sqrt("n")).alias("t_stat"), "hit_rate",
        (F.col("growth") - 1).alias("cumulative"), "best", "worst", "downside", (div(m - risk_free, F.col("downside")) * root).alias("sortino"),
        F.when(some, F.col("_skew")).alias("skew"), F.when(some, F.col("_kurtosis")).alias("kurtosis"),
    )


def wealth(df: DataFrame, by: Sequence[str], order: str, ret: str, start: float = 1.0) -> DataFrame:
    """level: the product of 1 + ret so far; a first row of `start` at order null comes before, so that a fall from the start counts."""
    grown = F.product(F.col(ret) + 1).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = df.where(F.col(ret).isNotNull()).select(*by, order, (grown * start).alias("level"))
    first = rows.groupBy(*by).agg(F.lit(start).alias("level")).withColumn(order, F.lit(None).cast(rows.schema[order].dataType))
    return rows.unionByName(first)


def drawdowns(df: DataFrame, by: Sequence[str], order: str, level: str) -> DataFrame:
    """peak and drawdown (level / running peak - 1) at each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("peak", F.max(level).over(w)).withColumn("drawdown", div(F.col(level), F.col("peak")) - 1)


def worst_episode(df: DataFrame, by: Sequence[str], order: str, level: str) -> DataFrame:
    """by, max_drawdown (a positive number), duration (trough less peak place), recovery (periods from the trough to the first
    level at or above the peak, null if none): the earliest trough of the deepest fall, from its earliest peak."""
    w = Window.partitionBy(*by).orderBy(order)
    placed = drawdowns(df, by, order, level).withColumn("_i", F.row_number().over(w))
    placed = placed.withColumn("_peak_at", F.max(F.when((F.lag("peak").over(w).isNull()) | (F.col("peak") > F.lag("peak").over(w)), F.col("_i"))).over(w))
    trough = placed.groupBy(*by).agg(F.min(F.struct("drawdown", "_i", "_peak_at", "peak")).alias("_t"))
    after = placed.join(trough, list(by)).where((F.col("_i") > F.col("_t._i")) & (F.col(level) >= F.col("_t.peak"))).groupBy(*by).agg(F.min("_i").alias("_back"))
    fell = F.col("_t.drawdown") < 0
    return trough.join(after, list(by), "left").select(*by, (-F.col("_t.drawdown")).alias("max_drawdown"), F.when(fell, F.col("_t._i") - F.col("_t._peak_at")).otherwise(0).cast("long").alias("duration"), F.when(fell, F.col("_back") - F.col("_t._i")).cast("long").alias("recovery"))


def value_at_risk(df: DataFrame, by: Sequence[str], ret: str, level: float = 0.95) -> DataFrame:
    """Historical VaR and CVaR by nearest rank, signed: with k = max(1, ceil((1 - level) n)), the k-th smallest return and the mean of the k smallest.
    Null with fewer than two returns."""
    known = df.where(F.col(ret).isNotNull())
    k = F.greatest(F.lit(1), F.ceil(F.round(F.lit(1 - level) * F.col("_n"), 9)))
    w = Window.partitionBy(*by)
    tail = known.withColumn("_i", F.row_number().over(w.orderBy(ret))).withColumn("_n", F.count("*").over(w)).where(F.col("_i") <= k)
    some = F.max("_n") > 1
    return tail.groupBy(*by).agg(F.when(some, F.max(ret)).alias("var"), F.when(some, F.avg(ret)).alias("cvar"))


def relative(df: DataFrame, by: Sequence[str], ret: str, bench: str, per_year: int = 12, risk_free: float = 0.0) -> DataFrame:
    """Against a benchmark: active mean, tracking error, information ratio, beta, alpha, correlation, up and down capture."""
    r, b = F.col(ret), F.col(bench)
    up, down = F.when(b > 0, r), F.when(b < 0, r)
    m = df.where(r.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(r).alias("mr"), F.avg(b).alias("mb"), F.var_pop(b).alias("vb"), F.var_pop(r).alias("vr"), F.covar_pop(r, b).alias("c"),
        F.stddev_pop(r - b).alias("te"), F.avg(up).alias("up"), F.avg(F.when(b > 0, b)).alias("up_b"), F.avg(down).alias("down"), F.avg(F.when(b < 0, b)).alias("down_b"),
    )
    beta = div(F.col("c"), F.col("vb"))
    root = F.lit(float(per_year) ** 0.5)
    return m.select(
        *by, "n", (F.col("mr") - F.col("mb")).alias("active_mean"), (F.col("te") * root).alias("tracking_error"), (div(F.col("mr") - F.col("mb"), F.col("te")) * root).alias("information_ratio"),
        beta.alias("beta"), ((F.col("mr") - risk_free) - beta * (F.col("mb") - risk_free)).alias("alpha"), div(F.col("c"), F.sqrt(F.col("vr") * F.col("vb"))).alias("corr"),
        div(F.col("up"), F.col("up_b")).alias("up_capture"), div(F.col("down"), F.col("down_b")).alias("down_capture"),
    )


def reference_closes(closes: DataFrame, dividends: DataFrame, key: str, date: str, close: str, ex_date: str) -> DataFrame:
    """dividends with reference: the last known close strictly before the ex-date."""
    found = asof_join(dividends, closes.where(F.col(close).isNotNull()), [key], ex_date, date, [close], strict=True)
    return found.withColumnRenamed(close, "reference").drop(f"{date}_matched")


def adjustment_factors(closes: DataFrame, actions: DataFrame, key: str, date: str, ex_date: str, ratio: str, amount: str | None = None, reference: str | None = None) -> DataFrame:
    """closes with factor: the product, over actions with a later ex-date, of 1 / ratio and, if asked for, of 1 - amount / reference.

    Null where a later action has a ratio that is missing or not above 0, or a dividend that is not below a reference above 0 (no factor is 0 or below). A running product in one window, no
    theta join and no logarithms."""
    split = F.when(F.col(ratio) > 0, F.lit(1.0) / F.col(ratio).cast("double"))
    paid = F.when((F.col(reference) > 0) & (F.col(amount) < F.col(reference)), F.lit(1.0) - F.col(amount).cast("double") / F.col(reference)) if amount else None
    f = split if paid is None else F.when(F.col(amount).isNotNull(), paid).otherwise(split)
    mine = closes.select("*", F.lit(None).cast("double").alias("_f"), F.col(date).alias("_at"), F.lit(1).alias("_row"))
    theirs = actions.select(F.col(key), F.col(ex_date).alias("_at"), f.alias("_f"), F.lit(0).alias("_row"))
    w = Window.partitionBy(key).orderBy(F.desc("_at"), F.desc("_row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = mine.unionByName(theirs, allowMissingColumns=True)
    bad = F.count_if((F.col("_row") == 0) & F.col("_f").isNull()).over(w) > 0
    return both.withColumn("factor", F.when(~bad, F.coalesce(F.product("_f").over(w), F.lit(1.0)))).where("_row = 1").drop("_f", "_at", "_row")


def equity_statistics(df: DataFrame, by: Sequence[str], order: str, equity: str, turnover: str | None = None, per_year: int = 1, risk_free: float = 0.0) -> DataFrame:
    """by, n_periods, initial, final, peak, cumulative, mean, vol, sharpe, max_drawdown (0 or below), mean_turnover of equity marks.

    Without dispersion the Sharpe ratio is 0, as are mean and vol of a single mark; a mark of 0 or below, but for the last, is an error."""
    w = Window.partitionBy(*by).orderBy(order)
    lost = F.raise_error(F.lit("an equity mark is not above 0")).cast("double")
    rows = df.withColumn("_prev", F.lag(equity).over(w)).withColumn("_peak", F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("_r", F.when(F.col("_prev").isNotNull(), F.when(F.col("_prev") > 0, F.col(equity) / F.col("_prev") - 1).otherwise(lost)))
    m = rows.groupBy(*by).agg(
        F.count("_r").alias("n_periods"), F.min_by(equity, order).alias("initial"), F.max_by(equity, order).alias("final"), F.max(equity).alias("peak"), F.coalesce(F.avg("_r"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop("_r"), F.lit(0.0)).alias("vol"),
        (F.max("_r") > F.min("_r")).alias("_differ"), F.min(div(F.col(equity), F.col("_peak")) - 1).alias("max_drawdown"), (F.avg(turnover) if turnover else F.lit(None).cast("double")).alias("mean_turnover"),
    )
    fine = F.when(F.col("initial") > 0, F.col("final") / F.col("initial") - 1).otherwise(lost)
    sharpe = F.when(F.coalesce(F.col("_differ"), F.lit(False)), (F.col("mean") - risk_free) / F.col("vol") * float(per_year) ** 0.5).otherwise(0.0)
    return m.select(*by, "n_periods", "initial", "final", "peak", fine.alias("cumulative"), "mean", "vol", sharpe.alias("sharpe"), "max_drawdown", "mean_turnover")
