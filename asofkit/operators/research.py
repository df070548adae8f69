"""The research ladder: covariance, regression, optimisation, walk-forward, selection bias, multiple tests, costs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import div, normal_cdf, normal_ppf

EULER = 0.5772156649015329


#: Most series of a risk model, strategies of a comparison, regressors of a regression and trials of a campaign.
MOST_SERIES, MOST_STRATEGIES, MOST_REGRESSORS, MOST_TRIALS = 16, 32, 8, 64
BROADCAST_ROWS = 100_000


def complete(returns: DataFrame, series: str, date: str, ret: str, by: Sequence[str] = ()) -> DataFrame:
    """The known returns of the dates (in each `by`) on which all series (of that `by`) have one."""
    known = returns.where(F.col(ret).isNotNull())
    if not by:
        total = known.agg(F.count_distinct(series).alias("_all"))
        dates = known.groupBy(date).agg(F.count_distinct(series).alias("_n")).join(F.broadcast(total), F.lit(True)).where("_n = _all").select(date)  # total is one row
        return known.join(dates, date, "left_semi")
    total = known.groupBy(*by).agg(F.count_distinct(series).alias("_all"))
    dates = known.groupBy(*by, date).agg(F.count_distinct(series).alias("_n")).join(total, list(by)).where("_n = _all").select(*by, date)
    return known.join(dates, [*by, date], "left_semi")


def _pairs(rows: DataFrame, by: Sequence[str], series: str, date: str, ret: str, most: int, strict: bool) -> DataFrame:
    """by, x, y (structs of series and return) within a date, for at most `most` series (an error beyond)."""
    held = F.array_sort(F.collect_list(F.struct(F.col(series).alias("s"), F.col(ret).alias("r"))))
    by_date = rows.groupBy(*by, date).agg(held.alias("a"))
    few = F.when(F.size("a") <= most, F.col("a")).otherwise(F.raise_error(F.lit(f"more than {most} series")).cast(by_date.schema["a"].dataType))
    later = lambda y: (y["s"] > F.col("x.s")) if strict else (y["s"] >= F.col("x.s"))
    return by_date.select(*by, few.alias("a")).select(*by, F.explode("a").alias("x"), "a").select(*by, "x", F.explode(F.filter("a", later)).alias("y"))


def upper_triangle(returns: DataFrame, series: str, date: str, ret: str, by: Sequence[str] = (), per_year: int | None = None) -> DataFrame:
    """by, i, j, n, cov, corr for i <= j over the dates that all series have (of at most 16 series); with per_year also cov_year and, on the
    diagonal, vol_year."""
    pairs = _pairs(complete(returns, series, date, ret, by), by, series, date, ret, MOST_SERIES, False)
    x, y = F.col("x.r"), F.col("y.r")
    m = pairs.groupBy(*by, F.col("x.s").alias("i"), F.col("y.s").alias("j")).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("cov"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"))
    out = m.select(*by, "i", "j", "n", "cov", div(F.col("cov"), F.sqrt(F.col("vx") * F.col("vy"))).alias("corr"))
    return out if per_year is None else out.withColumn("cov_year", F.col("cov") * per_year).withColumn("vol_year", F.when(F.col("i") == F.col("j"), F.sqrt(F.col("cov") * per_year)))


def dense_matrix(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, i, j, cov of both triangles; a cell that is missing or given twice is an error."""
    twice = F.when(F.count("*") > 1, F.raise_error(F.lit("a cell is given twice")).cast("double")).otherwise(F.max("cov"))
    both = cells.groupBy(*by, "i", "j").agg(twice.alias("cov"))
    flipped = both.where("i <> j").select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "cov")
    full = both.unionByName(flipped)
    sizes = full.groupBy(*by).agg(F.count_distinct("i").alias("_k"), F.count("*").alias("_n"))
    joined = full.join(sizes, list(by)) if by else full.join(F.broadcast(sizes), F.lit(True))  # sizes is one row
    return joined.withColumn("cov", F.when(F.col("_n") == F.col("_k") * F.col("_k"), F.col("cov")).otherwise(F.raise_error(F.lit("a cell is missing")).cast("double"))).drop("_k", "_n")


def commensurable(series: DataFrame, by: Sequence[str], same: Sequence[str]) -> DataFrame:
    """by, commensurable, differs: whether all series of a group agree on the given columns (schedule, length, version, ...), and the first on which they don't."""
    counts = series.groupBy(*by).agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(f"_{c}") for c in same])
    differs = F.coalesce(*[F.when(F.col(f"_{c}") > 1, F.lit(c)) for c in same])
    return counts.select(*by, differs.isNull().alias("commensurable"), differs.alias("differs"))


def ols_one(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """by, n, alpha, beta, r2, se_beta, t_beta of y on x with an intercept, from sums; residual variance over n - 2."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    m = m.withColumn("beta", div(F.col("c"), F.col("vx"))).withColumn("rss", F.col("n") * (F.col("vy") - F.col("beta") * F.col("c")))
    se = F.sqrt(div(div(F.col("rss"), F.col("n") - 2), F.col("n") * F.col("vx")))
    return m.select(*by, "n", (F.col("my") - F.col("beta") * F.col("mx")).alias("alpha"), "beta", (F.lit(1.0) - div(F.col("rss"), F.col("n") * F.col("vy"))).alias("r2"), se.alias("se_beta"), div(F.col("beta"), se).alias("t_beta"))


def ols_many(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], intercept: bool = True) -> DataFrame:
    """by, n, term, coef, se, t, contribution (coef times the mean of its x), r2, adj_r2, residual_se, reason of y on at most 8 x.

    Null with INSUFFICIENT_OBSERVATIONS below one more row than terms, with SINGULAR_DESIGN where the x depend on each other. Spark sums
    the cross products (p (p + 1) / 2 of them, whatever the rows); a task solves one small system for each group."""
    if len(xs) > MOST_REGRESSORS:
        raise ValueError(f"at most {MOST_REGRESSORS} regressors")
    ok = df.dropna(subset=[*xs, y])
    columns = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    p = len(columns)
    sums = [F.sum(columns[i] * columns[j]).alias(f"_{i}_{j}") for i in range(p) for j in range(i, p)]
    grams = ok.groupBy(*by).agg(*sums)
    terms = ["intercept", *xs] if intercept else list(xs)
    skip = 0 if intercept else 1

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                g = np.zeros((p, p))
                for i in range(p):
                    for j in range(i, p):
                        g[i, j] = g[j, i] = row[f"_{i}_{j}"]
                n, means = int(g[0, 0]), g[0, skip:-1] / g[0, 0]
                a, b, k = g[skip:-1, skip:-1], g[skip:-1, -1], p - 1 - skip
                reason = "INSUFFICIENT_OBSERVATIONS" if n < k + 1 else None
                scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
                if reason is None and np.linalg.cond(a / np.outer(scale, scale)) > 1e12:
                    reason = "SINGULAR_DESIGN"
                head = [row[x] for x in by]
                if reason:
                    rows += [[*head, n, t, *[None] * 7, reason] for t in terms]
                    continue
                inverse = np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)
                coef = np.linalg.solve(a, b)
                rss = max(0.0, g[-1, -1] - coef @ b)
                tss = g[-1, -1] - (g[0, -1] ** 2 / n if intercept else 0.0)
                free = n - k
                s2 = rss / free if free > 0 else np.nan
                se = np.sqrt(np.maximum(0, np.diag(inverse) * s2))
                r2 = 1 - rss / tss if tss > 0 else None
                adjusted = None if r2 is None or free <= 0 else 1 - (1 - r2) * (n - (1 if intercept else 0)) / free
                for t, c, e, m in zip(terms, coef, se, means, strict=True):
                    rows.append([*head, n, t, c, e, c / e if e > 0 else None, c * m, r2, adjusted, np.sqrt(s2), None])
            yield pd.DataFrame(rows, columns=[*by, "n", "term", "coef", "se", "t", "contribution", "r2", "adj_r2", "residual_se", "reason"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return grams.mapInPandas(solve, f"{kinds}{', ' if by else ''}n long, term string, coef double, se double, t double, contribution double, r2 double, adj_r2 double, residual_se double, reason string")


def fama_macbeth(slopes: DataFrame, by: Sequence[str], slope: str) -> DataFrame:
    """by, m, premium, se, t, reason: the mean of the dates' slopes, sd / sqrt(m) and t; INSUFFICIENT_PERIODS below two dates, ZERO_VARIANCE where all slopes are equal."""
    m = slopes.groupBy(*by).agg(F.count(slope).alias("m"), F.avg(slope).alias("_mean"), F.stddev_pop(slope).alias("_sd"), (F.max(slope) > F.min(slope)).alias("_differ"))
    enough = F.col("m") >= 2
    m = m.withColumn("premium", F.when(enough, F.col("_mean"))).withColumn("se", F.when(enough & F.col("_differ"), F.col("_sd") / F.sqrt("m")))
    return m.select(*by, "m", "premium", "se", div(F.col("premium"), F.col("se")).alias("t"), F.when(~enough, "INSUFFICIENT_PERIODS").when(~F.col("_differ"), "ZERO_VARIANCE").alias("reason"))


def solve_definite(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """a x = b; None if a is not positive definite."""
    scale = np.sqrt(np.diag(a)) if (np.diag(a) > 0).all() else None
    if scale is None:
        return None
    unit = a / np.outer(scale, scale)
    try:
        if np.diag(np.linalg.cholesky(unit)).min() < 1e-7:  # singular but for rounding
            return None
    except np.linalg.LinAlgError:
        return None
    return np.linalg.solve(unit, b / scale) / scale


def minimum_variance(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, series, weight, variance of the fully invested portfolio of least variance, from cells (i, j, cov) of at most 16 series.

    weight and variance are null where the matrix is not positive definite. One small matrix for each group."""
    held = cells.groupBy(*by).agg(F.collect_list(F.struct("i", "j", "cov")).alias("cells"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                found = {(str(c["i"]), str(c["j"])): c["cov"] for c in row["cells"]}
                names = sorted({i for pair in found for i in pair})
                if len(names) > MOST_SERIES:
                    raise ValueError(f"a risk model has at most {MOST_SERIES} series")
                a = np.array([[found.get((min(i, j), max(i, j)), 0.0) for j in names] for i in names])  # a cell left out is no covariance
                x = solve_definite(a, np.ones(len(names)))
                w = None if x is None else x / x.sum()
                rows += [[*(row[k] for k in by), s, None if w is None else w[k], None if w is None else float(w @ a @ w)] for k, s in enumerate(names)]
            yield pd.DataFrame(rows, columns=[*by, "series", "weight", "variance"])

    kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in by)
    return held.mapInPandas(solve, f"{kinds}{', ' if by else ''}series string, weight double, variance double")


def windows(dates: DataFrame, date: str, train: int, test: int, rolling: bool = True) -> DataFrame:
    """window, role (train, test), date: disjoint test blocks of `test` dates, the last one cut short, each after its `train` dates
    (all earlier ones, if not rolling). dates: one column of distinct dates (a calendar, small)."""
    placed = dates.select(date).distinct().select(date, (F.row_number().over(Window.orderBy(date)) - 1).alias("_i"))
    n = F.col("_i")
    tests = placed.where(n >= train).select(F.floor((n - train) / test).cast("long").alias("window"), F.lit("test").alias("role"), date)
    last = placed.agg(F.max("_i").alias("_n"))
    starts = last.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - train) / test).cast("int"))).alias("window")).where(F.col("window") >= 0)
    first = F.col("window") * test if rolling else F.lit(0)
    trains = starts.select(F.col("window").cast("long").alias("window"), F.explode(F.sequence(first, F.col("window") * test + train - 1)).alias("_i")).join(placed, "_i").select("window", F.lit("train").alias("role"), date)
    return trains.unionByName(tests)


def walk_forward(returns: DataFrame, series: str, date: str, ret: str, train: int, test: int) -> DataFrame:
    """window, date, oos_return, predicted_variance: minimum variance on each training slice, applied to its test dates; on the dates that all
    series have. Returns are a research panel (a calendar times at most 16 series): its calendar of windows is checked and then broadcast."""
    held = complete(returns, series, date, ret)
    w = windows(held, date, train, test)
    small = w.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    tagged = held.join(F.broadcast(w) if small else w, date)
    weights = minimum_variance(upper_triangle(tagged.where("role = 'train'"), series, date, ret, ["window"]), ["window"])
    tests = tagged.where("role = 'test'")
    joined = tests.join(weights, (tests["window"] == weights["window"]) & (F.col(series).cast("string") == weights["series"])).drop(weights["window"])
    return joined.groupBy("window", date).agg(F.sum(F.col("weight") * F.col(ret)).alias("oos_return"), F.first("variance").alias("predicted_variance"))


def realised(walk: DataFrame) -> DataFrame:
    """window, n, predicted, realised, reason of a walk forward; realised is null for a single date (SINGLE_VALID_PERIOD), both for a window without weights (WINDOW_UNDEFINED)."""
    m = walk.groupBy("window").agg(F.count("oos_return").alias("n"), F.max("predicted_variance").alias("predicted"), F.when(F.count("oos_return") > 1, F.var_pop("oos_return")).alias("realised"))
    return m.withColumn("reason", calibration_exclusion(F.col("n") > 0, F.col("predicted"), F.col("realised")))


def calibration_exclusion(window_known: Column, predicted: Column, realised: Column) -> Column:
    """Why a window takes no part in a calibration, in this order; null if it does."""
    return F.when(~window_known, "WINDOW_UNDEFINED").when(predicted.isNull(), "PREDICTED_VARIANCE_UNDEFINED").when(predicted <= 0, "ZERO_PREDICTED_VARIANCE").when(realised.isNull(), "SINGLE_VALID_PERIOD")


# selection bias


def probabilistic_sharpe(sharpe: Column, n: Column, skew: Column, kurtosis: Column, benchmark: Column) -> Column:
    """P(true Sharpe > benchmark); kurtosis is not excess; null where the variance term is not positive."""
    v = F.lit(1.0) - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    return F.when((v > 0) & (n > 1), normal_cdf((sharpe - benchmark) * F.sqrt(n - 1) / F.sqrt(v)))


def expected_max_sharpe(variance: Column, trials: Column) -> Column:
    """Of the best of independent trials without skill."""
    e = F.lit(float(np.e))
    return F.sqrt(variance) * (F.lit(1 - EULER) * normal_ppf(F.lit(1.0) - F.lit(1.0) / trials) + F.lit(EULER) * normal_ppf(F.lit(1.0) - F.lit(1.0) / (trials * e)))


def campaign(trials: DataFrame, trial: str, sharpe: str, n: str, skew: str, kurtosis: str) -> DataFrame:
    """trials (at most 64 rows) with psr against 0, whether selected (best Sharpe, first trial wins ties), the deflated Sharpe of each and reason. The expected best
    counts all trials, their dispersion the valid ones; with fewer than two valid trials nothing is selected (INSUFFICIENT_VALID_TRIALS)."""
    stats = trials.agg(F.count("*").alias("_t"), F.count(sharpe).alias("_ok"), F.var_pop(sharpe).alias("_v"), F.max(F.when(F.col(sharpe).isNotNull(), F.struct(F.col(sharpe), (-F.col(trial)).alias("t")))).alias("_best"))
    stats = stats.withColumn("_t", F.when(F.col("_t") <= MOST_TRIALS, F.col("_t")).otherwise(F.raise_error(F.lit(f"more than {MOST_TRIALS} trials")).cast("long")))
    s, k = F.col(sharpe), [F.col(n).cast("double"), F.col(skew), F.col(kurtosis)]
    both = trials.join(F.broadcast(stats), F.lit(True))  # stats is one row
    enough = F.col("_ok") >= 2
    psr, deflated = probabilistic_sharpe(s, *k, F.lit(0.0)), probabilistic_sharpe(s, *k, expected_max_sharpe(F.col("_v"), F.col("_t").cast("double")))
    both = both.withColumn("psr", F.when(enough, psr)).withColumn("deflated", F.when(enough, deflated)).withColumn("selected", enough & F.coalesce(F.col(trial) == -F.col("_best.t"), F.lit(False)))
    reason = F.when(~enough, "INSUFFICIENT_VALID_TRIALS").when(s.isNull(), "UNDEFINED_SHARPE").when(F.col("psr").isNull(), "DEGENERATE_SHARPE_ESTIMATOR")
    return both.withColumn("reason", reason).drop("_t", "_ok", "_v", "_best")


def minimum_track_record(sharpe: Column, skew: Column, kurtosis: Column, benchmark: Column, alpha: float = 0.05) -> Column:
    """1 + v (z / (SR - SR*))^2; null where degenerate or SR <= SR*."""
    v = F.lit(1.0) - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    return F.when((v > 0) & (sharpe > benchmark), F.lit(1.0) + v * F.pow(normal_ppf(F.lit(1 - alpha)) / (sharpe - benchmark), 2))


def track_records(trials: DataFrame, trial: str, sharpe: str, n: str, skew: str, kurtosis: str, benchmark: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """trials with min_length, sufficient (n at or above it) and reason, which tells a degenerate estimator before a Sharpe ratio that is not above the benchmark."""
    s = F.col(sharpe)
    v = F.lit(1.0) - F.col(skew) * s + (F.col(kurtosis) - 1) / 4 * s * s
    reason = F.when(s.isNull() | v.isNull(), "TRIAL_UNDEFINED").when(v <= 0, "DEGENERATE_SHARPE_ESTIMATOR").when(s <= benchmark, "SHARPE_NOT_ABOVE_BENCHMARK")
    out = trials.withColumn("min_length", minimum_track_record(s, F.col(skew), F.col(kurtosis), F.lit(benchmark), alpha))
    return out.withColumn("sufficient", F.col(n) >= F.col("min_length")).withColumn("reason", reason)


def track_record_profile(records: DataFrame, by: Sequence[str] = (), least: int = 2) -> DataFrame:
    """by, n_determined, mean, dispersion, longest, shortest, sufficient_share, status, reason over the trials with a minimum length; EVALUATED from `least` of them on."""
    m = F.col("min_length")
    out = records.groupBy(*by).agg(F.count(m).alias("n_determined"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("dispersion"), F.max(m).alias("longest"), F.min(m).alias("shortest"), F.avg(F.when(m.isNotNull(), F.col("sufficient").cast("double"))).alias("sufficient_share"))
    enough = F.col("n_determined") >= least
    return out.withColumn("status", F.when(enough, "EVALUATED").otherwise("UNDEFINED")).withColumn("reason", F.when(~enough, "INSUFFICIENT_DETERMINED_TRIALS"))


def paired_differences(returns: DataFrame, series: str, date: str, ret: str) -> DataFrame:
    """i, j, n, mean_diff, se, t, p (two-sided, normal), sharpe_diff, reason for i < j of at most 32 series, over the dates both have; INSUFFICIENT_OVERLAP below two
    dates, ZERO_VARIANCE where the difference is constant."""
    pairs = _pairs(returns.where(F.col(ret).isNotNull()), [], series, date, ret, MOST_STRATEGIES, True)
    x, y = F.col("x.r"), F.col("y.r")
    d = x - y
    m = pairs.groupBy(F.col("x.s").alias("i"), F.col("y.s").alias("j")).agg(F.count("*").alias("n"), F.avg(d).alias("_d"), F.var_pop(d).alias("_v"), (F.max(d) > F.min(d)).alias("_differ"), div(F.avg(x), F.stddev_pop(x)).alias("_sx"), div(F.avg(y), F.stddev_pop(y)).alias("_sy"))
    reason = F.when(F.col("n") < 2, "INSUFFICIENT_OVERLAP").when(~F.col("_differ"), "ZERO_VARIANCE")
    m = m.withColumn("reason", reason).withColumn("mean_diff", F.when(F.col("n") > 1, F.col("_d"))).withColumn("se", F.when(F.col("reason").isNull(), F.sqrt(F.col("_v") / F.col("n"))))
    m = m.withColumn("t", div(F.col("mean_diff"), F.col("se")))
    return m.select("i", "j", "n", "mean_diff", "se", "t", two_sided_p(F.col("t")).alias("p"), F.when(F.col("n") > 1, F.col("_sx") - F.col("_sy")).alias("sharpe_diff"), "reason")


def adjusted_p(tests: DataFrame, by: Sequence[str], test: str, p: str) -> DataFrame:
    """tests with bonferroni, holm, bh, by: adjusted p values of the tests with a known p in each family; ties in order of the test."""
    known = F.col(p).isNotNull()
    w = Window.partitionBy(*by, "_known").orderBy(p, test)
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = tests.withColumn("_known", known).withColumn("_i", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy(*by, "_known")))
    cap = lambda x: F.least(F.lit(1.0), x)
    i, m = F.col("_i"), F.col("_m").cast("double")
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k)
    out = rows.withColumn("bonferroni", cap(F.col(p) * m)).withColumn("holm", cap(F.max(F.col(p) * (m - i + 1)).over(up)))
    out = out.withColumn("bh", cap(F.min(F.col(p) * m / i).over(down))).withColumn("by", cap(F.min(F.col(p) * m / i * harmonic).over(down)))
    for c in ("bonferroni", "holm", "bh", "by"):
        out = out.withColumn(c, F.when(F.col("_known"), F.col(c)))
    return out.drop("_known", "_i", "_m")


def two_sided_p(t: Column) -> Column:
    return F.lit(2.0) * normal_cdf(-F.abs(t))


def one_sided_p(t: Column) -> Column:
    return normal_cdf(-t)


# calibration, stability, costs, admissibility


def calibration(df: DataFrame, by: Sequence[str], predicted: str, realised: str, least: int = 2) -> DataFrame:
    """Realised over predicted variance: n, mean_ratio, pooled_bias, dispersion, under_forecast, max_ratio, min_ratio, t and two-sided p against 1, bias, reason.

    The bias (UNDER_FORECAST, OVER_FORECAST, NONE) is told even where it can't be tested: INSUFFICIENT_WINDOWS below `least`, ZERO_VARIANCE where all ratios are equal."""
    ok = calibration_exclusion(F.lit(True), F.col(predicted), F.col(realised)).isNull()
    rows = df.where(ok).withColumn("_r", div(F.col(realised), F.col(predicted)))
    m = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("_r").alias("mean_ratio"), div(F.sum(realised), F.sum(predicted)).alias("pooled_bias"), F.stddev_pop("_r").alias("dispersion"),
        F.avg((F.col("_r") > 1).cast("double")).alias("under_forecast"), F.max("_r").alias("max_ratio"), F.min("_r").alias("min_ratio"),
    )
    reason = F.when(F.col("n") < least, "INSUFFICIENT_WINDOWS").when(F.col("max_ratio") == F.col("min_ratio"), "ZERO_VARIANCE")
    m = m.withColumn("reason", reason).withColumn("t", F.when(F.col("reason").isNull(), div(F.col("mean_ratio") - 1, F.col("dispersion") / F.sqrt("n"))))
    bias = F.when(F.col("mean_ratio") > 1, "UNDER_FORECAST").when(F.col("mean_ratio") < 1, "OVER_FORECAST").otherwise("NONE")
    return m.withColumn("p", two_sided_p(F.col("t"))).withColumn("bias", bias)


def turnover(weights: DataFrame, by: Sequence[str], window: str, series: str, weight: str) -> DataFrame:
    """by, window, turnover: half the absolute change of weights from the window numbered one less; null where that is missing (a gap)."""
    per = weights.where(F.col(weight).isNotNull()).groupBy(*by, window).agg(F.map_from_entries(F.collect_list(F.struct(series, weight))).alias("_w"))
    prev = per.select(*by, (F.col(window) + 1).alias(window), F.col("_w").alias("_prev"))
    names = F.array_union(F.map_keys("_w"), F.map_keys("_prev"))
    change = F.aggregate(F.array_sort(names), F.lit(0.0), lambda a, s: a + F.abs(F.coalesce(F.col("_w")[s], F.lit(0.0)) - F.coalesce(F.col("_prev")[s], F.lit(0.0))))
    return per.join(prev, [*by, window], "left").select(*by, window, F.when(F.col("_prev").isNotNull(), change / 2).alias("turnover"))


def concentration(weights: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """gross, hhi, max_weight, breadth (1 / hhi)."""
    m = weights.groupBy(*by).agg(F.sum(F.abs(weight)).alias("gross"), F.sum(F.col(weight) * F.col(weight)).alias("hhi"), F.max(F.abs(weight)).alias("max_weight"))
    return m.withColumn("breadth", div(F.lit(1.0), F.col("hhi")))


def net_of_cost(returns: DataFrame, by: Sequence[str], window: str, date: str, ret: str, turnover_col: str, rate: float) -> DataFrame:
    """returns with cost and net: rate times turnover on the first date of each window that has one."""
    first = F.row_number().over(Window.partitionBy(*by, window).orderBy(date)) == 1
    cost = F.when(F.col("_first") & F.col(turnover_col).isNotNull(), F.col(turnover_col) * rate).otherwise(0.0)
    return returns.withColumn("_first", first).withColumn("cost", cost).withColumn("net", F.col(ret) - F.col("cost")).drop("_first")


def break_even(returns: DataFrame, by: Sequence[str], ret: str, turnover_col: str) -> DataFrame:
    """The cost rate at which the sum of returns is spent: sum of returns over sum of turnover (one value a window)."""
    return returns.groupBy(*by).agg(div(F.sum(ret), F.sum(turnover_col)).alias("break_even"))


def stability(transitions: DataFrame, by: Sequence[str], turnover_col: str, least: int = 2) -> DataFrame:
    """by, n_transitions, mean, dispersion, most, fewest, status, reason over the known turnovers: STABLE from `least` of them on, else INSUFFICIENT_TRANSITIONS."""
    t = F.col(turnover_col)
    m = transitions.groupBy(*by).agg(F.count(t).alias("n_transitions"), F.avg(t).alias("mean"), F.stddev_pop(t).alias("dispersion"), F.max(t).alias("most"), F.min(t).alias("fewest"))
    enough = F.col("n_transitions") >= least
    return m.withColumn("status", F.when(enough, "STABLE").otherwise("UNDEFINED")).withColumn("reason", F.when(~enough, "INSUFFICIENT_TRANSITIONS"))


def cost_drags(costed: DataFrame, by: Sequence[str], ret: str, per_year: int = 12) -> DataFrame:
    """by, n, gross and net mean, vol and sharpe, mean_drag and sharpe_drag (gross less net), total_cost, profitable, t and one-sided p of the net mean; costed: with net and cost."""
    root = F.lit(float(per_year) ** 0.5)
    kinds = {"gross": ret, "net": "net"}
    parts = [x for k, c in kinds.items() for x in (F.avg(c).alias(f"{k}_mean"), F.stddev_pop(c).alias(f"{k}_vol"))]
    m = costed.where(F.col(ret).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *parts, F.sum("cost").alias("total_cost"))
    for k in kinds:
        m = m.withColumn(f"{k}_sharpe", div(F.col(f"{k}_mean"), F.col(f"{k}_vol")) * root)
    m = m.withColumn("mean_drag", F.col("gross_mean") - F.col("net_mean")).withColumn("sharpe_drag", F.col("gross_sharpe") - F.col("net_sharpe")).withColumn("profitable", F.col("net_mean") > 0)
    m = m.withColumn("t", F.when(F.col("n") > 1, div(F.col("net_mean"), F.col("net_vol")) * F.sqrt("n")))
    return m.withColumn("p", one_sided_p(F.col("t")))


def admissibility(stable: Column, calibration_p: Column, net_p: Column, profitable: Column, alpha: float = 0.05) -> Column:
    """struct<stability,calibration,net_edge,verdict>: each PASS, FAIL or UNDEFINED. Any UNDEFINED makes the verdict UNDEFINED, else all must PASS for ADMISSIBLE."""
    one = F.when(F.coalesce(stable, F.lit(False)), "PASS").otherwise("UNDEFINED")
    two = F.when(calibration_p.isNull(), "UNDEFINED").when(calibration_p > alpha, "PASS").otherwise("FAIL")
    three = F.when(net_p.isNull() | profitable.isNull(), "UNDEFINED").when((net_p <= alpha) & profitable, "PASS").otherwise("FAIL")
    all_ = F.array(one, two, three)
    verdict = F.when(F.array_contains(all_, "UNDEFINED"), "UNDEFINED").when(F.array_contains(all_, "FAIL"), "INADMISSIBLE").otherwise("ADMISSIBLE")
    return F.struct(one.alias("stability"), two.alias("calibration"), three.alias("net_edge"), verdict.alias("verdict"))


def aligned(left: DataFrame, right: DataFrame, window: str) -> DataFrame:
    """Two tables of windows joined by their index; a window that one of them lacks is an error."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    both = a.join(b, window, "full")
    ok = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.withColumn(window, F.when(ok, F.col(window)).otherwise(F.raise_error(F.lit("the windows differ")).cast(left.schema[window].dataType))).drop("_l", "_r")


def dated(returns: DataFrame, windows_: DataFrame, window: str, ordinal: str, date: str) -> DataFrame:
    """Returns numbered within their windows (from 0) with the date of that place among the window's test dates (window, role, date)."""
    tests = windows_.where("role = 'test'").withColumn(ordinal, (F.row_number().over(Window.partitionBy(window).orderBy(date)) - 1).cast("int")).select(window, ordinal, date)
    return returns.join(tests, [window, ordinal])
