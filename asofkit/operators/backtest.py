"""Backtests: selection and weights in SQL, the path-dependent portfolio as one fold for each strategy."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(signals: DataFrame, date: Sequence[str], signal: str, member: str, n: int, ascending: bool = False) -> DataFrame:
    """The n best of each date (by signal, highest first unless ascending, then member) with equal weights over those selected."""
    place = F.row_number().over(Window.partitionBy(*date).orderBy(F.asc(signal) if ascending else F.desc(signal), member))
    chosen = signals.where(F.col(signal).isNotNull()).withColumn("place", place.cast("long")).where(F.col("place") <= n)
    return chosen.withColumn("weight", F.lit(1.0) / F.count("*").over(Window.partitionBy(*date)))


def sweep(axes: dict[str, Sequence], spark) -> DataFrame:
    """All combinations of a few parameters, one row each, numbered in order."""
    from itertools import product

    rows = [(i, *c) for i, c in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, ["trial", *axes])


def run(targets: DataFrame, prices: DataFrame, by: Sequence[str], date: str, member: str, weight: str, close: str, cash: float = 1_000_000.0, bps: float = 10.0) -> DataFrame:
    """by, date, equity, turnover, n_held, unfilled: at each date the portfolio is marked, then sells (by member), then buys.

    A target without a price stays unfilled and its weight stays cash; a holding without a price keeps its last mark. A target without a weight is none, it only adds its
    dates. A strategy is one group, for each date needs the one before: its rows are dates times the members that ever have a weight, not the universe; many strategies run in parallel."""
    goal = F.col(weight).cast("double")
    wanted = targets.where(goal.isNotNull() & ~F.isnan(goal)).select(*by, date, member, goal.alias("weight"))
    at = prices.select(date, member, close)
    priced = wanted.select(*by, member).distinct().join(at, member)  # what a strategy may hold, at all dates
    held = wanted.join(priced, [*by, date, member], "full").select(*by, date, member, "weight", F.col(close).cast("double").alias("close"))
    dates = targets.select(*by, date).unionByName(targets.select(*by, member).distinct().join(at, member).select(*by, date)).distinct()
    rows = held.unionByName(dates, allowMissingColumns=True)
    kinds = ", ".join(f"`{c}` {targets.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}{', ' if by else ''}`{date}` {targets.schema[date].dataType.simpleString()}, equity double, turnover double, n_held long, unfilled long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        money, shares, mark, out = cash, {}, {}, []
        for day, part in pdf.sort_values([date, member]).groupby(date):
            for m, c in zip(part[member], part["close"], strict=True):
                if c == c and c is not None:
                    mark[m] = c
            goals = {m: w for m, w in zip(part[member], part["weight"], strict=True) if w == w and w is not None}
            equity = money + sum(q * mark[m] for m, q in sorted(shares.items()))
            unfilled, traded = 0, 0.0
            if goals:
                want = {}
                for m in sorted(goals):
                    if m in mark:
                        want[m] = goals[m] * equity / mark[m]
                    else:
                        unfilled += 1
                moves = {m: want.get(m, 0.0) - shares.get(m, 0.0) for m in sorted({*want, *shares})}
                for selling in (True, False):
                    for m, q in moves.items():
                        if q and (q < 0) == selling:
                            value = abs(q) * mark[m]
                            traded += value
                            money -= q * mark[m] + value * bps / 1e4
                            shares[m] = shares.get(m, 0.0) + q
                            if abs(shares[m]) < 1e-12:
                                del shares[m]
            after = money + sum(q * mark[m] for m, q in sorted(shares.items()))
            out.append([*(pdf[c].iloc[0] for c in by), day, after, traded / equity if equity else 0.0, len(shares), unfilled])
        return pd.DataFrame(out, columns=[*by, date, "equity", "turnover", "n_held", "unfilled"])

    return rows.groupBy(*by).applyInPandas(fold, schema) if by else rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fold, schema)


#: Statistics that results may be ranked by, and whether the highest is the best.
RANKABLE = {"cumulative": True, "mean": True, "vol": False, "sharpe": True, "max_drawdown": True, "final": True, "peak": True, "mean_turnover": False, "n_periods": True}


def leaderboard(results: DataFrame, stat: str, name: str, best_first: bool | None = None) -> DataFrame:
    """results (one row a trial) with place (best first, ties by name) and, for those that are not finite, the reason instead."""
    down = RANKABLE.get(stat, True) if best_first is None else best_first
    finite = F.col(stat).isNotNull() & ~F.isnan(F.col(stat).cast("double"))
    place = F.row_number().over(Window.partitionBy("_fine").orderBy(F.desc(stat) if down else F.asc(stat), name))
    return results.withColumn("_fine", finite).withColumn("place", F.when(F.col("_fine"), place).cast("long")).withColumn("excluded", F.when(~F.col("_fine"), "not_finite")).drop("_fine")


def leaderboards(results: DataFrame, stats: Sequence[str], name: str) -> DataFrame:
    """stat, name, value, place, excluded: results ranked by several statistics at once."""
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("stat"), F.col(x).cast("double").alias("value"), F.lit(RANKABLE.get(x, True)).alias("_down")) for x in stats]))
    rows = results.select(name, cells.alias("c")).select(name, "c.*").withColumn("_fine", F.col("value").isNotNull() & ~F.isnan("value"))
    place = F.row_number().over(Window.partitionBy("stat", "_fine").orderBy(F.when(F.col("_down"), -F.col("value")).otherwise(F.col("value")), name))
    return rows.select("stat", name, "value", F.when(F.col("_fine"), place).cast("long").alias("place"), F.when(~F.col("_fine"), "not_finite").alias("excluded"))


def best_of(results: DataFrame, stat: str, name: str) -> DataFrame:
    """The result in first place."""
    return leaderboard(results, stat, name).where("place = 1")


def pins_differ(results: DataFrame, pin: str) -> DataFrame:
    """One row: pins (distinct, in order) and mismatch, whether there are several; null for no results."""
    pins = F.array_sort(F.collect_set(pin))
    return results.agg(pins.alias("pins"), F.when(F.count("*") > 0, F.size(pins) > 1).alias("mismatch"))
