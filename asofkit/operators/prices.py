"""Prices as they were known: observations of (security_id, trading_date, field) with observation_id, value, currency, and sessions' availability."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pit import asof_join, eligible, frontier
from .series import adjustment_factors

KEY = ("security_id", "trading_date", "field")


def with_sessions(observations: DataFrame, sessions: DataFrame) -> DataFrame:
    """observations with available and status of their session (security_id, trading_date). Those without a record of it are left out: nothing tells when they were
    known, so a series gives not_reported there, not unavailable."""
    return observations.join(sessions.select("security_id", "trading_date", "available", "status"), ["security_id", "trading_date"])


def earliest_evidence(sessions: DataFrame) -> DataFrame:
    """One row for each session, of the earliest observation and retrieval times."""
    return sessions.groupBy("security_id", "trading_date").agg(F.min("observed").alias("observed"), F.min("retrieved").alias("retrieved"))


def price_as_of(observations: DataFrame, as_of: datetime) -> DataFrame:
    """security_id, trading_date, field, value, observation_id, reason: the latest available of each key, then the greatest id.

    Of a key without any known one, all ineligible for good give unavailable, one that becomes available later not_knowable_yet."""
    ok = eligible(F.col("available"), F.lit(as_of), F.col("status"))
    later = F.col("available").isNotNull() & F.coalesce(F.col("status").isin("verified", "derived"), F.lit(False))
    best = F.max(F.when(ok, F.struct("available", "observation_id", "value"))).alias("_best")
    found = observations.groupBy(*KEY).agg(best, F.max(later).alias("_later"))
    reason = F.when(F.col("_best").isNotNull(), None).when(F.col("_later"), "not_knowable_yet").otherwise("unavailable")
    return found.select(*KEY, F.col("_best.value").alias("value"), F.col("_best.observation_id").alias("observation_id"), reason.alias("reason"))


def price_series(observations: DataFrame, axis: DataFrame, field: str, as_of: datetime) -> DataFrame:
    """A cell for each row of an axis (security_id, trading_date); not_reported where there is no observation at all."""
    mine = price_as_of(observations.where(F.col("field") == field), as_of).drop("field").withColumn("_seen", F.lit(True))
    joined = axis.join(mine, ["security_id", "trading_date"], "left")
    return joined.withColumn("reason", F.when(F.col("_seen").isNull(), "not_reported").otherwise(F.col("reason"))).drop("_seen")


def revised_prices(observations: DataFrame, axis: DataFrame, field: str) -> DataFrame:
    return price_series(observations, axis, field, frontier(observations, "available", "status") or datetime(1970, 1, 1))


def known_actions(actions: DataFrame, as_of: datetime) -> DataFrame:
    """Corporate actions that were known as of an instant."""
    return actions.where(eligible(F.col("available"), F.lit(as_of), F.col("status")))


def mixed_currencies(rows: DataFrame) -> DataFrame:
    """security_id, n_currencies of the securities whose observations are in several."""
    return rows.groupBy("security_id").agg(F.count_distinct("currency").alias("n_currencies")).where("n_currencies > 1")


def adjusted_series(observations: DataFrame, actions: DataFrame, axis: DataFrame, field: str, as_of: datetime, dividends: bool = False) -> DataFrame:
    """price_series with adjusted: the value times the factors of all known splits (and dividends, if asked for) with a later ex-date.

    actions: security_id, kind (split, dividend), ex_date, ratio, amount, available, status. A dividend's reference is the last close known as of the instant and strictly
    before the ex-date. Undefined cells stay as they are; missing_adjustment_reference where a later action lacks its ratio or reference."""
    cells = price_series(observations, axis, field, as_of)
    known = known_actions(actions, as_of)
    splits = known.where("kind = 'split'").select("security_id", "ex_date", F.col("ratio").cast("double").alias("ratio"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("double").alias("reference"))
    if dividends:
        paid = known.where("kind = 'dividend'").select("security_id", "ex_date", F.lit(None).cast("double").alias("ratio"), F.col("amount").cast("double").alias("amount"))
        closes = price_as_of(observations.where("field = 'close'"), as_of).where("reason is null").select("security_id", "trading_date", F.col("value").cast("double").alias("reference"))
        splits = splits.unionByName(asof_join(paid, closes, ["security_id"], "ex_date", "trading_date", ["reference"], strict=True).drop("trading_date_matched"))
    made = adjustment_factors(cells, splits, "security_id", "trading_date", "ex_date", "ratio", "amount", "reference")
    reason = F.coalesce("reason", F.when(F.col("factor").isNull(), "missing_adjustment_reference"))
    return made.withColumn("adjusted", F.when(reason.isNull(), F.col("value") * F.col("factor"))).withColumn("reason", reason)
