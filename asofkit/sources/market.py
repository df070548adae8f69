"""Market corpora that grow: merges by content id, sessions whose availability only moves later, ticker histories, price axes, dataset versions and pins."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_business_day, market_available
from ..operators.pit import policy_join
from . import hashtree

SESSION = ("security_id", "trading_date")
TICKERS = "security_id string, ticker_history array<struct<ticker:string,exchange:string,effective_from:string,effective_to:string>>"
#: They enter the ids of axes.
AXIS_DOMAIN, EXPLICIT, BUSINESS_DAILY, SEPARATOR = "price-axis/1", "explicit", "business-daily", "\0"


def merged(stored: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """All records once each (observations, corporate actions): what is stored stays, an id that it lacks comes from the new rows (of several, the least as text)."""
    columns = stored.columns
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.select(*columns).withColumn("_new", F.lit(1)))
    row = F.struct(*columns)
    return both.groupBy(F.col(id_col).alias("_id")).agg(F.min_by(row, F.struct("_new", F.to_json(row))).alias("_r")).select("_r.*")


def merged_sessions(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """One row for each session (security_id, trading_date, available, status, policy_id), so that new evidence never makes a session known earlier.

    A session that cannot be known (no eligible status, or no time) stays so and makes one that can be known unknowable; of two known ones the later counts, of
    equal ones the stored."""
    columns = [*SESSION, "available", "status", "policy_id"]
    both = stored.select(*columns).withColumn("_stored", F.lit(1)).unionByName(derived.select(*columns).withColumn("_stored", F.lit(0)))
    known = F.coalesce(F.col("status").isin("verified", "derived"), F.lit(False)) & F.col("available").isNotNull()
    order = F.struct(~known, F.when(known, F.col("available")), "_stored", "policy_id")
    return both.groupBy(*SESSION).agg(F.max_by(F.struct("available", "status", "policy_id"), order).alias("_s")).select(*SESSION, "_s.*")


def session_availability(sessions: DataFrame, policies: Sequence[tuple]) -> DataFrame:
    """sessions (security_id, trading_date, retrieved) with available, status and policy_id by the one policy whose era [from, to) holds the trading date:
    (id, from, to or None, close, minutes after it). No policy gives unknown, several ambiguous; so does a retrieval before the close give unknown."""
    eras = [(name, date.fromisoformat(since), until and date.fromisoformat(until), ("*",)) for name, since, until, _, _ in policies]
    held = policy_join(sessions, eras, "trading_date", "security_id")
    times = [F.when(F.col("policy_id") == name, market_available(F.col("trading_date"), F.col("retrieved"), close, lag)) for name, _, _, close, lag in policies]
    made = held.withColumn("available", F.coalesce(*times, F.lit(None).cast("timestamp")))
    status = F.when((F.col("policy_status") == "derived") & F.col("available").isNull(), "unknown").otherwise(F.col("policy_status"))
    return made.withColumn("status", status).drop("policy_status")


def ticker_history(documents: DataFrame, json_col: str = "content") -> DataFrame:
    """security_id, ticker, exchange, effective_from, effective_to of instruments' documents; a row without ticker or first day is an error."""
    rows = documents.select(F.from_json(F.col(json_col).cast("string"), TICKERS).alias("d")).select("d.security_id", F.explode("d.ticker_history").alias("t"))
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"a ticker without {c.split('.')[1]}: "), F.coalesce("security_id", F.lit("")))).cast("string")).otherwise(F.col(c))
    days = [need("t.effective_from").cast("date").alias("effective_from"), F.col("t.effective_to").cast("date").alias("effective_to")]
    return rows.select("security_id", F.upper(need("t.ticker")).alias("ticker"), "t.exchange", *days).distinct()


def securities_of(asked: DataFrame, history: DataFrame) -> DataFrame:
    """asked (ticker, day, further columns) with security_id and ticker_status: resolved, unknown, or ambiguous where several securities bore the ticker on that day.

    A row of the history holds from its first day to the day before its last (null: still). A ticker has few rows, whatever is asked."""
    bearers = history.select(F.col("ticker").alias("_t"), F.col("security_id").alias("_s"), "effective_from", "effective_to")
    periods = bearers.groupBy("_t").agg(F.collect_set(F.struct("_s", "effective_from", "effective_to")).alias("_all"))
    joined = asked.join(periods, F.upper("ticker") == F.col("_t"), "left")
    holds = lambda p: (p["effective_from"] <= F.col("day")) & (p["effective_to"].isNull() | (F.col("day") < p["effective_to"]))
    found = F.array_distinct(F.transform(F.filter(F.coalesce("_all", F.array().cast("array<struct<_s:string,effective_from:date,effective_to:date>>")), holds), lambda p: p["_s"]))
    status = F.when(F.size("_found") == 1, "resolved").when(F.size("_found") == 0, "unknown").otherwise("ambiguous")
    rows = joined.withColumn("_found", found)
    return rows.select(*asked.columns, F.when(F.size("_found") == 1, F.get("_found", F.lit(0))).alias("security_id"), status.alias("ticker_status"))


# axes of prices


def axis_id(kind: str, days: Sequence[date]) -> str:
    """What names an axis: its kind and its days (explicit) or first and last day (business days)."""
    return "sha256:" + hashlib.sha256(SEPARATOR.join([AXIS_DOMAIN, kind, *[d.isoformat() for d in days]]).encode()).hexdigest()


def explicit_axis(spark: SparkSession, days: Sequence[date]) -> DataFrame:
    """trading_date and ordinal of a specification's days in order; no day, or one given twice, is an error."""
    if not days or len(set(days)) != len(days):
        raise ValueError("an axis needs days, each once")
    return spark.createDataFrame([(d, i) for i, d in enumerate(sorted(days))], "trading_date date, ordinal int")


def business_daily_axis(spark: SparkSession, first: date, last: date) -> DataFrame:
    """trading_date of all US business days from first to last, both included; bounds in the wrong order or without such a day are an error."""
    if first > last:
        raise ValueError("an axis ends before it begins")
    days = business_days_within(spark.range(1).select(F.lit(first).alias("first"), F.lit(last).alias("last")), [], "first", "last")
    if (last - first).days < 7 and days.isEmpty():
        raise ValueError("an axis without a business day")
    return days


def business_days_within(bounds: DataFrame, by: Sequence[str], first: str, last: str) -> DataFrame:
    """by and trading_date: the business days between two dates of each row, both included; none where a date is missing or they are in the wrong order."""
    ordered = bounds.where(F.col(first) <= F.col(last))
    days = ordered.select(*by, F.explode(F.sequence(F.col(first).cast("date"), F.col(last).cast("date"))).alias("trading_date"))
    return days.where(is_business_day(F.col("trading_date"))).distinct()


# sectors


def with_sector(members: DataFrame, assignments: DataFrame, scheme: str, member: str = "company_id") -> DataFrame:
    """members with sector under one scheme (assignments: scheme, company_id, sector); null: unclassified. Two sectors of one member under a scheme are an error."""
    mine = assignments.where(F.col("scheme") == scheme).groupBy(F.col("company_id").alias("_m")).agg(F.min("sector").alias("_least"), F.max("sector").alias("_most"))
    wrong = F.raise_error(F.concat(F.lit("several sectors of "), F.col("_m"))).cast("string")
    sector = F.when(F.col("_least") == F.col("_most"), F.col("_least")).when(F.col("_least").isNotNull(), wrong)
    return members.join(mine.select("_m", sector.alias("sector")), F.col(member) == F.col("_m"), "left").drop("_m")


def classification(assignments: DataFrame) -> DataFrame:
    """scheme, root, n: what names a classification: all its pairs, in a hash tree."""
    pair = F.to_json(F.array("company_id", "sector"))
    return hashtree.roots(hashtree.tree(assignments.select("scheme", pair.alias("_pair")), ["scheme"], "_pair", 2), ["scheme"])


# versions and pins


def market_leaves(observations: DataFrame, actions: DataFrame, sessions: DataFrame, transformation: str) -> DataFrame:
    """security_id and leaf: all that a security's market data is made of, each under a tag: the transformation, the policies of its sessions, its raw documents,
    observations and actions. Nulls are left out; leaves may come again, which a tree ignores."""
    tagged = lambda df, tag, c: df.where(F.col(c).isNotNull()).select("security_id", F.concat(F.lit(f"{tag}\0"), F.col(c)).alias("leaf"))
    parts = [tagged(sessions, "pol", "policy_id").distinct(), tagged(observations, "raw", "document_id"), tagged(observations, "obs", "observation_id"), tagged(actions, "act", "action_id")]
    held = observations.select("security_id").unionByName(actions.select("security_id")).distinct()
    return reduce(DataFrame.unionByName, parts, held.withColumn("leaf", F.lit(f"tv\0{transformation}")))


def market_version(observations: DataFrame, actions: DataFrame, sessions: DataFrame, transformation: str, depth: int = 2) -> DataFrame:
    """security_id, root, n: the version of each security's data. The tree of `market_leaves` may be stored and grown instead (`hashtree.grown`): same root."""
    leaves = market_leaves(observations, actions, sessions, transformation)
    return hashtree.roots(hashtree.tree(leaves, ["security_id"], "leaf", depth), ["security_id"])
