"""Filters with ledgers, set operations, universes, identifiers, amendments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import base_form, cik10, is_amendment, looks_like_cik, plain_name


def filter_chain(candidates: DataFrame, *steps: tuple[str, Column]) -> DataFrame:
    """candidates with excluded_by: the first step whose condition does not hold (null counts as not), null for members."""
    reason = F.lit(None).cast("string")
    for name, keeps in reversed(steps):
        reason = F.when(~F.coalesce(keeps, F.lit(False)), F.lit(name)).otherwise(reason)
    return candidates.withColumn("excluded_by", reason)


def split_members(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """df with is_member: a left join on distinct keys, no row is multiplied."""
    return df.join(members.select(key).distinct().withColumn("is_member", F.lit(True)), key, "left").fillna(False, ["is_member"])


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the least in the given order."""
    others = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*order, F.struct(*others).alias("row"))).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("best.row")[c].alias(c) for c in others])


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, change: added (only in right), removed or retained."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full").select(key, F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").otherwise("retained").alias("change"))


def later_evidence(a: DataFrame, b: DataFrame, key: str, time: str) -> DataFrame:
    """Merge of availabilities: the later time stays, an unknown one makes the result unknown."""
    both = a.select(key, time).unionByName(b.select(key, time))
    return both.groupBy(key).agg(F.when(F.count("*") == F.count(time), F.max(time)).alias(time))


def complete_dates(series: DataFrame, series_id: str, date: str, n_series: int) -> DataFrame:
    """Dates on which all series have a value: complete cases by a count, without joining the series."""
    return series.groupBy(date).agg(F.count_distinct(series_id).alias("n")).where(F.col("n") == n_series).select(date)


def amendment_links(filings: DataFrame) -> DataFrame:
    """Amendments with the filing they amend: same company, base form and report date.

    filings: filing_id, company_id, form, report_date, accepted. One original gives HIGH if accepted strictly earlier with both
    times known, else LOW; of several, exactly one strictly earlier gives LOW, else UNKNOWN. A window over one shuffle."""
    rows = filings.withColumn("_base", base_form(F.col("form"))).withColumn("_amends", is_amendment(F.col("form")))
    originals = rows.where("not _amends").groupBy("company_id", "_base", "report_date").agg(F.collect_list(F.struct("filing_id", "accepted")).alias("_all"))
    joined = rows.where("_amends").join(originals, ["company_id", "_base", "report_date"], "left")
    earlier = F.filter("_all", lambda o: o["accepted"] < F.col("accepted"))
    n, one = F.coalesce(F.size("_all"), F.lit(0)), F.size(earlier) == 1
    confidence = F.when(n < 1, "UNKNOWN").when((n == 1) & F.coalesce(one, F.lit(False)), "HIGH").when(n == 1, "LOW").when(one, "LOW").otherwise("UNKNOWN")
    amends = F.when(n == 1, F.col("_all")[0]["filing_id"]).when(one & (n > 1), earlier[0]["filing_id"])
    return joined.select("filing_id", "company_id", "form", "report_date", amends.alias("amends"), confidence.alias("confidence"))


def resolve_names(names: DataFrame, directory: DataFrame, name: str, key: str) -> DataFrame:
    """names with the key of their directory entry; status resolved, ambiguous or not_found."""
    entries = directory.groupBy(name).agg(F.count_distinct(key).alias("_n"), F.min(key).alias("_key"))
    joined = names.join(entries, name, "left")
    return joined.withColumn("status", F.when(F.col("_n") == 1, "resolved").when(F.col("_n") > 1, "ambiguous").otherwise("not_found")).withColumn(key, F.when(F.col("_n") == 1, F.col("_key"))).drop("_n", "_key")


def resolve_identifiers(asked: DataFrame, identifier: str, directory: DataFrame) -> DataFrame:
    """asked with cik, matched_by (cik, ticker, title) and status: a company number is taken as such, else a ticker, else a title is looked up in the
    directory (cik, ticker, title); the first that has entries decides, several companies make it ambiguous."""
    plain = plain_name(F.col(identifier))

    def entries(column: str) -> DataFrame:
        return directory.where(F.col(column).isNotNull()).groupBy(plain_name(F.col(column)).alias("_plain")).agg(F.count_distinct("cik").alias(f"_{column}_n"), F.min("cik").alias(f"_{column}"))

    joined = asked.withColumn("_plain", plain).join(entries("ticker"), "_plain", "left").join(entries("title"), "_plain", "left")
    as_cik = F.when(looks_like_cik(F.col(identifier)), cik10(F.col(identifier)))
    by = F.when(as_cik.isNotNull(), "cik").when(F.col("_ticker_n").isNotNull(), "ticker").when(F.col("_title_n").isNotNull(), "title")
    n = F.when(by == "cik", 1).when(by == "ticker", F.col("_ticker_n")).otherwise(F.col("_title_n"))
    status = F.when(by.isNull(), "not_found").when(n > 1, "ambiguous").otherwise("resolved")
    found = F.when(by == "cik", as_cik).when(by == "ticker", F.col("_ticker")).otherwise(F.col("_title"))
    return joined.select(*[joined[c] for c in asked.columns], F.when(status == "resolved", found).alias("cik"), by.alias("matched_by"), status.alias("status"))


def reconciled(facts: DataFrame, keys: Sequence[str], value: str, decimals: str, order: Sequence[str]) -> DataFrame:
    """Duplicate facts of a key: the most precise one stands for them (then the first in order); consistent says whether all
    round to its value at their own precision."""
    from ..functions.scalars import to_decimals

    w = Window.partitionBy(*keys)
    marked = facts.withColumn("_best", F.max(F.struct(F.col(decimals).alias("d"), F.struct(*[(-F.col(o)).alias(o) for o in order]).alias("o"), F.col(value).alias("v"))).over(w))
    agrees = to_decimals(F.col("_best.v"), F.col(decimals)) == to_decimals(F.col(value), F.col(decimals))
    return marked.groupBy(*keys).agg(F.max("_best.v").alias("value"), F.max("_best.d").alias("decimals"), F.count("*").alias("n_facts"), F.min(agrees).alias("consistent"))
