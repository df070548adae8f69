"""Universes: ordered filters with a ledger, their counts, descriptions and comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comparisons of a threshold filter.
COMPARE = {"gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}


class Stage(NamedTuple):
    """One filter: its name and, as a column over the candidates, why it excludes a row (null: it keeps it)."""

    name: str
    reason: Column


def metric_stage(name: str, value: str, reason: str, op: str, threshold: float) -> Stage:
    """Keeps known values that meet the threshold; an undefined one is excluded with its own reason."""
    meets = COMPARE[op](F.col(value), F.lit(threshold))
    return Stage(name, F.when(F.col(value).isNull(), F.concat(F.lit("undefined:"), F.coalesce(F.col(reason), F.lit("missing_input")))).when(~meets, "threshold_not_met"))


def sector_stage(name: str, sector: str, op: str, wanted: str) -> Stage:
    """Keeps a sector (eq) or all others (ne); unclassified members are excluded by either, with a reason of their own."""
    meets = COMPARE[op](F.col(sector), F.lit(wanted))
    return Stage(name, F.when(F.col(sector).isNull(), "unclassified").when(~meets, "sector_mismatch"))


def member_stage(name: str, member: str, wanted: Sequence) -> Stage:
    """Keeps an explicit list, a specification's few rows; longer lists are joined by sets.split_members."""
    return Stage(name, F.when(~F.coalesce(F.col(member).isin(*wanted), F.lit(False)), "not_a_member"))


def build(candidates: DataFrame, *stages: Stage) -> DataFrame:
    """candidates with excluded_by and excluded_reason: the first stage, in order, that excludes the row; null for members."""
    hits = [F.when(s.reason.isNotNull(), F.struct(F.lit(s.name).alias("stage"), s.reason.alias("reason"))) for s in stages]
    first = F.coalesce(*hits) if hits else F.lit(None).cast("struct<stage:string,reason:string>")
    return candidates.withColumn("_x", first).withColumn("excluded_by", F.col("_x.stage")).withColumn("excluded_reason", F.col("_x.reason")).drop("_x")


def stage_counts(built: DataFrame, *stages: Stage, by: Sequence[str] = ()) -> DataFrame:
    """by, ordinal, stage, received, kept, excluded: a row for each stage, from one aggregation."""
    at = reduce(lambda out, s: out.when(F.col("excluded_by") == s[1].name, s[0]), enumerate(stages), F.when(F.lit(False), -1)).otherwise(len(stages))
    counts = built.select(*by, at.alias("_at")).groupBy(*by).agg(*[F.count_if(F.col("_at") >= i).alias(f"_r{i}") for i in range(len(stages) + 1)])
    rows = [F.struct(F.lit(i).alias("ordinal"), F.lit(s.name).alias("stage"), F.col(f"_r{i}").alias("received"), F.col(f"_r{i + 1}").alias("kept"), (F.col(f"_r{i}") - F.col(f"_r{i + 1}")).alias("excluded")) for i, s in enumerate(stages)]
    return counts.select(*by, F.inline(F.array(*rows)))


def description(built: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, candidates, members, excluded, reasons (stage/reason and how many)."""
    key = F.concat_ws("/", "excluded_by", "excluded_reason")
    counts = built.groupBy(*by, key.alias("_k")).agg(F.count("*").alias("_n"))
    is_member = F.col("_k") == ""
    reasons = F.map_from_entries(F.array_sort(F.collect_list(F.when(~is_member, F.struct("_k", "_n")))))
    total = F.coalesce(F.sum(F.when(is_member, F.col("_n"))), F.lit(0))
    return counts.groupBy(*by).agg(F.sum("_n").alias("candidates"), total.alias("members"), (F.sum("_n") - total).alias("excluded"), reasons.alias("reasons"))


def exclusions_of(built: DataFrame, member: str, value) -> DataFrame:
    return built.where((F.col(member) == F.lit(value)) & F.col("excluded_by").isNotNull())


def compared(left: DataFrame, right: DataFrame, member: str, left_mode: str, right_mode: str) -> DataFrame:
    """member, change (added, removed, retained), mode_mismatch: the members of two built universes, the one as of an instant, say, the other revised."""
    a = left.where("excluded_by is null").select(member).distinct().withColumn("_l", F.lit(True))
    b = right.where("excluded_by is null").select(member).distinct().withColumn("_r", F.lit(True))
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").otherwise("retained")
    return a.join(b, member, "full").select(member, change.alias("change"), F.lit(left_mode != right_mode).alias("mode_mismatch"))


def ordered_difference(left: DataFrame, right: DataFrame, member: str, order: str) -> DataFrame:
    """member, change, ordinal: retained and removed members in the order of the left, added ones in that of the right."""
    a, b = (x.groupBy(member).agg(F.min(order).alias(c)) for x, c in ((left, "_l"), (right, "_r")))
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").otherwise("retained")
    return a.join(b, member, "full").select(member, change.alias("change"), F.coalesce("_l", "_r").alias("ordinal"))


def securities_of(companies: DataFrame, securities: DataFrame, strict: bool = False) -> DataFrame:
    """company_id, security_id, status: one security gives it, none or several give null (NO_SECURITY, AMBIGUOUS); strict makes several an error."""
    n = securities.groupBy("company_id").agg(F.count_distinct("security_id").alias("_n"), F.min("security_id").alias("_id"))
    found = companies.join(n, "company_id", "left")
    status = F.when(F.col("_n").isNull(), "NO_SECURITY").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("KNOWN")
    if strict:
        status = F.when(F.coalesce(F.col("_n"), F.lit(0)) > 1, F.raise_error(F.concat(F.lit("several securities: "), "company_id")).cast("string")).otherwise(status)
    return found.select(*[found[c] for c in companies.columns], F.when(F.col("_n") == 1, F.col("_id")).alias("security_id"), status.alias("status"))
