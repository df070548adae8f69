"""Metrics, panels and factors over bitemporal facts, as of several instants in one plan.

Facts have company_id, taxonomy, concept, period_type (instant, duration), period_start, period_end, unit, currency, consolidated, value (null where it is no
number), is_nil, filing_id, accepted, is_amendment, available (UTC, null where unknown) and status."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import cell, unit_family
from ..plans.formula import Formula, evaluated
from . import panels
from .pit import eligible, frontier, vintages

#: What tells one observation from another; its versions differ in when they were available.
OBSERVATION = ("company_id", "taxonomy", "concept", "period_type", "period_start", "period_end", "unit")
#: Of versions available at one instant the later accepted one wins (unknown acceptance last), then an amendment, then the greatest filing.
TIES = ("accepted", "is_amendment", "filing_id")


def with_availability(facts: DataFrame, availability: DataFrame) -> DataFrame:
    """facts with available and status of their filing; facts of filings without a record are left out."""
    return facts.join(availability.select("filing_id", "available", "status"), "filing_id")


def known_facts(facts: DataFrame, as_ofs: Sequence[datetime]) -> DataFrame:
    """as_of and the winning version of each observation known then, with eligible_count."""
    known = facts.where(eligible(F.col("available"), F.lit(max(as_ofs)), F.col("status")))
    return vintages(known, OBSERVATION, "available", TIES, as_ofs)


def ranked_history(facts: DataFrame, as_of: datetime) -> DataFrame:
    """All versions of each observation known as of an instant, with rank 1 for the winner."""
    known = facts.where(eligible(F.col("available"), F.lit(as_of), F.col("status")))
    order = [F.desc_nulls_last(c) for c in ("available", *TIES)]
    return known.withColumn("rank", F.row_number().over(Window.partitionBy(*OBSERVATION).orderBy(*order)).cast("long"))


def all_versions(facts: DataFrame, with_unknown: bool = False) -> DataFrame:
    """Versions whatever the instant; those of unknown availability only if asked for."""
    return facts if with_unknown else facts.where(F.col("available").isNotNull() & F.col("status").isin("verified", "derived"))


def availability_counts(facts: DataFrame) -> DataFrame:
    """status, n."""
    return facts.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


# axes of periods: a specification's handful of rows


def axis(spark: SparkSession, periods: Sequence[tuple[date | None, date]]) -> DataFrame:
    """period_start, period_end, ordinal in order of end and start; a period given twice is an error."""
    ordered = sorted(periods, key=lambda p: (p[1], p[0] or date.min))
    if len(set(ordered)) != len(ordered):
        raise ValueError("a period is given twice")
    return spark.createDataFrame([(s, e, i) for i, (s, e) in enumerate(ordered)], "period_start date, period_end date, ordinal int")


def _stepped(spark: SparkSession, last_end: date, n: int, months: int, instant: bool) -> DataFrame:
    steps = spark.range(n).select((F.lit(n - 1) - F.col("id")).cast("int").alias("back"))
    last = F.lit(last_end)
    back = lambda k: F.when(last == F.last_day(last), F.last_day(F.add_months(last, -k * months))).otherwise(F.add_months(last, -k * months))
    end, before = back(F.col("back")), back(F.col("back") + 1)
    start = F.lit(None).cast("date") if instant else F.date_add(before, 1)
    return steps.select(start.alias("period_start"), end.alias("period_end"), (F.lit(n - 1) - F.col("back")).cast("int").alias("ordinal"))


def annual_axis(spark: SparkSession, last_end: date, n: int, instant: bool = False) -> DataFrame:
    """n years, the last ending on last_end; the last day of a month stays one."""
    return _stepped(spark, last_end, n, 12, instant)


def quarterly_axis(spark: SparkSession, last_end: date, n: int, instant: bool = False) -> DataFrame:
    return _stepped(spark, last_end, n, 3, instant)


# metrics


def _input_columns(formula: Formula) -> list[Column]:
    """For each input, over the facts of one company, period and instant: the best candidate, and whether there were nil, non-numeric or other units' ones."""
    out = []
    for k, i in enumerate(formula.inputs):
        mine = F.col("_input") == k
        family = F.coalesce(unit_family(F.col("unit"), F.col("currency")) == i.family, F.lit(False))
        number = ~F.col("is_nil") & F.col("value").isNotNull()
        best = F.min(F.when(mine & number & family, F.struct("_position", "unit", "filing_id", "value", "concept")))
        flag = lambda c: F.max(F.when(c, 1).otherwise(0)) == 1
        out += [best.alias(f"_best_{k}"), flag(mine & F.col("is_nil")).alias(f"_nil_{k}"), flag(mine & ~F.col("is_nil") & F.col("value").isNull()).alias(f"_text_{k}"), flag(mine & number & ~family).alias(f"_unit_{k}")]
    return out


def metric_as_of(facts: DataFrame, formula: Formula, requests: DataFrame, as_ofs: Sequence[datetime]) -> DataFrame:
    """as_of, company_id, period_start, period_end, status, value, unit, reason for all requests (company_id, period_start, period_end) and instants.

    An input takes the first of its concepts that has a known number of its unit's family; instants match by the end of the period, durations by both dates, and only
    consolidated facts count. Reasons: nil_input, non_numeric_input, unit_mismatch or missing_input of the first undefined input, then those of the formula.
    One pass over the facts (its filters reach the scan), one join with the requests, one aggregation."""
    concepts = sorted({c for i in formula.inputs for c in i.concepts})
    marks = []
    for k, i in enumerate(formula.inputs):
        fits = F.col("concept").isin(*i.concepts) & (F.col("taxonomy") == i.taxonomy) & (F.col("period_type") == i.period)
        marks.append(F.when(fits, F.struct(F.lit(k).alias("input"), F.array_position(F.array(*[F.lit(c) for c in i.concepts]), F.col("concept")).alias("position"))))
    known = known_facts(facts.where(F.col("concept").isin(*concepts) & F.col("consolidated")), as_ofs)
    tagged = known.select("as_of", "company_id", "concept", F.col("period_start").alias("_start"), F.col("period_type").alias("_kind"), "period_end", "unit", "currency", "value", "is_nil", "filing_id", F.explode(F.array_compact(F.array(*marks))).alias("_m"))
    tagged = tagged.select("*", F.col("_m.input").alias("_input"), F.col("_m.position").alias("_position")).drop("_m")
    asked = requests.select("company_id", "period_start", "period_end")
    joined = asked.join(tagged, ["company_id", "period_end"]).where((F.col("_kind") == "instant") | (F.col("_start") == F.col("period_start")))
    keys = ["as_of", "company_id", "period_start", "period_end"]
    found = joined.groupBy(*keys).agg(*_input_columns(formula)).withColumn("_found", F.lit(True))
    asked = asked.withColumn("as_of", F.explode(F.array(*[F.lit(a) for a in sorted(as_ofs)])))
    on = (asked["as_of"] == found["as_of"]) & (asked["company_id"] == found["company_id"]) & (asked["period_end"] == found["period_end"]) & asked["period_start"].eqNullSafe(found["period_start"])
    rows = asked.join(found, on, "left").select(*[asked[k] for k in keys], *[c for c in found.columns if c not in keys])
    inputs, reasons = {}, []
    for k, i in enumerate(formula.inputs):
        inputs[i.name] = F.struct(F.col(f"_best_{k}.value").cast("double").alias("value"), F.col(f"_best_{k}.unit").alias("unit"))
        yes = lambda c, k=k: F.coalesce(F.col(f"_{c}_{k}"), F.lit(False))
        reasons.append(F.when(F.col(f"_best_{k}").isNull(), F.when(yes("nil"), "nil_input").when(yes("text"), "non_numeric_input").when(yes("unit"), "unit_mismatch").otherwise("missing_input")))
    part = evaluated(formula.body, inputs)
    wrong = F.when(~F.coalesce(F.when(part.unit.isin("pure", "shares"), part.unit).otherwise("monetary") == formula.output, F.lit(False)), "unit_mismatch")
    reason = F.coalesce(*reasons, part.reason, wrong)
    done = reason.isNull()
    return rows.select(*keys, F.when(done, "KNOWN").otherwise("UNDEFINED").alias("status"), F.when(done, part.value).alias("value"), F.when(done, part.unit).alias("unit"), reason.alias("reason"))


def revised_metric(facts: DataFrame, formula: Formula, requests: DataFrame) -> DataFrame:
    """metric_as_of at the frontier of the facts: the latest availability that is known."""
    at = frontier(facts, "available", "status")
    return metric_as_of(facts, formula, requests, [at]) if at is not None else metric_as_of(facts, formula, requests, [datetime(1970, 1, 1)])


# panels


def requests_of(companies: DataFrame, periods: DataFrame) -> DataFrame:
    """company_id, period_start, period_end, ordinal: all members at all periods of an axis, which is a specification's handful of rows."""
    return companies.select("company_id").distinct().join(F.broadcast(periods), F.lit(True))


DERIVATIONS = ("growth", "average", "ttm", "level")


def derived(cells: DataFrame, order: str, kind: str, window: int = 4, reference: str = "median", axis_kind: str = "duration") -> DataFrame:
    """cells (as_of, company_id, order, value) with derived struct<status,value,reason>: growth, average balance, sum of four trailing durations, or level against the window before."""
    if kind not in DERIVATIONS:
        raise ValueError(f"no derivation {kind}")
    if kind == "ttm" and axis_kind != "duration":
        raise ValueError("trailing sums need durations")
    keys = ["as_of", "company_id"]
    if kind == "growth":
        return panels.growth(cells, keys, order, "value").withColumnRenamed("growth", "derived")
    name = {"average": "average", "ttm": "ttm", "level": "level"}[kind]
    made = panels.average_balance(cells, keys, order, "value") if kind == "average" else panels.trailing_sum(cells, keys, order, "value") if kind == "ttm" else panels.level_vs_history(cells, keys, order, "value", window, reference)
    return made.withColumn("derived", cell(F.col(name), (F.col(name).isNull(), "missing_input"))).drop(name)


def panel_as_of(facts: DataFrame, formula: Formula, companies: DataFrame, periods: DataFrame, as_of: datetime, kind: str | None = None, **options) -> DataFrame:
    """Cells of all companies at all periods of an axis, as of one instant; with derived where a derivation is asked for."""
    cells = metric_as_of(facts, formula, requests_of(companies, periods), [as_of])
    on = (cells["period_end"] == periods["period_end"]) & cells["period_start"].eqNullSafe(periods["period_start"])
    numbered = cells.join(F.broadcast(periods), on).select(*[cells[c] for c in cells.columns], "ordinal")
    return numbered if kind is None else derived(numbered, "ordinal", kind, axis_kind=formula.period, **options)


def revised_panel(facts: DataFrame, formula: Formula, companies: DataFrame, periods: DataFrame, kind: str | None = None, **options) -> DataFrame:
    return panel_as_of(facts, formula, companies, periods, frontier(facts, "available", "status") or datetime(1970, 1, 1), kind, **options)


def coverage(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, known, reasons (a map of counts): how much of a panel is known, and why not the rest."""
    counts = cells.groupBy(*by, F.coalesce("reason", F.lit("KNOWN")).alias("_r")).agg(F.count("*").alias("_n"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_r") != "KNOWN", F.struct("_r", "_n")))))
    return counts.groupBy(*by).agg(F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(F.col("_r") == "KNOWN", F.col("_n"))), F.lit(0)).alias("known"), pairs.alias("reasons"))


# factors

TRANSFORMS = ("none", "rank", "zscore", "minmax", "winsorize")


def factor_as_of(facts: DataFrame, formula: Formula, requests: DataFrame, as_ofs: Sequence[datetime], transform: str = "none", lower: float = 0.05, upper: float = 0.95) -> DataFrame:
    """metric_as_of with factor: the value, or its transform over the known members of each instant and period."""
    if transform not in TRANSFORMS:
        raise ValueError(f"no transform {transform}")
    cells = metric_as_of(facts, formula, requests, as_ofs)
    keys = ["as_of", "period_start", "period_end"]
    if transform == "none":
        return cells.withColumn("factor", F.col("value"))
    known, rest = cells.where("status = 'KNOWN'"), cells.where("status <> 'KNOWN'")
    if transform == "rank":
        made = panels.ordinal_rank(known, keys, "value", "company_id").withColumn("factor", F.col("rank").cast("double")).drop("rank")
    elif transform == "zscore":
        made = panels.zscore(known, keys, "value").withColumnRenamed("zscore", "factor")
    elif transform == "minmax":
        made = panels.minmax(known, keys, "value").withColumnRenamed("minmax", "factor")
    else:
        bounds = known.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(lower), F.lit(upper))).alias("_b")).select(*[F.col(k).alias(f"_{k}") for k in keys], "_b")
        on = (F.col("as_of") == F.col("_as_of")) & (F.col("period_end") == F.col("_period_end")) & F.col("period_start").eqNullSafe(F.col("_period_start"))
        made = known.join(bounds, on).select(*known.columns, F.least(F.greatest("value", F.col("_b")[0]), F.col("_b")[1]).alias("factor"))
    return made.unionByName(rest.withColumn("factor", F.lit(None).cast("double")))


def revised_factor(facts: DataFrame, formula: Formula, requests: DataFrame, transform: str = "none", **options) -> DataFrame:
    return factor_as_of(facts, formula, requests, [frontier(facts, "available", "status") or datetime(1970, 1, 1)], transform, **options)
