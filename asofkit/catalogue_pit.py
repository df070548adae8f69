"""Queries of point-in-time metrics, panels, universes, prices, calendars and registries, each with its SQL.

Orders are facts of twenty companies, with versions, units, nils and texts that follow from their keys; line items are prices of suppliers."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalogue import DATES, _quantised, _yearly_weights, query, segment_returns, sq, table
from .functions import scalars as s
from .operators import backtest, metrics, prices, research, series, sets, universe
from .plans.formula import BUILTIN, Formula
from .sources import registry, store

AS_OFS = [datetime(1996, 7, 1), datetime(1998, 3, 1)]
LAST = date(1997, 12, 31)
DATES |= {
    "metric_quick_ratio": "period_end", "metric_net_margin": "period_start period_end", "revised_working_capital": "period_end", "panel_derived": "period_end", "panel_matrix": "period_end", "factor_zscore": "period_end", "factor_winsorized": "period_end",
    "ranked_versions": "period_end", "price_known": "trading_date", "price_series_cells": "trading_date", "prices_adjusted": "trading_date", "month_end_sessions": "day", "axes_of_periods": "period_start period_end",
}

_FACTS = """
keyed as (select *, (o_orderkey * 7919) % 101 as z, (o_orderkey * 104729) % 97 as y, date_trunc('quarter', o_orderdate)::date as q from orders),
facts as (
  select 'co' || lpad((o_custkey % 20)::varchar, 2, '0') as company_id, 'us-gaap' as taxonomy, k.concept, k.kind as period_type, case when k.kind = 'duration' then q end as period_start, (q + interval 3 month - interval 1 day)::date as period_end,
    case when z % 13 = 0 then 'shares' else 'USD' end as unit, z % 17 <> 0 as consolidated, y % 19 = 0 as is_nil, case when y % 19 = 0 or y % 23 = 0 then null else o_totalprice * k.factor end as value,
    'f' || o_orderkey as filing_id, case when z % 29 <> 0 then o_orderdate end as accepted, o_orderpriority = '1-URGENT' as is_amendment, case when z <> 7 then o_orderdate + to_days(z::int) end as available, case when z = 7 then 'unknown' when z % 2 = 0 then 'verified' else 'derived' end as status
  from keyed join (values (0, 'AssetsCurrent', 'instant', 1.0::double), (1, 'AssetsCurrent', 'instant', 1.0), (2, 'LiabilitiesCurrent', 'instant', 1.0), (3, 'InventoryNet', 'instant', 0.5), (4, 'InventoryFinishedGoodsNetOfReserves', 'instant', 0.25),
    (10, 'Revenues', 'duration', 1.0), (11, 'RevenueFromContractWithCustomerExcludingAssessedTax', 'duration', 1.5), (12, 'NetIncomeLoss', 'duration', 0.1), (13, 'NetIncomeLoss', 'duration', -0.1)) k(n, concept, kind, factor) on k.n = z % 5 or k.n = 10 + y % 4)"""
_CONCEPTS = [
    (0, "AssetsCurrent", "instant", 1.0), (1, "AssetsCurrent", "instant", 1.0), (2, "LiabilitiesCurrent", "instant", 1.0), (3, "InventoryNet", "instant", 0.5), (4, "InventoryFinishedGoodsNetOfReserves", "instant", 0.25),
    (10, "Revenues", "duration", 1.0), (11, "RevenueFromContractWithCustomerExcludingAssessedTax", "duration", 1.5), (12, "NetIncomeLoss", "duration", 0.1), (13, "NetIncomeLoss", "duration", -0.1),
]


def facts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("z", (F.col("o_orderkey") * 7919) % 101).withColumn("y", (F.col("o_orderkey") * 104729) % 97).withColumn("q", F.trunc(F.col("o_orderdate").cast("date"), "quarter"))
    concept = lambda n: F.coalesce(*[F.when(n == k, F.struct(F.lit(c).alias("concept"), F.lit(p).alias("kind"), F.lit(f).alias("factor"))) for k, c, p, f in _CONCEPTS])
    rows = o.withColumn("k", F.explode(F.array(concept(F.col("z") % 5), concept(F.col("y") % 4 + 10))))
    z, y, unit = F.col("z"), F.col("y"), F.when(F.col("z") % 13 == 0, "shares").otherwise("USD")
    return rows.select(
        F.concat(F.lit("co"), F.lpad((F.col("o_custkey") % 20).cast("string"), 2, "0")).alias("company_id"), F.lit("us-gaap").alias("taxonomy"), "k.concept", F.col("k.kind").alias("period_type"), F.when(F.col("k.kind") == "duration", F.col("q")).alias("period_start"),
        F.date_sub(F.add_months("q", 3), 1).alias("period_end"), unit.alias("unit"), F.when(unit == "USD", "USD").alias("currency"), (z % 17 != 0).alias("consolidated"), (y % 19 == 0).alias("is_nil"), F.when((y % 19 != 0) & (y % 23 != 0), F.col("o_totalprice") * F.col("k.factor")).alias("value"),
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("filing_id"), F.when(z % 29 != 0, F.col("o_orderdate")).alias("accepted"), (F.col("o_orderpriority") == "1-URGENT").alias("is_amendment"),
        F.when(z != 7, F.col("o_orderdate") + F.make_interval(days=z.cast("int"))).alias("available"), F.when(z == 7, "unknown").when(z % 2 == 0, "verified").otherwise("derived").alias("status"),
    )


def _axis(spark: SparkSession, formula: Formula, n: int = 8) -> DataFrame:
    return metrics.quarterly_axis(spark, LAST, n, instant=formula.period == "instant")


def _requests(spark: SparkSession, d: str, formula: Formula) -> DataFrame:
    return metrics.requests_of(facts(spark, d).select("company_id"), _axis(spark, formula))


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))


def _metric_sql(formula: Formula, as_ofs: str, body: str, unit: str) -> str:
    """cells: as_of, company_id, period_start, period_end, status, value, unit, reason."""
    inputs = ", ".join(f"({k}, '{c}', {p}, '{i.period}')" for k, i in enumerate(formula.inputs) for p, c in enumerate(i.concepts))
    start = "null::date" if formula.period == "instant" else "(date '1998-01-01' - to_months(3 * (k + 1)))::date"
    reasons = " ".join(f"when v{k} is null then case when nil{k} then 'nil_input' when text{k} then 'non_numeric_input' when unit{k} then 'unit_mismatch' else 'missing_input' end" for k in range(len(formula.inputs)))
    zero = f"when v{[i.name for i in formula.inputs].index(formula.body.right.name)} = 0 then 'divide_by_zero'" if formula.body.op == "/" else ""
    picks = ", ".join(f"max(v) filter (where inp = {k}) as v{k}, coalesce(bool_or(nil) filter (where inp = {k}), false) as nil{k}, coalesce(bool_or(txt) filter (where inp = {k}), false) as text{k}, coalesce(bool_or(other) filter (where inp = {k}), false) as unit{k}" for k in range(len(formula.inputs)))
    return f"""{_FACTS}, asofs as ({as_ofs}), inputs(inp, concept, pos, kind) as (values {inputs}),
known as (select * from (select f.*, a.as_of, row_number() over (partition by a.as_of, company_id, concept, period_type, period_start, period_end, unit order by available desc, accepted desc nulls last, is_amendment desc, filing_id desc) as rn from facts f join asofs a on f.available <= a.as_of where status in ('verified', 'derived') and consolidated) where rn = 1),
requests as (select as_of, company_id, {start} as period_start, (date '1998-01-01' - to_months(3 * k) - interval 1 day)::date as period_end, 7 - k as ordinal from (select distinct company_id from facts), (select unnest(range(8))::int as k), asofs),
tried as (select r.as_of, r.company_id, r.period_start, r.period_end, i.inp, arg_min(k.value, {{'a': i.pos, 'b': k.unit, 'c': k.filing_id}}) filter (where not k.is_nil and k.value is not null and k.unit = 'USD') as v, coalesce(bool_or(k.is_nil), false) as nil, coalesce(bool_or(not k.is_nil and k.value is null), false) as txt, coalesce(bool_or(not k.is_nil and k.value is not null and k.unit <> 'USD'), false) as other
  from requests r cross join inputs i left join known k on k.as_of = r.as_of and k.company_id = r.company_id and k.concept = i.concept and k.period_type = i.kind and k.period_end = r.period_end and (i.kind = 'instant' or k.period_start = r.period_start) group by all),
wide as (select as_of, company_id, period_start, period_end, {picks} from tried group by all),
cells as (select *, case when reason is null then 'KNOWN' else 'UNDEFINED' end as status, case when reason is null then {body} end as value, case when reason is null then '{unit}' end as unit from (select *, case {reasons} {zero} end as reason from wide))"""


_TWO = "select unnest([timestamp '1996-07-01', timestamp '1998-03-01']) as as_of"
_ONE = "select timestamp '1998-03-01' as as_of"
_FRONT = "select max(available) as as_of from facts where status in ('verified', 'derived')"
_QUICK = _metric_sql(BUILTIN["quick_ratio"], _TWO, "(v0 - v1) / nullif(v2, 0)", "pure")
_CURRENT = _metric_sql(BUILTIN["current_ratio"], _TWO, "v0 / nullif(v1, 0)", "pure")
_MARGIN = _metric_sql(BUILTIN["net_margin"], _ONE, "v0 / nullif(v1, 0)", "pure")
_CAPITAL = _metric_sql(BUILTIN["working_capital"], _FRONT, "v0 - v1", "USD")
_CAPITAL_NOW = _metric_sql(BUILTIN["working_capital"], _ONE, "v0 - v1", "USD")
_STAMP = "strftime(as_of, '%Y-%m-%d') as as_of"


@query(f"with {_QUICK} select {_STAMP}, company_id, period_end, status, {sq('value')} as value, unit, reason from cells")
def metric_quick_ratio(spark: SparkSession, d: str) -> DataFrame:
    f = BUILTIN["quick_ratio"]
    return _quantised(_stamped(metrics.metric_as_of(facts(spark, d), f, _requests(spark, d, f), AS_OFS)), "value").drop("period_start")


@query(f"with {_MARGIN} select {_STAMP}, company_id, period_start, period_end, status, {sq('value')} as value, unit, reason from cells")
def metric_net_margin(spark: SparkSession, d: str) -> DataFrame:
    f = BUILTIN["net_margin"]
    return _quantised(_stamped(metrics.metric_as_of(facts(spark, d), f, _requests(spark, d, f), AS_OFS[1:])), "value")


@query(f"with {_CAPITAL} select {_STAMP}, company_id, period_end, status, {sq('value')} as value, unit, reason from cells")
def revised_working_capital(spark: SparkSession, d: str) -> DataFrame:
    f = BUILTIN["working_capital"]
    return _quantised(_stamped(metrics.revised_metric(facts(spark, d), f, _requests(spark, d, f))), "value").drop("period_start")


_BY_COMPANY = "(partition by company_id order by period_end)"


@query(f"""with {_CAPITAL_NOW}, p as (select *, lag(value) over {_BY_COMPANY} as prev, row_number() over {_BY_COMPANY} as rn, median(value) over (partition by company_id order by period_end rows between 4 preceding and 1 preceding) as base from cells)
select company_id, period_end, {sq('value')} as value, {sq('(value - prev) / nullif(prev, 0)')} as growth, case when value is null or prev is null then 'missing_input' when prev = 0 then 'divide_by_zero' end as growth_reason, {sq('(value + prev) / 2')} as average, case when rn > 4 then {sq('value - base')} end as level from p""")
def panel_derived(spark: SparkSession, d: str) -> DataFrame:
    f, held = BUILTIN["working_capital"], facts(spark, d)
    keys = ["company_id", "period_end"]
    made = {k: metrics.panel_as_of(held, f, held.select("company_id"), _axis(spark, f), AS_OFS[1], k) for k in ("growth", "average", "level")}
    out = made["growth"].select(*keys, "value", F.col("derived.value").alias("growth"), F.col("derived.reason").alias("growth_reason"))
    for k in ("average", "level"):
        out = out.join(made[k].select(*keys, F.col("derived.value").alias(k)), keys)
    return _quantised(out, "value", "growth", "average", "level")


@query(f"""with {_CAPITAL_NOW} select company_id, period_end, ordinal, status, reason, row_number() over (order by period_end, company_id) as cell from cells join (select distinct period_end as pe, ordinal from requests) on pe = period_end""")
def panel_matrix(spark: SparkSession, d: str) -> DataFrame:
    f, held = BUILTIN["working_capital"], facts(spark, d)
    cells = metrics.panel_as_of(held, f, held.select("company_id"), _axis(spark, f), AS_OFS[1])
    n = held.select("company_id").distinct().agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("period_end").orderBy("company_id"))
    return cells.join(F.broadcast(n), F.lit(True)).select("company_id", "period_end", F.col("ordinal").cast("long").alias("ordinal"), "status", "reason", (F.col("ordinal") * F.col("n") + place).alias("cell"))


@query(f"with {_QUICK}, c as (select {_STAMP}, coalesce(reason, 'KNOWN') as reason, count(*) as n from cells group by all) select as_of, sum(n)::bigint as n, coalesce(sum(n) filter (where reason = 'KNOWN'), 0)::bigint as known, coalesce(max(n) filter (where reason = 'missing_input'), 0)::bigint as missing from c group by 1")
def panel_coverage(spark: SparkSession, d: str) -> DataFrame:
    f = BUILTIN["quick_ratio"]
    c = metrics.coverage(_stamped(metrics.metric_as_of(facts(spark, d), f, _requests(spark, d, f), AS_OFS)), ["as_of"])
    return c.select("as_of", "n", "known", F.coalesce(F.col("reasons")["missing_input"], F.lit(0)).alias("missing"))


@query(f"with {_CURRENT}, k as (select *, avg(value) over w as m, stddev_pop(value) over w as sd, max(value) over w > min(value) over w as spread from cells window w as (partition by as_of, period_end)) select {_STAMP}, company_id, period_end, status, {sq('case when spread then (value - m) / sd end')} as factor from k")
def factor_zscore(spark: SparkSession, d: str) -> DataFrame:
    f = BUILTIN["current_ratio"]
    made = metrics.factor_as_of(facts(spark, d), f, _requests(spark, d, f), AS_OFS, "zscore")
    return _quantised(_stamped(made), "factor").select("as_of", "company_id", "period_end", "status", "factor")


@query(f"with {_CURRENT}, b as (select as_of, period_end, quantile_cont(value, 0.1) as lo, quantile_cont(value, 0.9) as hi from cells where value is not null group by all) select strftime(c.as_of, '%Y-%m-%d') as as_of, company_id, c.period_end, {sq('case when value is not null then least(greatest(value, lo), hi) end')} as factor from cells c left join b on b.as_of = c.as_of and b.period_end = c.period_end")
def factor_winsorized(spark: SparkSession, d: str) -> DataFrame:
    f = BUILTIN["current_ratio"]
    made = metrics.factor_as_of(facts(spark, d), f, _requests(spark, d, f), AS_OFS, "winsorize", lower=0.1, upper=0.9)
    return _quantised(_stamped(made), "factor").select("as_of", "company_id", "period_end", "factor")


@query(f"""with {_FACTS} select company_id, concept, period_end, unit, filing_id, row_number() over (partition by company_id, concept, period_type, period_start, period_end, unit order by available desc, accepted desc nulls last, is_amendment desc, filing_id desc) as rank from facts where available <= timestamp '1996-07-01' and status in ('verified', 'derived') and period_type = 'instant'""")
def ranked_versions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ranked_history(facts(spark, d).where("period_type = 'instant'"), AS_OFS[0]).select("company_id", "concept", "period_end", "unit", "filing_id", "rank")


@query(f"with {_FACTS} select status, count(*) as n from facts group by 1")
def availability_status(spark: SparkSession, d: str) -> DataFrame:
    return metrics.availability_counts(facts(spark, d))


# universes

_SECTORS = "case substr(company_id, 3)::int % 6 when 0 then 'AFRICA' when 1 then 'ASIA' when 2 then 'EUROPE' when 3 then 'ASIA' when 4 then 'AMERICA' end"
_UNIVERSE = f"""{_CURRENT}, u as (select as_of, company_id, value, reason, {_SECTORS} as sector from cells where period_end = date '1996-03-31'),
built as (select *, case when value is null then 'liquid' when not value > 0.5 then 'liquid' when sector is null then 'sector' when sector = 'ASIA' then 'sector' end as excluded_by,
  case when value is null then 'undefined:' || reason when not value > 0.5 then 'threshold_not_met' when sector is null then 'unclassified' when sector = 'ASIA' then 'sector_mismatch' end as excluded_reason from u)"""


def _stages() -> list[universe.Stage]:
    return [universe.metric_stage("liquid", "value", "reason", "gt", 0.5), universe.sector_stage("sector", "sector", "ne", "ASIA")]


def _universe(spark: SparkSession, d: str) -> DataFrame:
    f = BUILTIN["current_ratio"]
    asked = facts(spark, d).select("company_id").distinct().select("company_id", F.lit(None).cast("date").alias("period_start"), F.lit("1996-03-31").cast("date").alias("period_end"))
    cells = metrics.metric_as_of(facts(spark, d), f, asked, AS_OFS)
    sectors = F.create_map(*[F.lit(x) for x in (0, "AFRICA", 1, "ASIA", 2, "EUROPE", 3, "ASIA", 4, "AMERICA")])
    return universe.build(_stamped(cells).withColumn("sector", sectors[F.substr("company_id", F.lit(3)).cast("int") % 6]), *_stages())


@query(f"with {_UNIVERSE} select {_STAMP}, company_id, {sq('value')} as value, sector, excluded_by, excluded_reason from built")
def universe_as_of(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(_universe(spark, d), "value").select("as_of", "company_id", "value", "sector", "excluded_by", "excluded_reason")


@query(f"""with {_UNIVERSE} select {_STAMP}, 0 as ordinal, 'liquid' as stage, count(*) as received, count(*) filter (where excluded_by is distinct from 'liquid') as kept, count(*) filter (where excluded_by = 'liquid') as excluded from built group by as_of
union all select {_STAMP}, 1, 'sector', count(*) filter (where excluded_by is distinct from 'liquid'), count(*) filter (where excluded_by is null), count(*) filter (where excluded_by = 'sector') from built group by as_of""")
def universe_stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return universe.stage_counts(_universe(spark, d), *_stages(), by=["as_of"])


@query(f"with {_UNIVERSE} select {_STAMP}, count(*) as candidates, count(*) filter (where excluded_by is null) as members, count(*) filter (where excluded_by is not null) as excluded, count(*) filter (where excluded_reason = 'unclassified') as unclassified from built group by as_of")
def universe_description(spark: SparkSession, d: str) -> DataFrame:
    m = universe.description(_universe(spark, d), ["as_of"])
    return m.select("as_of", "candidates", "members", "excluded", F.coalesce(F.col("reasons")["sector/unclassified"], F.lit(0)).alias("unclassified"))


@query(f"""with {_UNIVERSE}, a as (select company_id from built where as_of = timestamp '1996-07-01' and excluded_by is null), b as (select company_id from built where as_of = timestamp '1998-03-01' and excluded_by is null)
select coalesce(a.company_id, b.company_id) as company_id, case when a.company_id is null then 'added' when b.company_id is null then 'removed' else 'retained' end as change, true as mode_mismatch from a full join b on a.company_id = b.company_id""")
def universe_compared(spark: SparkSession, d: str) -> DataFrame:
    u = _universe(spark, d)
    return universe.compared(u.where("as_of = '1996-07-01'"), u.where("as_of = '1998-03-01'"), "company_id", "as_of", "revised")


@query("""
with s as (select 'co' || (s_suppkey % 40) as company_id, s_suppkey as security_id from supplier where s_suppkey % 3 <> 0), c as (select distinct 'co' || (s_suppkey % 40) as company_id from supplier), n as (select company_id, count(distinct security_id) as n, min(security_id) as one from s group by 1)
select c.company_id, case when n = 1 then one end as security_id, case when n is null then 'NO_SECURITY' when n > 1 then 'AMBIGUOUS' else 'KNOWN' end as status from c left join n using (company_id)""")
def company_security_map(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.concat(F.lit("co"), (F.col("s_suppkey") % 40).cast("string")).alias("company_id"), F.col("s_suppkey").alias("security_id"))
    return universe.securities_of(rows.select("company_id").distinct(), rows.where("security_id % 3 <> 0"))


# prices

_OBS = """obs as (select l_suppkey as security_id, l_shipdate::date as trading_date, 'close' as field, l_extendedprice / l_quantity as value, l_orderkey || '-' || l_linenumber as observation_id, case when l_orderkey % 5 = 0 then 'EUR' else 'USD' end as currency,
  case when l_orderkey % 11 <> 0 then l_shipdate + to_days((l_partkey % 4)::int) end as available, case when l_orderkey % 11 <> 0 then 'derived' else 'unknown' end as status from lineitem),
best as (select security_id, trading_date, field, arg_max(value, {'a': available, 'o': observation_id}) filter (where available <= timestamp '1996-11-01' and status = 'derived') as value, max({'a': available, 'o': observation_id}) filter (where available <= timestamp '1996-11-01' and status = 'derived') as won, bool_or(status = 'derived') as later from obs group by all),
known as (select security_id, trading_date, field, value, won.o as observation_id, case when won is not null then null when later then 'not_knowable_yet' else 'unavailable' end as reason from best)"""
_PRICED = datetime(1996, 11, 1)
_DAYS = ("1996-03-15", "1996-06-14", "1996-08-30", "1996-09-30", "1996-10-31", "1996-12-02")


def observations(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    fine = F.col("l_orderkey") % 11 != 0
    return l.select(
        F.col("l_suppkey").alias("security_id"), F.col("l_shipdate").cast("date").alias("trading_date"), F.lit("close").alias("field"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("value"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("observation_id"),
        F.when(F.col("l_orderkey") % 5 == 0, "EUR").otherwise("USD").alias("currency"), F.when(fine, F.col("l_shipdate") + F.make_interval(days=(F.col("l_partkey") % 4).cast("int"))).alias("available"), F.when(fine, "derived").otherwise("unknown").alias("status"),
    )


@query(f"with {_OBS} select security_id, trading_date, {sq('value')} as value, observation_id, reason from known")
def price_known(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(prices.price_as_of(observations(spark, d), _PRICED), "value").drop("field")


_CELLS = f"""{_OBS}, axis as (select s_suppkey as security_id, day::date as trading_date from supplier, (select unnest([{", ".join(f"date '{x}'" for x in _DAYS)}]) as day)),
cells as (select a.security_id, a.trading_date, value, case when k.security_id is null then 'not_reported' else reason end as reason from axis a left join known k on k.security_id = a.security_id and k.trading_date = a.trading_date)"""


def _price_axis(spark: SparkSession, d: str) -> DataFrame:
    days = F.array(*[F.lit(x).cast("date") for x in _DAYS])
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("security_id"), F.explode(days).alias("trading_date"))


@query(f"with {_CELLS} select security_id, trading_date, {sq('value')} as value, reason from cells")
def price_series_cells(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(prices.price_series(observations(spark, d), _price_axis(spark, d), "close", _PRICED), "value").drop("observation_id")


_ACTIONS = [("split", "1996-06-03", 2.0, None, "1996-05-01", 1), ("dividend", "1996-09-02", None, 7.5, "1996-08-01", 1), ("split", "1996-10-01", 0.0, None, "1996-09-15", 7), ("split", "1996-10-15", 3.0, None, "1997-06-01", 1), ("dividend", "1992-01-01", None, 5.0, "1991-12-01", 1)]


@query(f"""with {_CELLS}, actions as (select s_suppkey as security_id, a.* from supplier, (values {", ".join(f"('{k}', date '{x}', {r or 'null' if r is None else r}::double, {m or 'null'}::double, timestamp '{a}', {n})" for k, x, r, m, a, n in _ACTIONS)}) a(kind, ex, ratio, amount, available, every) where s_suppkey % every = 0 and available <= timestamp '1996-11-01'),
f as (select *, case when kind = 'split' then case when ratio > 0 then 1 / ratio end else 1 - amount / (select arg_max(value, trading_date) from known k where k.security_id = actions.security_id and k.reason is null and k.trading_date < ex) end as f from actions),
g as (select c.*, coalesce(bool_or(f.ex is not null and f.f is null), false) as bad, product(f.f) as p from cells c left join f on f.security_id = c.security_id and f.ex > c.trading_date group by c.security_id, c.trading_date, c.value, c.reason)
select security_id, trading_date, {sq("case when reason is null and not bad then value * coalesce(p, 1) end")} as adjusted, coalesce(reason, case when bad then 'missing_adjustment_reference' end) as reason from g""")
def prices_adjusted(spark: SparkSession, d: str) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("kind"), F.lit(x).cast("date").alias("ex_date"), F.lit(r).cast("double").alias("ratio"), F.lit(m).cast("double").alias("amount"), F.lit(a).cast("timestamp_ntz").alias("available"), F.lit(n).alias("every")) for k, x, r, m, a, n in _ACTIONS]
    actions = table(spark, d, "supplier").select(F.col("s_suppkey").alias("security_id"), F.inline(F.array(*rows))).where("security_id % every = 0").withColumn("status", F.lit("derived"))
    made = prices.adjusted_series(observations(spark, d), actions, _price_axis(spark, d), "close", _PRICED, dividends=True)
    return _quantised(made, "adjusted").select("security_id", "trading_date", "adjusted", "reason")


@query(f"with {_OBS} select security_id, count(distinct currency) as n_currencies from obs group by 1 having count(distinct currency) > 1")
def currency_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return prices.mixed_currencies(observations(spark, d))


# calendars


def _holidays(first: int, last: int) -> list[date]:
    """The holidays of each year, from the public rules."""
    out = []
    for y in range(first, last + 1):
        nth = lambda m, weekday, n: date(y, m, 1) + timedelta((weekday - date(y, m, 1).weekday()) % 7 + 7 * (n - 1))  # noqa: B023, E731
        may = date(y, 5, 31)
        fixed = [date(y, 1, 1), date(y, 7, 4), date(y, 11, 11), date(y, 12, 25), *([date(y, 6, 19)] if y >= 2021 else [])]
        moved = [x - timedelta(1) if x.weekday() == 5 else x + timedelta(1) if x.weekday() == 6 else x for x in fixed]
        out += [*[x for x in moved if x.year == y], nth(1, 0, 3), nth(2, 0, 3), may - timedelta(may.weekday()), nth(9, 0, 1), nth(10, 0, 2), nth(11, 3, 4)]
    return sorted(out)


_CALENDAR = f"""holidays(h) as (values {", ".join(f"(date '{x}')" for x in _holidays(1991, 2003))}), business as (select day::date as day from generate_series(date '1991-01-01', date '2003-12-31', interval 1 day) t(day) where isodow(day) < 6 and day::date not in (select h from holidays))"""
_UTC = "at time zone 'America/New_York' at time zone 'UTC'"


@query(f"""with {_CALENDAR}, f as (select o_orderkey, case when o_orderkey % 31 <> 0 then o_orderdate + to_hours((o_orderkey % 48)::int) end as accepted, case when o_orderkey % 37 <> 0 then o_orderdate + to_hours((o_orderkey % 200)::int) end as retrieved from orders),
l as (select *, (accepted at time zone 'UTC' at time zone 'America/New_York') as local from f),
c as (select *, case when exists (select 1 from business where day = local::date) and local <= local::date + interval '17 hours 30 minutes' then local::date else (select min(day) from business where day > local::date) end as on_day from l),
o as (select *, greatest((on_day + interval '17 hours 30 minutes') {_UTC}, accepted) as out from c)
select o_orderkey, strftime(case when accepted is null or coalesce(accepted > retrieved, false) then null when retrieved is null then out else least(out, retrieved) end, '%Y-%m-%d %H:%M:%S') as available from o""")
def filing_publication(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    accepted, retrieved = F.when(k % 31 != 0, at + F.make_interval(hours=(k % 48).cast("int"))), F.when(k % 37 != 0, at + F.make_interval(hours=(k % 200).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(s.filing_available(accepted, retrieved), "yyyy-MM-dd HH:mm:ss").alias("available"))


@query(f"""with s as (select o_orderkey, o_orderdate::date as day, o_orderdate + to_hours((o_orderkey % 60)::int) as retrieved from orders), c as (select *, (day + interval 16 hour) {_UTC} as closed from s)
select o_orderkey, strftime(case when retrieved < closed then null else least(closed + interval 240 minute, retrieved) end, '%Y-%m-%d %H:%M:%S') as available from c""")
def session_publication(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    made = s.market_available(F.col("o_orderdate").cast("date"), at + F.make_interval(hours=(k % 60).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(made, "yyyy-MM-dd HH:mm:ss").alias("available"))


@query(f"with {_CALENDAR} select distinct o_orderdate::date as day, o_orderdate::date in (select day from business) as is_business_day from orders")
def business_day_calendar(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.withColumn("is_business_day", s.is_business_day(F.col("day")))


@query(f"""
with {_CALENDAR}, bounds as (select o_orderpriority, min(o_orderdate::date) as first, max(o_orderdate::date) as last from orders where o_orderkey % 7 = 3 group by o_orderpriority)
select o_orderpriority, max(day) as day from bounds join business on day between first and last group by o_orderpriority, date_trunc('month', day)""")
def month_end_sessions(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    bounds = table(spark, d, "orders").where("o_orderkey % 7 = 3").groupBy("o_orderpriority").agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return s.month_ends_within(bounds, ["o_orderpriority"], "first", "last")


@query("""
with l as (select (last_day(max(o_orderdate)::date) + 1)::date as next from orders),
k as (select next, unnest(range(6))::int as k from l)
select 'annual' as axis, (next - to_years(k + 1))::date as period_start, (next - to_years(k) - interval 1 day)::date as period_end, (3 - k)::bigint as ordinal from k where k < 4
union all select 'quarterly', (next - to_months(3 * k + 3))::date, (next - to_months(3 * k) - interval 1 day)::date, (5 - k)::bigint from k""")
def axes_of_periods(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").agg(F.last_day(F.max(F.col("o_orderdate").cast("date")))).first()[0]  # one date
    a = metrics.annual_axis(spark, last, 4).withColumn("axis", F.lit("annual"))
    both = a.unionByName(metrics.quarterly_axis(spark, last, 6).withColumn("axis", F.lit("quarterly")))
    return both.select("axis", "period_start", "period_end", F.col("ordinal").cast("long").alias("ordinal"))


# registries, identifiers, units


@query("""
with f as (select 'f' || (o_orderkey % 500) as filing_id, 'cik:' || (o_orderkey % 500 % 50) as company_id, case when o_orderkey % 500 % 4 = 0 then ' 10-k/a' else '10-K' end as form, date '1997-01-01' + (o_orderkey % 500 % 90)::int as filing_date, date '1996-12-31' as report_date, timestamp '1997-01-01' + to_days((o_orderkey % 500 % 90)::int) as accepted from orders),
m as (select distinct * from f), o as (select * from m where upper(trim(form)) = '10-K'),
j as (select a.filing_id, count(o.filing_id) as n, count(o.filing_id) filter (where o.accepted < a.accepted) as e, min(o.filing_id) as one, min(o.filing_id) filter (where o.accepted < a.accepted) as earlier from m a left join o on o.company_id = a.company_id where upper(trim(a.form)) = '10-K/A' group by 1)
select m.filing_id, company_id, form, case when n = 1 then one when n > 1 and e = 1 then earlier end as amends, case when j.filing_id is null then null when n < 1 then 'UNKNOWN' when n = 1 and e = 1 then 'HIGH' when n = 1 then 'LOW' when e = 1 then 'LOW' else 'UNKNOWN' end as confidence from m left join j using (filing_id)""")
def registry_built(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 500
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("f"), k.cast("string")).alias("filing_id"), F.concat(F.lit("cik:"), (k % 50).cast("string")).alias("company_id"), F.when(k % 4 == 0, " 10-k/a").otherwise("10-K").alias("form"), F.date_add(F.lit("1997-01-01").cast("date"), (k % 90).cast("int")).alias("filing_date"),
        F.lit("1996-12-31").cast("date").alias("report_date"), (F.lit("1997-01-01").cast("timestamp_ntz") + F.make_interval(days=(k % 90).cast("int"))).alias("accepted"),
    )
    return registry.built(rows).select("filing_id", "company_id", "form", "amends", "confidence")


@query("""
with dir as (select lpad(c_custkey::varchar, 10, '0') as cik, 'T' || (c_custkey % 120) as ticker, c_name as title from customer),
asked as (select c_custkey, case c_custkey % 4 when 0 then 'cik' || c_custkey when 1 then ' t' || (c_custkey % 160) || ' ' when 2 then lower(c_name) else 'nobody ' || c_custkey end as ident from customer),
t as (select ticker as p, count(distinct cik) as n, min(cik) as one from dir group by 1), l as (select upper(title) as p, count(distinct cik) as n, min(cik) as one from dir group by 1)
select c_custkey, case when c_custkey % 4 = 0 then lpad(c_custkey::varchar, 10, '0') when t.n = 1 then t.one when t.n is null and l.n = 1 then l.one end as cik, case when c_custkey % 4 = 0 then 'cik' when t.n is not null then 'ticker' when l.n is not null then 'title' end as matched_by,
  case when c_custkey % 4 = 0 then 'resolved' when t.n > 1 then 'ambiguous' when t.n = 1 then 'resolved' when l.n > 1 then 'ambiguous' when l.n = 1 then 'resolved' else 'not_found' end as status
from asked left join t on t.p = upper(trim(ident)) left join l on l.p = upper(trim(ident))""")
def identifier_cascade(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    directory = c.select(F.lpad(k.cast("string"), 10, "0").alias("cik"), text("T", k % 120).alias("ticker"), F.col("c_name").alias("title"))
    ident = F.when(k % 4 == 0, text("cik", k)).when(k % 4 == 1, text(" t", k % 160, " ")).when(k % 4 == 2, F.lower("c_name")).otherwise(text("nobody ", k))
    return sets.resolve_identifiers(c.select("c_custkey", ident.alias("ident")), "ident", directory).select("c_custkey", "cik", "matched_by", "status")


_UNITS = (("{http://www.xbrl.org/2003/iso4217}USD", None), ("{http://www.xbrl.org/2003/instance}shares", None), ("{http://www.xbrl.org/2003/instance}pure", None), ("{http://www.xbrl.org/2003/iso4217}EUR", "{http://www.xbrl.org/2003/instance}shares"), ("{urn:x}acres", None), ("{http://www.xbrl.org/2003/iso4217}USD", "{urn:x}acres"))
_SPACES = ("http://fasb.org/us-gaap/2023", "http://xbrl.sec.gov/dei/2023", "http://xbrl.ifrs.org/taxonomy/2022-03-24/ifrs-full", "urn:own", "", "http://fasb.org/srt/2020")


@query("""select c_custkey, case c_custkey % 6 when 0 then 'USD' when 1 then 'shares' when 2 then 'pure' when 3 then 'EUR/shares' else 'unknown' end as unit, case c_custkey % 6 when 0 then 'USD' when 3 then 'EUR' end as currency, case c_custkey % 6 when 0 then 'monetary' when 1 then 'shares' when 2 then 'pure' end as family,
  case c_custkey % 6 when 0 then 'us-gaap' when 1 then 'dei' when 2 then 'ifrs-full' when 3 then 'custom' when 4 then 'unknown' else 'srt' end as taxonomy, 'cik:' || lpad(c_custkey::varchar, 10, '0') || '#class:' || case c_custkey % 2 when 0 then 'common-stock' else 'class-a' end as security_id,
  'cik:' || lpad(c_custkey::varchar, 10, '0') as company_id, 'Customer-' || c_custkey || '-x' as slug from customer""")
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    of = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % 6 + 1).cast("int"))
    bottom = F.when(of([b or "" for _, b in _UNITS]) != "", F.array(of([b or "" for _, b in _UNITS]))).otherwise(F.array().cast("array<string>"))
    unit = s.canonical_unit(F.array(of([a for a, _ in _UNITS])), bottom)
    security = s.security_id(k, F.when(k % 2 == 0, " Common  Stock").otherwise("CLASS A"))
    return table(spark, d, "customer").select("c_custkey", unit.alias("u"), s.taxonomy(of(_SPACES)).alias("taxonomy"), security.alias("security_id"), s.company_of_security(security).alias("company_id"), s.slug(F.concat(F.lit("Customer #&"), k.cast("string"), F.lit(" x"))).alias("slug")).select("c_custkey", "u.unit", "u.currency", s.unit_family(F.col("u.unit"), F.col("u.currency")).alias("family"), "taxonomy", "security_id", "company_id", "slug")


@query("""select o_orderkey, case o_orderkey % 3 when 0 then -round(o_totalprice * 1000, 2) when 1 then round(o_totalprice * 1000, 2) end as value, case when o_orderkey % 3 <> 2 then case when o_orderkey % 3 = 0 then '-' else '' end || regexp_replace(regexp_replace((o_totalprice::decimal(18,2) * 1000)::varchar, '0+$', ''), '\\.$', '') end as text from orders""".replace("\\\\", "\\"))
def lexical_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 2, "n/a").otherwise(F.format_number("o_totalprice", 2))
    made = s.folded(text, F.lit(3), F.when(k % 3 == 0, "-"))
    return table(spark, d, "orders").select("o_orderkey", s.plain_decimal(made).cast("double").alias("value"), s.plain_decimal(made).alias("text"))


_VERSIONS = f"""with recursive {_FACTS}, ids as (select distinct company_id as part, unnest(['tv' || chr(0) || 't1', 'pol' || chr(0) || 'p1', 'raw' || chr(0) || sha256(filing_id), 'fact' || chr(0) || sha256(filing_id || concept)]) as id from facts)"""


@query(_VERSIONS + """, t(part, level, i, h) as (select part, 0, row_number() over (partition by part order by id) - 1, sha256(id) from ids
  union all select part, max(level) + 1, i // 2, case when count(*) = 2 then sha256(string_agg(h, chr(0) order by i)) else max(h) end from (select *, max(i) over (partition by part) as top from t) where top > 0 group by part, i // 2)
  select part as company_id, 'sha256:' || arg_max(h, level) as root, count(*) filter (where level = 0) as n from t group by part""")
def dataset_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = facts(spark, d).select("company_id", F.sha2("filing_id", 256).alias("document"), F.sha2(F.concat("filing_id", "concept"), 256).alias("fact"))
    return store.dataset_version(rows, ["company_id"], "t1", ["p1"], "document", "fact")


_HELD = "from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P'"


@query(f"""
with months as (select distinct date_trunc('quarter', o_orderdate)::date::varchar as win, c_mktsegment as series, strftime(o_orderdate, '%Y-%m') as month {_HELD}),
series as (select win, series, count(*) as n, string_agg(month, ',' order by month) as schedule from months group by win, series)
select win, count(distinct n) = 1 and count(distinct schedule) = 1 as commensurable,
  case when count(distinct n) > 1 then 'n' when count(distinct schedule) > 1 then 'schedule' end as differs
from series group by win""")
def commensurable_series(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    held = o.join(c, o["o_custkey"] == c["c_custkey"]).where("o_orderstatus = 'P'")
    win = F.trunc(F.col("o_orderdate").cast("date"), "quarter").cast("string")
    months = F.array_sort(F.collect_set(F.date_format("o_orderdate", "yyyy-MM")))  # three at most
    schedules = held.groupBy(win.alias("win"), F.col("c_mktsegment").alias("series")).agg(months.alias("_months"))
    schedules = schedules.select("win", "series", F.size("_months").alias("n"), F.array_join("_months", ",").alias("schedule"))
    return research.commensurable(schedules, ["win"], ["n", "schedule"])


@query("""with levels as (select c_mktsegment as series_id, date_trunc('month', o_orderdate)::date as month, sum(o_totalprice::decimal(18,2))::double as level from orders join customer on o_custkey = c_custkey group by 1, 2),
r as (select series_id, month, level / nullif(lag(level) over (partition by series_id order by month), 0) - 1 as ret from levels), w as (select series_id, month, product(1 + ret) over (partition by series_id order by month rows unbounded preceding) as level from r where ret is not null),
a as (select * from w union all select distinct series_id, null::date, 1.0 from w), p as (select *, max(level) over (partition by series_id order by month nulls first rows unbounded preceding) as peak from a) select series_id, """ + sq("-min(level / peak - 1)") + """ as max_drawdown from p group by 1""")
def wealth_drawdown(spark: SparkSession, d: str) -> DataFrame:
    levels = series.wealth(segment_returns(spark, d), ["series_id"], "month", "ret")
    return _quantised(series.worst_episode(levels, ["series_id"], "month", "level"), "max_drawdown").select("series_id", "max_drawdown")



_CURVES = """curves as (select c_mktsegment as series_id, date_trunc('month', o_orderdate)::date as month, sum(o_totalprice::decimal(18,2))::double as equity from orders join customer on o_custkey = c_custkey group by 1, 2),
p as (select *, equity / lag(equity) over (partition by series_id order by month) - 1 as r, max(equity) over (partition by series_id order by month rows unbounded preceding) as top from curves),
stats as (select series_id, count(r) as n_periods, arg_min(equity, month) as initial, arg_max(equity, month) as final, max(equity) as peak, arg_max(equity, month) / arg_min(equity, month) - 1 as cumulative, avg(r) as mean, stddev_pop(r) as vol, (avg(r) / stddev_pop(r)) * sqrt(12) as sharpe, min(equity / top - 1) as max_drawdown from p group by 1)"""
_STATS = ("cumulative", "mean", "vol", "sharpe", "max_drawdown", "final", "peak", "n_periods")


def _curves(spark: SparkSession, d: str) -> DataFrame:
    return series.equity_statistics(segment_returns(spark, d).select("series_id", "month", "level"), ["series_id"], "month", "level", per_year=12)


@query(f"with {_CURVES} select series_id, n_periods, initial, final, peak, {', '.join(f'{sq(c)} as {c}' for c in ('cumulative', 'mean', 'vol', 'sharpe', 'max_drawdown'))} from stats")
def equity_curves(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(_curves(spark, d), "cumulative", "mean", "vol", "sharpe", "max_drawdown").drop("mean_turnover")


@query(f"with {_CURVES}, long as (unpivot (select series_id, {', '.join(f'{c}::double as {c}' for c in _STATS)} from stats) on {', '.join(_STATS)} into name stat value value) select stat, series_id, {sq('value')} as value, row_number() over (partition by stat order by case when stat = 'vol' then value else -value end, series_id) as place, null::varchar as excluded from long")
def leaderboards(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(backtest.leaderboards(_curves(spark, d), _STATS, "series_id"), "value")


@query("select user_id as security_id, ts::date::varchar as trading_date, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as observed, strftime(min(ts + to_hours((event_id % 7)::int)), '%Y-%m-%d %H:%M:%S') as retrieved from events group by user_id, ts::date")
def session_evidence(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("ts")
    rows = table(spark, d, "events").select(F.col("user_id").alias("security_id"), at.cast("date").alias("trading_date"), at.alias("observed"), (at + F.make_interval(hours=(F.col("event_id") % 7).cast("int"))).alias("retrieved"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return prices.earliest_evidence(rows).select("security_id", F.col("trading_date").cast("string").alias("trading_date"), stamp("observed"), stamp("retrieved"))
