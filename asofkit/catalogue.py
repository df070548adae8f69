"""Queries over the driver's tables, each with its SQL. Suppliers are securities, their monthly mean price is the close,
their monthly mean discount the signal, and the events are bitemporal facts known from their time on."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as s
from .functions.scalars import q6
from .operators import backtest, panels, pit, research, series, sets
from .plans import formula
from .sources import store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
AS_OF = "2024-01-15 00:00:00"


#: Dates that queries give, as text in both engines.
DATES = {
    "asof_backward_price": "day month_matched", "asof_strict_before": "day month_matched", "complete_case_dates": "month", "unpivot_bars": "month", "metric_ratio_reasons": "quarter", "concept_fallback_coalesce": "quarter",
    "panel_growth": "quarter", "panel_windows": "month", "factor_transforms": "month", "factor_winsorize": "month", "pearson_ic": "month", "spearman_ic": "month", "quantile_buckets": "month", "long_short_factor": "month", "ols_multi_factor": "month", "walkforward_two_asset": "month",
    "running_drawdown": "month", "split_adjust_product": "month", "walkforward_windows": "month", "multiplicity": "month", "net_of_cost_first_period": "month", "top_n_selection": "month", "business_day_calendar": "day", "month_end_schedule": "day month_end sticky",
}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        dates = DATES.get(f.__name__, "").split()
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = f"select * replace ({', '.join(f'{c}::date::varchar as {c}' for c in dates)}) from ({sql})" if dates else sql
        return f

    return keep


def _plain(f: Query) -> Query:
    """f with its dates as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "date"})

    return run


def queries() -> dict[str, Query]:
    return {name: _plain(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, d: str) -> DataFrame:
    """security_id, month, close, signal."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("security_id"), s.month(F.col("l_shipdate")).alias("month"))
    return rows.agg(s.div(s.exact_sum(F.col("l_extendedprice")), s.exact_sum(F.col("l_quantity"))).alias("close"), s.div(s.exact_sum(F.col("l_discount")), F.count("*")).alias("signal"))


def with_forward(spark: SparkSession, d: str) -> DataFrame:
    return panels.forward_return(prices(spark, d), ["security_id"], "month", "close")


def segment_returns(spark: SparkSession, d: str) -> DataFrame:
    """series_id (market segment), month, level, ret: monthly revenue and its growth."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("series_id"), s.month(F.col("o_orderdate")).alias("month")).agg(s.exact_sum(F.col("o_totalprice")).alias("level"))
    return panels.period_return(rows, ["series_id"], "month", "level")


PRICES = """
prices as (
  select l_suppkey as security_id, date_trunc('month', l_shipdate)::date as month,
    sum(l_extendedprice::decimal(18,2))::double / nullif(sum(l_quantity::decimal(18,2))::double, 0) as close,
    sum(l_discount::decimal(18,2))::double / count(*) as signal
  from lineitem group by 1, 2),
fwd as (select *, case when close > 0 then lead(close) over (partition by security_id order by month) / close - 1 end as fwd from prices)"""
SEGMENTS = """
levels as (
  select c_mktsegment as series_id, date_trunc('month', o_orderdate)::date as month, sum(o_totalprice::decimal(18,2))::double as level
  from orders join customer on o_custkey = c_custkey group by 1, 2),
returns as (select *, level / nullif(lag(level) over (partition by series_id order by month), 0) - 1 as ret from levels)"""


def sq(x: str) -> str:
    return f"floor(({x}) * 1e6::double + 0.5) / 1e6::double"


def _quantised(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: q6(F.col(c)) for c in columns})


# point in time

_LATEST = """
select {extra}user_id, event_type, event_id, value, eligible_count from (
  select {extra}user_id, event_type, event_id, value, count(*) over w as eligible_count, row_number() over (w order by ts desc, event_id desc) as rn
  from {source} window w as (partition by {extra}user_id, event_type)) where rn = 1"""
KEYS = ["user_id", "event_type"]


@query(_LATEST.format(extra="", source=f"(select * from events where ts <= timestamp '{AS_OF}')").replace("over (w order by", "over (partition by user_id, event_type order by"))
def pit_as_of(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(*KEYS, "event_id", "value", "ts")
    return pit.latest_as_of(rows, KEYS, "ts", ["event_id"], F.lit(AS_OF).cast("timestamp_ntz")).select(*KEYS, "event_id", "value", "eligible_count")


@query(_LATEST.format(extra="", source="events").replace("over (w order by", "over (partition by user_id, event_type order by"))
def revised_frontier(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(*KEYS, "event_id", "value", "ts")
    return pit.revised(rows, KEYS, "ts", ["event_id"]).select(*KEYS, "event_id", "value", "eligible_count")


_VINTAGES = ["2024-01-05 00:00:00", "2024-01-15 00:00:00", "2024-01-25 00:00:00"]


@query(
    _LATEST.format(extra="as_of, ", source="(select e.*, a.as_of from events e join (select unnest([" + ", ".join(f"'{v}'" for v in _VINTAGES) + "]) as as_of) a on e.ts <= a.as_of::timestamp)").replace("over (w order by", "over (partition by as_of, user_id, event_type order by")
)
def vintage_panel(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(*KEYS, "event_id", "value", "ts")
    made = pit.vintages(rows, KEYS, "ts", ["event_id"], [__import__("datetime").datetime.fromisoformat(v) for v in _VINTAGES])
    return made.select(F.date_format("as_of", "yyyy-MM-dd HH:mm:ss").alias("as_of"), *KEYS, "event_id", "value", "eligible_count")


def _asof_sql(op: str) -> str:
    return f"with {PRICES}, asked as (select distinct s_suppkey as security_id, d.day from supplier, (select unnest([date '1996-03-15', date '1997-07-01', date '1998-01-31']) as day) d) select security_id, day, (select max(month) from prices p where p.security_id = a.security_id and p.month {op} a.day) as month_matched, (select close from prices p where p.security_id = a.security_id and p.month {op} a.day order by month desc limit 1) as close from asked a"


def _asof(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    days = F.array(*[F.lit(x).cast("date") for x in ("1996-03-15", "1997-07-01", "1998-01-31")])
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("security_id"), F.explode(days).alias("day"))
    return pit.asof_join(asked, prices(spark, d), ["security_id"], "day", "month", ["close"], strict)


@query(_asof_sql("<="))
def asof_backward_price(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, False)


@query(_asof_sql("<"))
def asof_strict_before(spark: SparkSession, d: str) -> DataFrame:
    return _asof(spark, d, True)


@query("""
select o_orderkey, o_orderstatus,
  case when o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' and o_orderstatus in ('F', 'O') then 'derived'
       when o_orderdate >= timestamp '1998-01-01' then 'derived' else 'unknown' end as policy_status,
  case when o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' and o_orderstatus in ('F', 'O') then 'early'
       when o_orderdate >= timestamp '1998-01-01' then 'late' end as policy_id from orders""")
def policy_range_join(spark: SparkSession, d: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    policies = [("early", at("1996-01-01"), at("1998-01-01"), ("F", "O")), ("late", at("1998-01-01"), None, ("*",))]
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return pit.policy_join(rows, policies, "o_orderdate", "o_orderstatus").select("o_orderkey", "o_orderstatus", "policy_status", "policy_id")


# sets, filters, identifiers


@query("""
select s_suppkey, case when not r_name in ('ASIA', 'EUROPE') then 'sector' when not s_acctbal > 0 then 'balance' when not exists (select 1 from lineitem where l_suppkey = s_suppkey) then 'traded' end as excluded_by
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def universe_chain_ledger(spark: SparkSession, d: str) -> DataFrame:
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey"))
    traded = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    rows = sets.split_members(rows, traded, "s_suppkey")
    return sets.filter_chain(rows, ("sector", F.col("r_name").isin("ASIA", "EUROPE")), ("balance", F.col("s_acctbal") > 0), ("traded", F.col("is_member"))).select("s_suppkey", "excluded_by")


@query("select coalesce(excluded_by, 'member') as reason, count(*) as n from (" + _SQL["universe_chain_ledger"] + ") group by 1")
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    return universe_chain_ledger(spark, d).groupBy(F.coalesce("excluded_by", F.lit("member")).alias("reason")).agg(F.count("*").alias("n"))


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey) as is_member from customer")
def semi_anti_ledger(spark: SparkSession, d: str) -> DataFrame:
    return sets.split_members(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""
with a as (select distinct l_suppkey as k from lineitem where l_shipdate < timestamp '1996-01-01'), b as (select distinct l_suppkey as k from lineitem where l_shipdate >= timestamp '2000-06-01')
select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' else 'retained' end as change from a full join b on a.k = b.k""")
def universe_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_shipdate")
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return sets.difference(rows.where(F.col("l_shipdate") < at("1996-01-01")), rows.where(F.col("l_shipdate") >= at("2000-06-01")), "k")


@query("select user_id, event_type, arg_min(event_id, ts) as event_id from events group by 1, 2")
def dedup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return sets.first_seen(table(spark, d, "events").select(*KEYS, "event_id", "ts"), KEYS, ["ts", "event_id"]).select(*KEYS, "event_id")


@query(f"with {SEGMENTS} select month from returns where ret is not null group by month having count(distinct series_id) = 5")
def complete_case_dates(spark: SparkSession, d: str) -> DataFrame:
    return sets.complete_dates(segment_returns(spark, d).where("ret is not null"), "series_id", "month", 5)


@query("""
with f as (select o_orderkey as filing_id, o_custkey as company_id, o_orderpriority = '1-URGENT' as amends, date_trunc('month', o_orderdate)::date as report_date, o_orderdate as accepted from orders),
o as (select * from f where not amends),
j as (select a.filing_id, a.company_id, a.report_date, count(o.filing_id) as n, count(o.filing_id) filter (where o.accepted < a.accepted) as e, min(o.filing_id) as one, min(o.filing_id) filter (where o.accepted < a.accepted) as earlier
  from f a left join o on o.company_id = a.company_id and o.report_date = a.report_date where a.amends group by 1, 2, 3)
select filing_id, company_id, case when n = 1 then one when n > 1 and e = 1 then earlier end as amends, case when n < 1 then 'UNKNOWN' when n = 1 and e = 1 then 'HIGH' when n = 1 then 'LOW' when e = 1 then 'LOW' else 'UNKNOWN' end as confidence from j""")
def amendment_self_join(spark: SparkSession, d: str) -> DataFrame:
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "10-K/A").otherwise("10-K")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("filing_id"), F.col("o_custkey").alias("company_id"), form.alias("form"), s.month(F.col("o_orderdate")).alias("report_date"), F.col("o_orderdate").alias("accepted"))
    return sets.amendment_links(rows).select("filing_id", "company_id", "amends", "confidence")


@query("select 'cik:' || lpad(c_custkey::varchar, 10, '0') as company_id, sha256('customer' || chr(0) || c_custkey::varchar || chr(0) || c_name) as content_id, trim(regexp_replace(upper(c_name), '\\s+', ' ', 'g')) as plain from customer")
def id_sha256(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    key, name = F.col("c_custkey"), F.col("c_name")
    return rows.select(s.company_id(key).alias("company_id"), s.content_id(F.lit("customer"), key, name).alias("content_id"), s.plain_name(name).alias("plain"))


@query("select event_id, (props ->> '$.k')::bigint as k from events")
def json_payload_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"with {PRICES} select security_id, month, field, value from (unpivot (select security_id, month, close, signal from prices) on close, signal into name field value value) where value is not null")
def unpivot_bars(spark: SparkSession, d: str) -> DataFrame:
    return prices(spark, d).unpivot(["security_id", "month"], ["close", "signal"], "field", "value").where("value is not null")


@query("""
with f as (select l_orderkey, l_linenumber, l_partkey, l_extendedprice as v, case when l_returnflag = 'R' then 2 when l_returnflag = 'A' then 0 else -2 end as dec from lineitem),
b as (select l_orderkey, l_linenumber, arg_max(v, {'d': dec, 'k': -l_partkey, 'v': v}) as value, max(dec) as decimals, count(*) as n_facts from f group by 1, 2)
select b.*, bool_and(sign(value) * floor(abs(value) * pow(10.0::double, dec) + 0.5) / pow(10.0::double, dec) = sign(v) * floor(abs(v) * pow(10.0::double, dec) + 0.5) / pow(10.0::double, dec)) as consistent
from b join f using (l_orderkey, l_linenumber) group by all""")
def precision_reconcile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("v"), F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 0).otherwise(-2).alias("dec"))
    return sets.reconciled(rows, ["l_orderkey", "l_linenumber"], "v", "dec", ["l_partkey"])


# metrics and panels

_LEDGER = """ledger as (select o_custkey as company, date_trunc('quarter', o_orderdate)::date as quarter,
  sum(o_totalprice::decimal(18,2)) filter (where o_orderstatus = 'F')::double as assets, sum(o_totalprice::decimal(18,2)) filter (where o_orderstatus = 'O')::double as liabilities from orders group by 1, 2)"""


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    of = lambda x: s.exact_sum(F.when(F.col("o_orderstatus") == x, F.col("o_totalprice")))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company"), F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("quarter")).agg(of("F").alias("assets"), of("O").alias("liabilities"))


@query(f"with {_LEDGER} select company, quarter, case when assets is null or liabilities is null or liabilities = 0 then 'UNDEFINED' else 'KNOWN' end as status, assets / nullif(liabilities, 0) as value, case when assets is null or liabilities is null then 'missing_input' when liabilities = 0 then 'divide_by_zero' end as reason from ledger")
def metric_ratio_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = _ledger(spark, d).withColumnsRenamed({"assets": "current_assets", "liabilities": "current_liabilities"})
    return rows.select("company", "quarter", formula.compiled(formula.BUILTIN["current_ratio"]).alias("m")).select("company", "quarter", "m.*")


@query(f"with {_LEDGER} select company, quarter, coalesce(assets, liabilities) as value, case when assets is not null then 'assets' when liabilities is not null then 'liabilities' end as concept from ledger")
def concept_fallback_coalesce(spark: SparkSession, d: str) -> DataFrame:
    concept = F.when(F.col("assets").isNotNull(), "assets").when(F.col("liabilities").isNotNull(), "liabilities")
    return _ledger(spark, d).select("company", "quarter", formula.first_known(F.col("assets"), F.col("liabilities")).alias("value"), concept.alias("concept"))


@query(f"with {_LEDGER}, p as (select *, lag(assets) over (partition by company order by quarter) as prev from ledger) select company, quarter, (assets - prev) / nullif(prev, 0) as value, case when assets is null or prev is null then 'missing_input' when prev = 0 then 'divide_by_zero' end as reason from p")
def panel_growth(spark: SparkSession, d: str) -> DataFrame:
    return panels.growth(_ledger(spark, d), ["company"], "quarter", "assets").select("company", "quarter", "growth.value", "growth.reason")


@query(f"""with {PRICES} select security_id, month, (close + lag(close) over w) / 2 as average,
  case when count(close) over (w rows between 3 preceding and current row) = 4 then {sq("sum(close) over (w rows between 3 preceding and current row)")} end as ttm,
  case when row_number() over w > 6 then {sq("close - median(close) over (w rows between 6 preceding and 1 preceding)")} end as level
from prices window w as (partition by security_id order by month)""".replace("over (w rows", "over (partition by security_id order by month rows"))
def panel_windows(spark: SparkSession, d: str) -> DataFrame:
    df, k = prices(spark, d), (["security_id"], "month", "close")
    df = panels.level_vs_history(panels.trailing_sum(panels.average_balance(df, *k), *k), *k, n=6)
    return _quantised(df, "ttm", "level").select("security_id", "month", "average", "ttm", "level")


# cross-sections


@query(f"""with {PRICES} select security_id, month, row_number() over (partition by month order by signal, security_id) as rank,
  case when max(signal) over w > min(signal) over w then {sq("(signal - avg(signal) over w) / nullif(stddev_pop(signal) over w, 0)")} end as zscore,
  {sq("(signal - min(signal) over w) / nullif(max(signal) over w - min(signal) over w, 0)")} as minmax
from prices window w as (partition by month)""")
def factor_transforms(spark: SparkSession, d: str) -> DataFrame:
    df = prices(spark, d)
    df = panels.minmax(panels.zscore(panels.ordinal_rank(df, ["month"], "signal", "security_id"), ["month"], "signal"), ["month"], "signal")
    return _quantised(df, "zscore", "minmax").select("security_id", "month", "rank", "zscore", "minmax")


@query(f"with {PRICES}, b as (select month, quantile_cont(signal, 0.1) as lo, quantile_cont(signal, 0.9) as hi from prices group by month) select security_id, month, {sq('least(greatest(signal, lo), hi)')} as winsorized from prices join b using (month)")
def factor_winsorize(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(panels.winsorize(prices(spark, d), ["month"], "signal", 0.1, 0.9), "winsorized").select("security_id", "month", "winsorized")


_IC = """select month, count(*) as n, case when count(*) < 2 then 'INSUFFICIENT_MEMBERS' when max({x}) = min({x}) then 'ZERO_SIGNAL_VARIANCE' when max({y}) = min({y}) then 'ZERO_RETURN_VARIANCE' end as ic_reason,
  case when count(*) >= 2 and max({x}) > min({x}) and max({y}) > min({y}) then {ic} end as ic from {source} group by month"""


def _ic_sql(x: str, y: str, source: str) -> str:
    return _IC.format(x=x, y=y, source=source, ic=sq(f"covar_pop({y}, {x}) / nullif(sqrt(var_pop({x}) * var_pop({y})), 0)"))


@query(f"with {PRICES}, ok as (select * from fwd where fwd is not null and signal is not null) " + _ic_sql("signal", "fwd", "ok"))
def pearson_ic(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(panels.correlation(with_forward(spark, d).where("fwd is not null"), ["month"], "signal", "fwd"), "ic")


@query(f"""with {PRICES}, ok as (select * from fwd where fwd is not null), r as (select month, rank() over (partition by month order by signal) + (count(*) over (partition by month, signal) - 1) / 2.0::double as rx,
  rank() over (partition by month order by fwd) + (count(*) over (partition by month, fwd) - 1) / 2.0::double as ry from ok) """ + _ic_sql("rx", "ry", "r"))
def spearman_ic(spark: SparkSession, d: str) -> DataFrame:
    rows = with_forward(spark, d).where("fwd is not null")
    ranked = rows.select("month", panels.average_rank("signal", ["month"]).alias("rx"), panels.average_rank("fwd", ["month"]).alias("ry"))
    return _quantised(panels.correlation(ranked, ["month"], "rx", "ry"), "ic")


@query(f"with {PRICES}, ok as (select * from fwd where fwd is not null and signal is not null), i as ({_ic_sql('signal', 'fwd', 'ok')}) select count(ic) as n_valid, count(*) as n, {sq('avg(ic)')} as mean, {sq('stddev_pop(ic)')} as sd, {sq('avg(ic) / nullif(stddev_pop(ic), 0)')} as ir, {sq('avg(ic) / nullif(stddev_pop(ic), 0) * sqrt(count(ic))')} as t_stat, {sq('avg((ic > 0)::int)')} as hit_rate from i")
def ic_summary(spark: SparkSession, d: str) -> DataFrame:
    m = pearson_ic(spark, d).agg(F.count("ic").alias("n_valid"), F.count("*").alias("n"), F.avg("ic").alias("mean"), F.stddev_pop("ic").alias("sd"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"))
    ir = s.div(F.col("mean"), F.col("sd"))
    made = m.withColumn("ir", ir).withColumn("t_stat", ir * F.sqrt("n_valid"))
    return _quantised(made, "mean", "sd", "ir", "t_stat", "hit_rate").select("n_valid", "n", "mean", "sd", "ir", "t_stat", "hit_rate")


_BUCKETS = """b as (select *, case when count(*) over (partition by month) >= 4 then (row_number() over (partition by month order by signal, security_id) - 1) * 4 // count(*) over (partition by month) end as bucket from fwd where fwd is not null)"""


@query(f"with {PRICES}, {_BUCKETS} select month, bucket, count(*) as n, {sq('avg(fwd)')} as mean from b where bucket is not null group by 1, 2")
def quantile_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = panels.quantile_buckets(with_forward(spark, d).where("fwd is not null"), ["month"], "signal", "security_id", 4).where("bucket is not null")
    return _quantised(b.groupBy("month", "bucket").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean")), "mean")


_LEGS = _BUCKETS.replace(">= 4 then", ">= 8 then")


@query(f"with {PRICES}, {_LEGS} select month, {sq('avg(fwd) filter (where bucket = 3)')} as long, {sq('avg(fwd) filter (where bucket = 0)')} as short, {sq('avg(fwd) filter (where bucket = 3) - avg(fwd) filter (where bucket = 0)')} as ret, case when max(bucket) is null then 'INSUFFICIENT_MEMBERS' end as reason from b group by 1")
def long_short_factor(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(panels.long_short(with_forward(spark, d), ["month"], "signal", "security_id", "fwd", 4), "long", "short", "ret")


@query(f"""with {PRICES}, {_BUCKETS}, m as (select month, bucket, avg(fwd) as mean from b where bucket is not null group by 1, 2), all_ as (select month, q.bucket from (select distinct month from b) cross join (select unnest(range(4)) as bucket) q)
select bucket, count(mean) as n_dates, {sq('avg(mean)')} as mean, count(*) filter (where mean is null) as empty from all_ left join m using (month, bucket) group by 1""")
def bucket_profile(spark: SparkSession, d: str) -> DataFrame:
    b = panels.quantile_buckets(with_forward(spark, d).where("fwd is not null"), ["month"], "signal", "security_id", 4)
    means = panels.bucket_means(b, ["month"], "bucket", "fwd", 4)
    empty = means.groupBy("bucket").agg(F.count("reason").alias("empty"))
    return _quantised(panels.mean_of_means(means, "bucket").join(empty, "bucket"), "mean").select("bucket", "n_dates", "mean", "empty")


@query(f"with {PRICES} select count(*) as n, count(*) filter (where fwd is not null and signal is not null and close is not null) as kept, count(*) filter (where signal is null) as dropped_signal, count(*) filter (where signal is not null and close is null) as dropped_close, count(*) filter (where signal is not null and close is not null and fwd is null) as dropped_fwd from fwd")
def complete_case_counts(spark: SparkSession, d: str) -> DataFrame:
    return panels.complete_cases(with_forward(spark, d), ["signal", "close", "fwd"])[1]


# series


@query(f"""with {SEGMENTS}, m as (select series_id, count(*) as n, avg(ret) as m1, avg(ret*ret) as m2, avg(ret*ret*ret) as m3, avg(ret*ret*ret*ret) as m4, max(ret) as best, min(ret) as worst, avg((ret > 0)::int) as hit, product(1 + ret) - 1 as cum, sqrt(avg(least(ret, 0)*least(ret, 0))) as down from returns where ret is not null group by 1), v as (select *, sqrt(m2 - m1*m1) as vol from m)
select series_id, n, {sq("m1")} as mean, {sq("vol")} as vol, {sq("m1 / vol * sqrt(12)")} as sharpe, {sq("m1 / vol * sqrt(n)")} as t_stat, {sq("hit")} as hit_rate, {sq("cum")} as cumulative, {sq("best")} as best, {sq("worst")} as worst, {sq("down")} as downside, {sq("m1 / down * sqrt(12)")} as sortino,
 {sq("(m3 - 3*m1*m2 + 2*m1*m1*m1) / (vol*vol*vol)")} as skew, {sq("(m4 - 4*m1*m3 + 6*m1*m1*m2 - 3*m1*m1*m1*m1) / (vol*vol*vol*vol) - 3")} as kurtosis from v""")
def series_summary(spark: SparkSession, d: str) -> DataFrame:
    m = series.summary(segment_returns(spark, d), ["series_id"], "ret")
    return _quantised(m, *[c for c in m.columns if c not in ("series_id", "n")])


@query(f"with {SEGMENTS} select series_id, month, max(level) over w as peak, {sq('level / max(level) over w - 1')} as drawdown from levels window w as (partition by series_id order by month rows unbounded preceding)")
def running_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(series.drawdowns(segment_returns(spark, d), ["series_id"], "month", "level"), "drawdown").select("series_id", "month", "peak", "drawdown")


@query(f"""with {SEGMENTS}, p as (select *, max(level) over (partition by series_id order by month rows unbounded preceding) as peak, row_number() over (partition by series_id order by month) as i from levels),
t as (select series_id, arg_min(i, (level / peak - 1, i)) as ti, min(level / peak - 1) as dd, arg_min(peak, (level / peak - 1, i)) as pk from p group by 1)
select t.series_id, {sq("-dd")} as max_drawdown, ti - (select min(i) from p where p.series_id = t.series_id and level = pk) as duration, (select min(i) from p where p.series_id = t.series_id and i > ti and level >= pk) - ti as recovery from t""")
def drawdown_episode(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(series.worst_episode(segment_returns(spark, d).select("series_id", "month", "level"), ["series_id"], "month", "level"), "max_drawdown")


@query(f"with {SEGMENTS}, k as (select series_id, ret, row_number() over (partition by series_id order by ret) as i, greatest(1, ceil(round(0.05 * count(*) over (partition by series_id), 9))) as k from returns where ret is not null) select series_id, {sq('max(ret)')} as var, {sq('avg(ret)')} as cvar from k where i <= k group by 1")
def var_cvar(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(series.value_at_risk(segment_returns(spark, d), ["series_id"], "ret"), "var", "cvar")


_BENCH = "bench as (select month, avg(ret) as b from returns where ret is not null group by 1), j as (select series_id, month, ret as r, b from returns join bench using (month) where ret is not null)"


def _against(spark: SparkSession, d: str) -> DataFrame:
    r = segment_returns(spark, d).where("ret is not null")
    return r.join(r.groupBy("month").agg(F.avg("ret").alias("bench")), "month")


@query(f"""with {SEGMENTS}, {_BENCH}, m as (select series_id, count(*) as n, avg(r) as mr, avg(b) as mb, var_pop(r) as vr, var_pop(b) as vb, covar_pop(r, b) as c, stddev_pop(r - b) as te, avg(r) filter (where b > 0) as u, avg(b) filter (where b > 0) as ub, avg(r) filter (where b < 0) as dn, avg(b) filter (where b < 0) as db from j group by 1)
select series_id, n, {sq("mr - mb")} as active_mean, {sq("te * sqrt(12)")} as tracking_error, {sq("(mr - mb) / te * sqrt(12)")} as information_ratio, {sq("c / vb")} as beta, {sq("mr - c / vb * mb")} as alpha, {sq("c / sqrt(vr * vb)")} as corr, {sq("u / ub")} as up_capture, {sq("dn / db")} as down_capture from m""")
def benchmark_relative(spark: SparkSession, d: str) -> DataFrame:
    m = series.relative(_against(spark, d), ["series_id"], "ret", "bench")
    return _quantised(m, *[c for c in m.columns if c not in ("series_id", "n")])


@query(f"with {PRICES}, a as (select distinct s_suppkey as security_id, date '1997-01-01' as ex, 2.0 as r from supplier union all select s_suppkey, date '1999-01-01', 3.0 from supplier) select security_id, month, {sq('close * coalesce((select product(1 / r) from a where a.security_id = p.security_id and a.ex > p.month), 1)')} as adjusted from prices p")
def split_adjust_product(spark: SparkSession, d: str) -> DataFrame:
    splits = F.array(*[F.struct(F.lit(x).cast("date").alias("ex_date"), F.lit(r).alias("ratio")) for x, r in (("1997-01-01", 2.0), ("1999-01-01", 3.0))])
    actions = table(spark, d, "supplier").select(F.col("s_suppkey").alias("security_id"), F.inline(splits))
    made = series.adjustment_factors(prices(spark, d), actions, "security_id", "month", "ex_date", "ratio")
    return made.select("security_id", "month", q6(F.col("close") * F.col("factor")).alias("adjusted"))


# research

_COMPLETE = "ok as (select series_id, month, ret from returns where ret is not null and month in (select month from returns where ret is not null group by 1 having count(distinct series_id) = (select count(distinct series_id) from returns where ret is not null)))"
_PAIRS = _COMPLETE + ", x as (select a.series_id as i, b.series_id as j, a.ret as p, b.ret as q from ok a join ok b on a.month = b.month and a.series_id <= b.series_id)"
_BOTH = "ok as (select * from returns where ret is not null), x as (select a.series_id as i, b.series_id as j, a.ret as p, b.ret as q from ok a join ok b on a.month = b.month and a.series_id < b.series_id)"


@query(f"with {SEGMENTS}, {_PAIRS} select i, j, count(*) as n, {sq('covar_pop(p, q)')} as cov, {sq('covar_pop(p, q) / sqrt(var_pop(p) * var_pop(q))')} as corr, {sq('covar_pop(p, q) * 12')} as cov_year, case when i = j then {sq('sqrt(covar_pop(p, q) * 12)')} end as vol_year from x group by 1, 2")
def covariance_upper_tri(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(research.upper_triangle(segment_returns(spark, d), "series_id", "month", "ret", per_year=12), "cov", "corr", "cov_year", "vol_year")


@query(f"with {SEGMENTS}, {_PAIRS}, c as (select i, j, covar_pop(p, q) as cov from x group by 1, 2) select i, j, {sq('cov')} as cov from c union all select j, i, {sq('cov')} from c where i <> j")
def dense_covariance(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(research.dense_matrix(research.upper_triangle(segment_returns(spark, d), "series_id", "month", "ret")), "cov").select("i", "j", "cov")


#: Phi by Simpson's rule on 600 intervals from 0, for SQL.
def phi_sql(x: str) -> str:
    return f"(0.5::double + ({x}) / 1800.0::double * list_sum(list_transform(range(0, 601), lambda i: case when i in (0, 600) then 1 when i % 2 = 1 then 4 else 2 end * exp(-pow(({x}) * i / 600.0::double, 2) / 2))) / sqrt(2 * pi()))"


@query(f"""with {SEGMENTS}, {_BOTH}, m as (select i, j, count(*) as n, avg(p - q) as d, sqrt(var_pop(p - q) / count(*)) as se, avg(p) / stddev_pop(p) - avg(q) / stddev_pop(q) as s from x group by 1, 2)
select i, j, n, {sq('d')} as mean_diff, {sq('se')} as se, {sq('d / se')} as t, {sq(f"2 * {phi_sql('-abs(d / se)')}")} as p, {sq('s')} as sharpe_diff, null::varchar as reason from m""")
def paired_difference_t(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(research.paired_differences(segment_returns(spark, d), "series_id", "month", "ret"), "mean_diff", "se", "t", "p", "sharpe_diff")


_OLS = """m as (select {by}, count(*) as n, avg({x}) as mx, avg({y}) as my, var_pop({x}) as vx, var_pop({y}) as vy, covar_pop({y}, {x}) as c from {source} group by 1), o as (select *, c / nullif(vx, 0) as beta, n * (vy - c / nullif(vx, 0) * c) as rss from m)"""


@query(f"with {SEGMENTS}, {_BENCH}, {_OLS.format(by='series_id', x='b', y='r', source='j')} select series_id, n, {sq('my - beta * mx')} as alpha, {sq('beta')} as beta, {sq('1 - rss / (n * vy)')} as r2, {sq('sqrt(rss / (n - 2) / (n * vx))')} as se_beta, {sq('beta / sqrt(rss / (n - 2) / (n * vx))')} as t_beta from o")
def ols_one_factor(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(research.ols_one(_against(spark, d), ["series_id"], "ret", "bench"), "alpha", "beta", "r2", "se_beta", "t_beta")


@query(f"with {PRICES}, ok as (select * from fwd where fwd is not null and signal is not null), {_OLS.format(by='month', x='signal', y='fwd', source='ok')} select count(*) as m, {sq('avg(beta)')} as premium, {sq('stddev_pop(beta) / sqrt(count(*))')} as se, {sq('avg(beta) / (stddev_pop(beta) / sqrt(count(*)))')} as t, null::varchar as reason from o where beta is not null")
def fama_macbeth_one_factor(spark: SparkSession, d: str) -> DataFrame:
    slopes = research.ols_one(with_forward(spark, d), ["month"], "fwd", "signal")
    return _quantised(research.fama_macbeth(slopes, [], "beta"), "premium", "se", "t")


@query(f"""with {PRICES}, ok as (select month, fwd as y, signal as a, close as b from fwd where fwd is not null and signal is not null and close is not null and month < date '1996-01-01'),
m as (select month, count(*)::double as n, avg(y) as my, avg(a) as ma, avg(b) as mb, count(*) * var_pop(a) as aa, count(*) * var_pop(b) as bb, count(*) * covar_pop(a, b) as ab, count(*) * covar_pop(y, a) as ya, count(*) * covar_pop(y, b) as yb, count(*) * var_pop(y) as yy from ok group by 1),
c as (select *, (ya * bb - yb * ab) / (aa * bb - ab * ab) as ca, (yb * aa - ya * ab) / (aa * bb - ab * ab) as cb from m),
r as (select *, yy - ca * ya - cb * yb as rss, (yy - ca * ya - cb * yb) / (n - 3) as s2, aa * bb - ab * ab as det from c),
t as (select month, n, 'intercept' as term, my - ca * ma - cb * mb as coef, sqrt(s2 * (1 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det)) as se, 1.0::double as mx, rss, yy, s2 from r union all select month, n, 'signal', ca, sqrt(s2 * bb / det), ma, rss, yy, s2 from r union all select month, n, 'close', cb, sqrt(s2 * aa / det), mb, rss, yy, s2 from r)
select month, n::bigint as n, term, {sq('coef')} as coef, {sq('se')} as se, {sq('coef / se')} as t, {sq('coef * mx')} as contribution, {sq('1 - rss / yy')} as r2, {sq('1 - rss / yy * (n - 1) / (n - 3)')} as adj_r2, {sq('sqrt(s2)')} as residual_se, null::varchar as reason from t""")
def ols_multi_factor(spark: SparkSession, d: str) -> DataFrame:
    rows = with_forward(spark, d).where(F.col("month") < F.lit("1996-01-01").cast("date"))
    return _quantised(research.ols_many(rows, ["month"], "fwd", ["signal", "close"]), "coef", "se", "t", "contribution", "r2", "adj_r2", "residual_se")


@query()
def gmv_n_asset(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(research.minimum_variance(research.upper_triangle(segment_returns(spark, d), "series_id", "month", "ret")), "weight", "variance")


_THREE = "('AUTOMOBILE', 'BUILDING', 'FURNITURE')"


@query(f"""with {SEGMENTS}, ok as (select month, max(ret) filter (where series_id = 'AUTOMOBILE') as x, max(ret) filter (where series_id = 'BUILDING') as y, max(ret) filter (where series_id = 'FURNITURE') as z from returns where ret is not null and series_id in {_THREE} group by 1 having count(*) = 3),
m as (select var_pop(x) as a, var_pop(y) as b, var_pop(z) as c, covar_pop(x, y) as d, covar_pop(x, z) as e, covar_pop(y, z) as f from ok),
k as (select b * c - f * f - d * c + e * f + d * f - e * b as p, a * c - e * e - d * c + e * f - a * f + d * e as q, a * b - d * d + d * f - b * e - a * f + d * e as r, a * (b * c - f * f) - d * (d * c - e * f) + e * (d * f - b * e) as det from m)
select 'AUTOMOBILE' as series, {sq("p / (p + q + r)")} as weight, {sq("det / (p + q + r)")} as variance from k union all select 'BUILDING', {sq("q / (p + q + r)")}, {sq("det / (p + q + r)")} from k union all select 'FURNITURE', {sq("r / (p + q + r)")}, {sq("det / (p + q + r)")} from k""")
def gmv_three_asset_closed_form(spark: SparkSession, d: str) -> DataFrame:
    rows = segment_returns(spark, d).where(F.col("series_id").isin("AUTOMOBILE", "BUILDING", "FURNITURE"))
    return _quantised(research.minimum_variance(research.upper_triangle(rows, "series_id", "month", "ret")), "weight", "variance")


@query(f"""with {SEGMENTS}, r as (select a.month, a.ret as x, b.ret as y from returns a join returns b on a.month = b.month and a.series_id = 'AUTOMOBILE' and b.series_id = 'BUILDING' where a.ret is not null and b.ret is not null), m as (select var_pop(x) as a, var_pop(y) as b, covar_pop(x, y) as c from r)
select 'AUTOMOBILE' as series, {sq("(b - c) / (a + b - 2 * c)")} as weight, {sq("(a * b - c * c) / (a + b - 2 * c)")} as variance from m union all select 'BUILDING', {sq("(a - c) / (a + b - 2 * c)")}, {sq("(a * b - c * c) / (a + b - 2 * c)")} from m""")
def gmv_two_asset_closed_form(spark: SparkSession, d: str) -> DataFrame:
    rows = segment_returns(spark, d).where(F.col("series_id").isin("AUTOMOBILE", "BUILDING"))
    return _quantised(research.minimum_variance(research.upper_triangle(rows, "series_id", "month", "ret")), "weight", "variance")


@query(f"""with {SEGMENTS}, p as (select month, row_number() over (order by month) - 1 as i from (select distinct month from returns where ret is not null)), w as (select unnest(range(0, (select (max(i) - 24) // 12 + 1 from p))) as win)
select win as "window", 'test' as role, month from w join p on i >= 24 + win * 12 and i < 36 + win * 12 union all select win, 'train', month from w join p on i >= win * 12 and i < win * 12 + 24""")
def walkforward_windows(spark: SparkSession, d: str) -> DataFrame:
    return research.windows(segment_returns(spark, d).where("ret is not null"), "month", 24, 12)


@query()
def walkforward_gmv(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(research.walk_forward(segment_returns(spark, d), "series_id", "month", "ret", 24, 12), "oos_return", "predicted_variance")


#: Minimum variance of two series on windows of 24 months, applied to the 12 after them.
_WALK = f"""{SEGMENTS}, two as (select month, max(ret) filter (where series_id = 'AUTOMOBILE') as x, max(ret) filter (where series_id = 'BUILDING') as y from returns where ret is not null and series_id in ('AUTOMOBILE', 'BUILDING') group by 1 having count(*) = 2),
p as (select *, row_number() over (order by month) - 1 as i from two), wins as (select unnest(range(0, (select (max(i) - 24) // 12 + 1 from p))) as win),
c as (select win, var_pop(x) as a, var_pop(y) as b, covar_pop(x, y) as c from wins join p on i >= win * 12 and i < win * 12 + 24 group by 1), g as (select win, (b - c) / (a + b - 2 * c) as w, (a * b - c * c) / (a + b - 2 * c) as v from c),
walk as (select g.win, month, w * x + (1 - w) * y as r, v from g join p on i >= 24 + win * 12 and i < 36 + win * 12),
cal as (select win, count(*) as n, max(v) as predicted, case when count(*) > 1 then var_pop(r) end as realised from walk group by 1)"""


def _two(spark: SparkSession, d: str) -> DataFrame:
    rows = segment_returns(spark, d).where(F.col("series_id").isin("AUTOMOBILE", "BUILDING"))
    return research.walk_forward(rows, "series_id", "month", "ret", 24, 12)


@query(f"""with {_WALK} select win as "window", month, {sq("r")} as oos_return, {sq("v")} as predicted_variance from walk""")
def walkforward_two_asset(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(_two(spark, d), "oos_return", "predicted_variance")


@query(f"""with {_WALK} select win as "window", n, {sq("predicted")} as predicted, {sq("realised")} as realised, case when predicted is null then 'PREDICTED_VARIANCE_UNDEFINED' when predicted <= 0 then 'ZERO_PREDICTED_VARIANCE' when realised is null then 'SINGLE_VALID_PERIOD' end as reason from cal""")
def realised_variance(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(research.realised(_two(spark, d)), "predicted", "realised")


_RATIOS = f"""{_WALK}, q as (select realised / predicted as r, predicted, realised from cal where realised is not null and predicted > 0), k as (select count(*) as n, avg(r) as mean, sum(realised) / sum(predicted) as pooled, stddev_pop(r) as sd, avg((r > 1)::int) as under, max(r) as hi, min(r) as lo from q)"""


@query(f"""with {_RATIOS} select n, {sq("mean")} as mean_ratio, {sq("pooled")} as pooled_bias, {sq("sd")} as dispersion, {sq("under")} as under_forecast, {sq("hi")} as max_ratio, {sq("lo")} as min_ratio, null::varchar as reason, {sq("(mean - 1) / (sd / sqrt(n))")} as t,
{sq(f"2 * {phi_sql('-abs((mean - 1) / (sd / sqrt(n)))')}")} as p, case when mean > 1 then 'UNDER_FORECAST' when mean < 1 then 'OVER_FORECAST' else 'NONE' end as bias from k""")
def variance_ratio_calibration(spark: SparkSession, d: str) -> DataFrame:
    m = research.calibration(research.realised(_two(spark, d)), [], "predicted", "realised")
    return _quantised(m, *[c for c in m.columns if c not in ("n", "reason", "bias")])


def _trials(spark: SparkSession, d: str) -> DataFrame:
    m = series.summary(segment_returns(spark, d), ["series_id"], "ret", per_year=1).where("series_id is not null")
    names = F.array(*[F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return m.select(F.array_position(names, F.col("series_id")).cast("long").alias("trial"), "series_id", "sharpe", "n", "skew", (F.col("kurtosis") + 3).alias("kurtosis"))


_EXPECTED = (1 - research.EULER) * NormalDist().inv_cdf(1 - 1 / 5) + research.EULER * NormalDist().inv_cdf(1 - 1 / (5 * math.e))
_TRIALS = f"""{SEGMENTS}, m as (select series_id, count(*) as n, avg(ret) as mu, stddev_pop(ret) as sd from returns where ret is not null group by 1),
z as (select r.series_id, avg(pow((ret - mu) / sd, 3)) as skew, avg(pow((ret - mu) / sd, 4)) as kurtosis from returns r join m using (series_id) where ret is not null group by 1),
trials as (select row_number() over (order by series_id) as trial, series_id, mu / sd as sharpe, n, skew, kurtosis, 1 - skew * mu / sd + (kurtosis - 1) / 4 * (mu / sd) * (mu / sd) as v from m join z using (series_id)), best as (select sqrt(var_pop(sharpe)) * {_EXPECTED!r}::double as star, max(sharpe) as top from trials)"""


@query(f"""with {_TRIALS} select trial, series_id, {sq("sharpe")} as sharpe, n, {sq("skew")} as skew, {sq("kurtosis")} as kurtosis, {sq(phi_sql("sharpe * sqrt(n - 1) / sqrt(v)"))} as psr, {sq(phi_sql("(sharpe - star) * sqrt(n - 1) / sqrt(v)"))} as deflated, sharpe = top as selected, null::varchar as reason from trials, best""")
def psr_dsr(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(research.campaign(_trials(spark, d), "trial", "sharpe", "n", "skew", "kurtosis"), "sharpe", "skew", "kurtosis", "psr", "deflated")


@query(f"""with {_TRIALS} select trial, series_id, case when sharpe > 0 then {sq(f"1 + v * pow({NormalDist().inv_cdf(0.95)!r}::double / sharpe, 2)")} end as min_length, n, n >= case when sharpe > 0 then 1 + v * pow({NormalDist().inv_cdf(0.95)!r}::double / sharpe, 2) end as sufficient, case when v <= 0 then 'DEGENERATE_SHARPE_ESTIMATOR' when sharpe <= 0 then 'SHARPE_NOT_ABOVE_BENCHMARK' end as reason from trials""")
def mintrl(spark: SparkSession, d: str) -> DataFrame:
    t = research.track_records(_trials(spark, d), "trial", "sharpe", "n", "skew", "kurtosis")
    return _quantised(t, "min_length").select("trial", "series_id", "min_length", "n", "sufficient", "reason")


@query(f"""with {_TRIALS}, l as (select n, case when sharpe > 0 and v > 0 then 1 + v * pow({NormalDist().inv_cdf(0.95)!r}::double / sharpe, 2) end as m from trials)
select count(m) as n_determined, {sq("avg(m)")} as mean, {sq("stddev_pop(m)")} as dispersion, {sq("max(m)")} as longest, {sq("min(m)")} as shortest, {sq("avg((n >= m)::int) filter (where m is not null)")} as sufficient_share, case when count(m) >= 2 then 'EVALUATED' else 'UNDEFINED' end as status, case when count(m) < 2 then 'INSUFFICIENT_DETERMINED_TRIALS' end as reason from l""")
def mintrl_profile(spark: SparkSession, d: str) -> DataFrame:
    t = research.track_records(_trials(spark, d), "trial", "sharpe", "n", "skew", "kurtosis")
    return _quantised(research.track_record_profile(t), "mean", "dispersion", "longest", "shortest", "sufficient_share")


@query(f"""with {_TRIALS}, p as (select trial, series_id, 1 - {phi_sql("sharpe * sqrt(n - 1) / sqrt(v)")} as p from trials), k as (select *, row_number() over (order by p, trial) as i, count(*) over () as m from p)
select trial, series_id, {sq("p")} as p, {sq("least(1, p * m)")} as bonferroni, {sq("least(1, max(p * (m - i + 1)) over (order by p, trial rows unbounded preceding))")} as holm, {sq("least(1, min(p * m / i) over (order by p, trial rows between current row and unbounded following))")} as bh, least(1, min(p * m / i) over (order by p, trial rows between current row and unbounded following)) <= 0.05 as rejected from k""")
def campaign_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    c = research.campaign(_trials(spark, d), "trial", "sharpe", "n", "skew", "kurtosis").withColumn("p", F.lit(1.0) - F.col("psr")).withColumn("family", F.lit(1))
    a = research.adjusted_p(c, ["family"], "trial", "p").withColumn("rejected", F.col("bh") <= 0.05)
    return _quantised(a, "p", "bonferroni", "holm", "bh").select("trial", "series_id", "p", "bonferroni", "holm", "bh", "rejected")


_P = f"{PRICES}, ok as (select * from fwd where fwd is not null and signal is not null), i as ({_ic_sql('signal', 'fwd', 'ok')}), tests as (select month, extract(year from month)::bigint as year, case when ic_reason is null then least(1.0::double, abs(ic)) end as p from i)"


@query(f"""with {_P}, k as (select *, p is not null as known, row_number() over (partition by year, p is not null order by p, month) as i, count(*) over (partition by year, p is not null) as m from tests), h as (select *, (select sum(1.0::double / g) from range(1, m + 1) t(g)) as cm from k)
select year, month, p, case when known then {sq("least(1, p * m)")} end as bonferroni, case when known then {sq("least(1, max(p * (m - i + 1)) over (partition by year, known order by p, month rows unbounded preceding))")} end as holm,
 case when known then {sq("least(1, min(p * m / i) over (partition by year, known order by p, month rows between current row and unbounded following))")} end as bh,
 case when known then {sq("least(1, min(p * m / i * cm) over (partition by year, known order by p, month rows between current row and unbounded following))")} end as by_ from h""")
def multiplicity(spark: SparkSession, d: str) -> DataFrame:
    tests = pearson_ic(spark, d).select("month", F.year("month").cast("long").alias("year"), F.when(F.col("ic_reason").isNull(), F.least(F.lit(1.0), F.abs("ic"))).alias("p"))
    return _quantised(research.adjusted_p(tests, ["year"], "month", "p"), "bonferroni", "holm", "bh", "by").select("year", "month", "p", "bonferroni", "holm", "bh", F.col("by").alias("by_"))


_WEIGHTS = "w as (select c_mktsegment as series, (year(o_orderdate) - 1990)::bigint as win, sum(o_totalprice::decimal(18,2))::double / sum(sum(o_totalprice::decimal(18,2))::double) over (partition by year(o_orderdate)) as weight from orders join customer on o_custkey = c_custkey where year(o_orderdate) <> 1998 group by 1, 2, year(o_orderdate))"


def _yearly_weights(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).where(F.year("o_orderdate") != 1998)
    sums = rows.groupBy((F.year("o_orderdate") - 1990).cast("long").alias("win"), F.col("c_mktsegment").alias("series")).agg(s.exact_sum(F.col("o_totalprice")).alias("v"))
    return sums.join(sums.groupBy("win").agg(F.sum("v").alias("t")), "win").select("win", "series", (F.col("v") / F.col("t")).alias("weight"))


@query(f"with {_WEIGHTS}, wins as (select distinct win from w) select a.win, case when b.win is not null then {sq('(select sum(abs(coalesce(x.weight, 0) - coalesce(y.weight, 0))) / 2 from (select * from w where win = a.win) x full join (select * from w where win = a.win - 1) y using (series))')} end as turnover from wins a left join wins b on b.win = a.win - 1")
def stability_turnover_gap(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(research.turnover(_yearly_weights(spark, d), [], "win", "series", "weight"), "turnover")


_TURNS = f"{_WEIGHTS}, wins as (select distinct win from w), turns as (select a.win, case when b.win is not null then (select sum(abs(coalesce(x.weight, 0) - coalesce(y.weight, 0))) / 2 from (select * from w where win = a.win) x full join (select * from w where win = a.win - 1) y using (series)) end as turnover from wins a left join wins b on b.win = a.win - 1)"


@query(f"with {_TURNS} select count(turnover) as n_transitions, {sq('avg(turnover)')} as mean, {sq('stddev_pop(turnover)')} as dispersion, {sq('max(turnover)')} as most, {sq('min(turnover)')} as fewest, case when count(turnover) >= 2 then 'STABLE' else 'UNDEFINED' end as status, case when count(turnover) < 2 then 'INSUFFICIENT_TRANSITIONS' end as reason from turns")
def stability_profile(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(research.stability(research.turnover(_yearly_weights(spark, d), [], "win", "series", "weight"), [], "turnover"), "mean", "dispersion", "most", "fewest")


@query(f"with {_WEIGHTS} select win, {sq('sum(abs(weight))')} as gross, {sq('sum(weight * weight)')} as hhi, {sq('max(abs(weight))')} as max_weight, {sq('1 / sum(weight * weight)')} as breadth from w group by 1")
def hhi_breadth(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(research.concentration(_yearly_weights(spark, d), ["win"], "weight"), "gross", "hhi", "max_weight", "breadth")


@query(f"with {SEGMENTS}, r as (select series_id, year(month)::bigint as win, month, ret, 0.5 as t from returns where ret is not null) select series_id, month, {sq('case when row_number() over (partition by series_id, win order by month) = 1 then 0.5 * 0.1 else 0 end')} as cost, {sq('ret - case when row_number() over (partition by series_id, win order by month) = 1 then 0.5 * 0.1 else 0 end')} as net from r")
def net_of_cost_first_period(spark: SparkSession, d: str) -> DataFrame:
    rows = segment_returns(spark, d).where("ret is not null").withColumn("win", F.year("month").cast("long")).withColumn("turnover", F.lit(0.5))
    return _quantised(research.net_of_cost(rows, ["series_id"], "win", "month", "ret", "turnover", 0.1), "cost", "net").select("series_id", "month", "cost", "net")


_COSTED = f"""{SEGMENTS}, {_TURNS}, r as (select series_id, (year(month) - 1990)::bigint as win, month, ret from returns where ret is not null), costed as (select series_id, ret, coalesce(case when row_number() over (partition by series_id, r.win order by month) = 1 then turnover * 0.1 end, 0) as cost from r left join turns t on t.win = r.win),
drags as (select series_id, count(*) as n, avg(ret) as gm, stddev_pop(ret) as gv, avg(ret - cost) as nm, stddev_pop(ret - cost) as nv, sum(cost) as total from costed group by 1)"""


def _drags(spark: SparkSession, d: str) -> DataFrame:
    turns = research.turnover(_yearly_weights(spark, d), [], "win", "series", "weight")
    rows = segment_returns(spark, d).where("ret is not null").withColumn("win", (F.year("month") - 1990).cast("long")).join(turns, "win", "left")
    return research.cost_drags(research.net_of_cost(rows, ["series_id"], "win", "month", "ret", "turnover", 0.1), ["series_id"], "ret")


@query(f"""with {_COSTED} select series_id, n, {sq("gm")} as gross_mean, {sq("nm")} as net_mean, {sq("gm / gv * sqrt(12)")} as gross_sharpe, {sq("nm / nv * sqrt(12)")} as net_sharpe, {sq("gm - nm")} as mean_drag, {sq("(gm / gv - nm / nv) * sqrt(12)")} as sharpe_drag, {sq("total")} as total_cost, nm > 0 as profitable, {sq("nm / nv * sqrt(n)")} as t, {sq(phi_sql("-(nm / nv * sqrt(n))"))} as p from drags""")
def net_of_cost_drags(spark: SparkSession, d: str) -> DataFrame:
    m = _drags(spark, d)
    numbers = ["gross_mean", "net_mean", "gross_sharpe", "net_sharpe", "mean_drag", "sharpe_drag", "total_cost", "t", "p"]
    return _quantised(m, *numbers).select("series_id", "n", *numbers[:7], "profitable", "t", "p")


@query(f"""with {_COSTED}, stab as (select count(turnover) >= 2 as stable from turns), cal as (with {_RATIOS} select case when n >= 2 and hi > lo then 2 * {phi_sql('-abs((mean - 1) / (sd / sqrt(n)))')} end as p from k),
v as (select series_id, case when stable then 'PASS' else 'UNDEFINED' end as stability, case when cal.p is null then 'UNDEFINED' when cal.p > 0.05 then 'PASS' else 'FAIL' end as calibration, case when {phi_sql("-(nm / nv * sqrt(n))")} <= 0.05 and nm > 0 then 'PASS' else 'FAIL' end as net_edge from drags, stab, cal)
select *, case when 'UNDEFINED' in (stability, calibration, net_edge) then 'UNDEFINED' when 'FAIL' in (stability, calibration, net_edge) then 'INADMISSIBLE' else 'ADMISSIBLE' end as verdict from v""")
def admissibility_rollup(spark: SparkSession, d: str) -> DataFrame:
    stable = research.stability(research.turnover(_yearly_weights(spark, d), [], "win", "series", "weight"), [], "turnover").select((F.col("status") == "STABLE").alias("stable"))
    cal = research.calibration(research.realised(_two(spark, d)), [], "predicted", "realised").select(F.col("p").alias("calibration_p"))
    both = _drags(spark, d).join(F.broadcast(stable), F.lit(True)).join(F.broadcast(cal), F.lit(True))  # stable and cal are one row each
    return both.select("series_id", research.admissibility(F.col("stable"), F.col("calibration_p"), F.col("p"), F.col("profitable")).alias("a")).select("series_id", "a.*")


# backtests


@query(f"with {PRICES}, t as (select *, row_number() over (partition by month order by signal desc, security_id) as place from prices) select month, security_id, place, 1.0::double / count(*) over (partition by month) as weight from t where place <= 5")
def top_n_selection(spark: SparkSession, d: str) -> DataFrame:
    return backtest.top_n(prices(spark, d), ["month"], "signal", "security_id", 5).select("month", "security_id", "place", "weight")


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    p = prices(spark, d)
    targets = [backtest.top_n(p, ["month"], "signal", "security_id", n).withColumn("n", F.lit(n)) for n in (3, 5)]
    chosen = targets[0].unionByName(targets[1]).select("n", "month", "security_id", "weight")
    closes = p.select("month", "security_id", "close").withColumn("n", F.explode(F.array(F.lit(3), F.lit(5))))
    rows = closes.join(chosen, ["n", "month", "security_id"], "left")
    return backtest.run(rows.select("n", "month", "security_id", "weight"), p.select("month", "security_id", "close"), ["n"], "month", "security_id", "weight", "close")


@query()
def backtest_fold(spark: SparkSession, d: str) -> DataFrame:
    return _quantised(_sweep(spark, d), "equity", "turnover")


@query(f"with {SEGMENTS}, m as (select series_id, avg(ret) / nullif(stddev_pop(ret), 0) as sharpe from returns where ret is not null group by 1) select series_id, {sq('sharpe')} as sharpe, row_number() over (order by sharpe desc, series_id) as place, null::varchar as excluded from m")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    m = series.summary(segment_returns(spark, d), ["series_id"], "ret", per_year=1).select("series_id", "sharpe")
    return _quantised(backtest.leaderboard(m, "sharpe", "series_id"), "sharpe")


# calendars, corpora


@query("select o_orderdate::date as day, last_day(o_orderdate::date) as month_end, case when o_orderdate::date = last_day(o_orderdate::date) then last_day((o_orderdate + interval 1 month)::date) else (o_orderdate::date + interval 1 month)::date end as sticky from (select distinct o_orderdate from orders)")
def month_end_schedule(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderdate").distinct().select(day.alias("day"), F.last_day(day).alias("month_end"), s.add_months_sticky(day, 1).alias("sticky"))


_TREE = """t(part, level, i, h) as (select part, 0, row_number() over (partition by part order by id) - 1, sha256(id) from ids
  union all select part, max(level) + 1, i // 2, case when count(*) = 2 then sha256(string_agg(h, chr(0) order by i)) else max(h) end from (select *, max(i) over (partition by part) as top from t) where top > 0 group by part, i // 2)
  select part, 'sha256:' || arg_max(h, level) as root, count(*) filter (where level = 0) as n from t group by part"""


@query(f"with recursive ids as (select distinct user_id % 10 as part, sha256(event_id::varchar) as id from events), {_TREE}")
def merkle_root(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").select((F.col("user_id") % 10).alias("part"), F.sha2(F.col("event_id").cast("string"), 256).alias("id"))
    return store.corpus_root(ids, ["part"], "id")


@query("""
select user_id, case when count(*) = count(t) then max(t) end as ts from (
  select user_id, max(ts) as t from events where event_type = 'click' group by 1 union all select user_id, case when user_id % 7 = 0 then null else min(ts) end from events group by user_id) group by 1""")
def merge_availability(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("ts"))
    b = e.groupBy("user_id").agg(F.min("ts").alias("ts")).withColumn("ts", F.when(F.col("user_id") % 7 != 0, F.col("ts")))
    return sets.later_evidence(a, b, "user_id", "ts")
