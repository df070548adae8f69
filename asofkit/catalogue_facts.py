"""Queries of exact numbers, XBRL instances, validity intervals and ranks within one large date, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query, table
from .functions import numbers
from .operators import exact, pit, ranks
from .sources import registry, xbrl

# exact numbers: prices as texts with powers of ten from -12 to 12


@query("""
with lexical as (
  select l_returnflag, l_linestatus, round(l_extendedprice * 100)::hugeint as cents, ((l_partkey + l_linenumber) % 25 - 12)::int as power,
    case when l_suppkey % 3 = 0 then -1 else 1 end as sign, l_partkey % 11 = 0 as nil
  from lineitem),
sums as (
  select l_returnflag, l_linestatus, count(*) filter (where not nil) as n, sum(sign * cents * ('1' || repeat('0', power + 12))::hugeint) filter (where not nil) as total
  from lexical group by l_returnflag, l_linestatus),
texts as (
  select *, case when total < 0 then '-' else '' end as minus, (abs(total) // 100000000000000)::varchar as whole, lpad((abs(total) % 100000000000000)::varchar, 14, '0') as fraction
  from sums)
select l_returnflag, l_linestatus, n, minus || rtrim(rtrim(whole || '.' || fraction, '0'), '.') as total from texts""")
def exact_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    text = F.when(F.col("l_partkey") % 11 != 0, F.concat_ws(".", F.call_function("div", cents, F.lit(100).cast("bigint")).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")))
    power = (F.col("l_partkey") + F.col("l_linenumber")) % 25 - 12
    number = numbers.folded(text, power, F.when(F.col("l_suppkey") % 3 == 0, "-"))
    made = numbers.totals(rows.withColumn("number", number), ["l_returnflag", "l_linestatus"], "number")
    return made.withColumn("total", numbers.plain(F.col("total")))


@query("""
with n as (select o_orderkey, round(o_totalprice * 100)::bigint * case when o_orderkey % 2 = 0 then -1 else 1 end as cents, (o_orderkey % 6 - 3)::int as places from orders),
r as (
  select *, case when places >= 2 then abs(cents)
    else ((abs(cents) + ('1' || repeat('0', 2 - places))::hugeint // 2) // ('1' || repeat('0', 2 - places))::hugeint) * ('1' || repeat('0', 2 - places))::hugeint end as near
  from n)
select o_orderkey, case when cents < 0 and near > 0 then '-' else '' end || rtrim(rtrim((near // 100)::varchar || '.' || lpad((near % 100)::varchar, 2, '0'), '0'), '.') as rounded,
  row_number() over (order by cents, o_orderkey) as place
from r""")
def exact_rounded(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    number = numbers.folded(F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"), F.lit(-2), F.when(key % 2 == 0, "-"))
    rows = table(spark, d, "orders").select("o_orderkey", number.alias("number"))
    near = numbers.plain(numbers.rounded(F.col("number"), key % 6 - 3))
    placed = ranks.ordinal_rank(rows.select("o_orderkey", near.alias("rounded"), numbers.order_key(F.col("number")).alias("_key")), [], "_key", ["o_orderkey"])
    return placed.select("o_orderkey", "rounded", F.col("rank").alias("place"))


# XBRL: each customer's orders as one instance

_GAAP, _OWN = "http://fasb.org/us-gaap/2023", "urn:orders"


def _instances(spark: SparkSession, d: str) -> DataFrame:
    """path, content: an instance for each customer, a context and one or two facts for each order."""
    o = table(spark, d, "orders")
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    form = F.col("o_orderkey") % 3
    identifier = F.concat(F.lit('<entity><identifier scheme="s">'), F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("</identifier>"))
    member = F.when(form == 0, F.concat(F.lit('<segment><d:typedMember dimension="o:Order"><o:Key> '), key, F.lit(" </o:Key></d:typedMember></segment>")))
    member = member.when(form == 1, F.concat(F.lit('<segment><d:explicitMember dimension="o:Order">o:K'), key, F.lit("</d:explicitMember></segment>"))).otherwise("")
    context = F.concat(F.lit('<context id="c'), key, F.lit('">'), identifier, member, F.lit("</entity><period><instant>"), day, F.lit("</instant></period></context>"))
    name = F.when(form == 2, F.concat(F.lit("o:Order"), key)).otherwise("g:Assets")
    attributes = F.concat(F.lit(' contextRef="c'), key, F.lit('" unitRef="u'), (F.col("o_orderkey") % 2).cast("string"), F.lit('"'), F.when(F.col("o_orderkey") % 5 == 0, ' sign="-"').otherwise(""))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    tag = lambda more, text: F.concat(F.lit("<"), name, attributes, F.lit(more), F.lit(">"), text, F.lit("</"), name, F.lit(">"))
    thousands = F.call_function("div", cents + 50_000, F.lit(100_000).cast("bigint")).cast("string")
    facts = F.concat(tag(' scale="-2" decimals="2"', cents.cast("string")), F.when(F.col("o_orderkey") % 7 == 0, tag(' scale="3" decimals="-3"', thousands)).otherwise(""))
    head = f'<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:g="{_GAAP}" xmlns:o="{_OWN}" xmlns:i="http://www.xbrl.org/2003/iso4217">'
    units = '<unit id="u0"><measure>i:USD</measure></unit><unit id="u1"><divide><unitNumerator><measure>i:USD</measure></unitNumerator><unitDenominator><measure>shares</measure></unitDenominator></divide></unit>'
    body = o.select("o_custkey", F.concat(facts, context).alias("part")).groupBy("o_custkey").agg(F.concat_ws("", F.collect_list("part")).alias("body"))
    return body.select(F.col("o_custkey").cast("string").alias("path"), F.concat(F.lit(head + units), F.col("body"), F.lit("</xbrl>")).cast("binary").alias("content"))


@query(f"""
select o_custkey::varchar as source, lpad(o_custkey::varchar, 10, '0') as entity, case when o_orderkey % 3 = 2 then 'custom' else 'us-gaap' end as taxonomy,
  case when o_orderkey % 3 = 2 then 'Order' || o_orderkey else 'Assets' end as concept, strftime(o_orderdate, '%Y-%m-%d') as period_end,
  case when o_orderkey % 2 = 0 then 'USD' else 'USD/shares' end as unit, 'USD' as currency,
  case when o_orderkey % 5 = 0 then '-' else '' end || rtrim(rtrim((round(o_totalprice * 100)::bigint::decimal(18, 0) / 100)::decimal(18, 2)::varchar, '0'), '.') as value,
  '2' as decimals, case when o_orderkey % 7 = 0 then 2 else 1 end::bigint as n_facts, o_orderkey % 3 = 2 as consolidated,
  case o_orderkey % 3 when 0 then '{{{_OWN}}}Order=[typed]{{{_OWN}}}Key=' || o_orderkey when 1 then '{{{_OWN}}}Order={{{_OWN}}}K' || o_orderkey else '' end as dimensions_key
from orders""")
def xbrl_canonical_facts(spark: SparkSession, d: str) -> DataFrame:
    made = registry.one_of_each(registry.canonical_facts(xbrl.xbrl_facts(_instances(spark, d))))
    return made.select("source", "entity", "taxonomy", "concept", "period_end", "unit", "currency", "value", "decimals", "n_facts", "consolidated", "dimensions_key")


# versions over time

_KEY = ["user_id", "event_type"]


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


_VALID = """
best as (select user_id, event_type, ts as valid_from, arg_max(value, event_id) as value, count(*) as n from events where ts is not null group by user_id, event_type, ts),
valid as (
  select user_id, event_type, valid_from, lead(valid_from) over w as valid_to, value, (sum(n) over w)::bigint as eligible_count
  from best window w as (partition by user_id, event_type order by valid_from))"""


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return pit.validity(table(spark, d, "events").select(*_KEY, "ts", "event_id", "value"), _KEY, "ts", ["event_id"])


@query(f"""with {_VALID} select user_id, event_type, strftime(valid_from, '%Y-%m-%d %H:%M:%S.%f') as valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S.%f') as valid_to, value, eligible_count from valid""")
def validity_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _valid(spark, d).select(*_KEY, _stamp("valid_from"), _stamp("valid_to"), "value", "eligible_count")


@query(f"""
with {_VALID}, asked as (select distinct date_trunc('week', ts) as as_of from events)
select strftime(as_of, '%Y-%m-%d %H:%M:%S.%f') as as_of, user_id, event_type, value, eligible_count
from valid join asked on as_of >= valid_from and (valid_to is null or as_of < valid_to)""")
def known_at_instants(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").select(F.date_trunc("week", "ts").alias("as_of"))
    return pit.known_at(_valid(spark, d), asked, "as_of").select(_stamp("as_of"), *_KEY, "value", "eligible_count")


# one date of all rows


@query("""
with o as (select o_orderkey, o_orderpriority, case when o_orderkey % 13 <> 0 then round(o_totalprice / 1000) end as v from orders),
k as (
  select o_orderkey, row_number() over (order by v, o_orderkey) as rank, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as average_rank,
    ((row_number() over (order by v, o_orderkey) - 1) * 10 // count(*) over ())::bigint as bucket
  from o where v is not null)
select o.o_orderkey, rank, average_rank::double as average_rank, bucket from o left join k using (o_orderkey)""")
def ranks_of_one_date(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 13 != 0, F.round(F.col("o_totalprice") / 1000))
    rows = table(spark, d, "orders").select("o_orderkey", v.alias("v"), F.lit(1).alias("date"))
    made = ranks.ordinal_rank(rows, ["date"], "v", ["o_orderkey"])
    made = ranks.quantile_buckets(ranks.average_rank(made, ["date"], "v"), ["date"], "v", ["o_orderkey"], 10)
    return made.select("o_orderkey", F.col("rank").cast("long").alias("rank"), "average_rank", F.col("bucket").cast("long").alias("bucket"))


@query("""
with b as (select l_returnflag, quantile_cont(l_extendedprice, 0.05) as low, quantile_cont(l_extendedprice, 0.95) as high, count(*) as n from lineitem group by l_returnflag)
select l_returnflag, any_value(b.n) as n, floor(any_value(low) * 1e4 + 0.5) / 1e4 as low, floor(any_value(high) * 1e4 + 0.5) / 1e4 as high,
  count(*) filter (where l_extendedprice < low) as below, count(*) filter (where l_extendedprice > high) as above
from lineitem join b using (l_returnflag) group by l_returnflag""")
def percentiles_of_large_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    bounds = ranks.percentiles(rows, ["l_returnflag"], "l_extendedprice", [0.05, 0.95])
    joined = rows.join(bounds, "l_returnflag")
    q = lambda c: (F.floor(F.max(c) * 1e4 + 0.5) / 1e4)
    outside = [F.count_if(F.col("l_extendedprice") < F.col("p0")).alias("below"), F.count_if(F.col("l_extendedprice") > F.col("p1")).alias("above")]
    return joined.groupBy("l_returnflag").agg(F.max("n").alias("n"), q("p0").alias("low"), q("p1").alias("high"), *outside)


# moments without rounding: prices and quantities as decimals, and as doubles of powers of two


def _floored(name: str, factor: int) -> Column:
    return F.floor(F.col(name).cast("decimal(38,10)") * factor).cast("string").alias(name)


@query("""
with v as (select l_returnflag, l_linestatus, round(l_extendedprice * 100)::hugeint as x, round(l_quantity * 100)::hugeint as y from lineitem),
s as (select l_returnflag, l_linestatus, count(*)::hugeint as n, sum(x) as x, sum(y) as y, sum(x * x) as xx, sum(y * y) as yy, sum(x * y) as xy from v group by l_returnflag, l_linestatus)
select l_returnflag, l_linestatus, n::bigint as n, (x * 10000 // n)::varchar as mean_x, ((n * xx - x * x) // (n * n))::varchar as variance_x,
  ((n * yy - y * y) // (n * n))::varchar as variance_y, ((n * xy - x * y) // (n * n) - case when n * xy < x * y and (n * xy - x * y) % (n * n) <> 0 then 1 else 0 end)::varchar as covariance
from s""")
def exact_moments(spark: SparkSession, d: str) -> DataFrame:
    price, quantity = (F.round(c, 2).cast("decimal(12,2)").alias(c) for c in ("l_extendedprice", "l_quantity"))
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", price, quantity)
    made = exact.moments(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity", text=True)
    return made.select("l_returnflag", "l_linestatus", "n", _floored("mean_x", 10**6), _floored("variance_x", 10**4), _floored("variance_y", 10**4), _floored("covariance", 10**4))


@query("""
with v as (select l_linenumber, floor(l_extendedprice * 64)::hugeint * (1 << (l_partkey % 13)::int) * case when l_orderkey % 2 = 0 then -1 else 1 end as x from lineitem),
s as (select l_linenumber, count(*)::hugeint as n, sum(x) as x, sum(x * x) as xx from v group by l_linenumber)
select l_linenumber, n::bigint as n, (x // n - case when x < 0 and x % n <> 0 then 1 else 0 end)::varchar as mean_x, ((n * xx - x * x) // (n * n))::varchar as variance_x from s""")
def exact_moments_of_doubles(spark: SparkSession, d: str) -> DataFrame:
    x = F.floor(F.col("l_extendedprice") * 64).cast("double") / 4096 * F.pow(F.lit(2.0), F.col("l_partkey") % 13) * F.when(F.col("l_orderkey") % 2 == 0, -1).otherwise(1)
    made = exact.moments(table(spark, d, "lineitem").select("l_linenumber", x.alias("x")), ["l_linenumber"], "x", text=True)
    return made.select("l_linenumber", "n", _floored("mean_x", 2**12), _floored("variance_x", 2**24))
