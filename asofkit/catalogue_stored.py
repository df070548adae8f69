"""Queries of stored and streamed knowledge: documents read by a source of our own, growing hash trees, write-once records, late corrections, each with SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query, table
from .catalogue_pit import _CALENDAR
from .shared import new_folder
from .sources import documents, hashtree, market, store
from .streaming import knowledge, records


@query("""
select 'N' || s_nationkey as security_id, l_shipdate::date::varchar as trading_date, 'USD' as currency, min(l_extendedprice) as low, max(l_extendedprice) as high, count(*)::double as volume
from lineitem join supplier on l_suppkey = s_suppkey where l_shipdate::date <= date '1997-06-30' group by s_nationkey, l_shipdate::date""")
def bars_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Nations are securities: their line items become documents by year, which the source reads as known at a day."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    day = F.col("l_shipdate").cast("date")
    daily = rows.groupBy(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("security_id"), day.alias("trading_date"))
    bars = daily.agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.count("*").alias("volume"))
    of_year = bars.groupBy("security_id", F.year("trading_date").alias("year")).agg(F.collect_list(F.struct("trading_date", "low", "high", "volume")).alias("bars"))
    root = new_folder(spark, "bars")
    of_year.select("security_id", "year", F.to_json(F.struct(F.lit("USD").alias("currency"), "bars")).alias("value")).write.partitionBy("security_id", "year").text(root)
    read = documents.bars(spark, root, last=date(1997, 6, 30))
    return read.select("security_id", F.col("trading_date").cast("string").alias("trading_date"), "currency", "low", "high", "volume")


@query("""
with i as (select event_type, sha256(event_id::varchar) as h, bool_and(epoch_of) as fresh from (select *, ts >= timestamp '2024-02-01' as epoch_of from events) group by event_type, event_id),
l3 as (select event_type, h[1:3] as p, sha256(string_agg(h, '' order by h)) as hash, count(*) as n, bool_or(fresh) as c from i group by event_type, h[1:3]),
l2 as (select event_type, p[1:2] as q, sha256(string_agg(p || hash, '' order by p)) as hash, sum(n) as n, bool_or(c) as c from l3 group by event_type, p[1:2]),
l1 as (select event_type, q[1:1] as p, sha256(string_agg(q || hash, '' order by q)) as hash, sum(n) as n, bool_or(c) as c from l2 group by event_type, q[1:1]),
l0 as (select event_type, sha256(string_agg(p || hash, '' order by p)) as hash, sum(n) as n, bool_or(c) as c from l1 group by event_type),
nodes as (select event_type, c from l3 union all select event_type, c from l2 union all select event_type, c from l1 union all select event_type, c from l0)
select event_type, 'sha256:' || hash as root, n::bigint as n, (select count(*) from nodes o where o.event_type = l0.event_type) as nodes,
  (select count(*) from nodes o where o.event_type = l0.event_type and o.c) as hashed from l0""")
def hash_tree_growth(spark: SparkSession, d: str) -> DataFrame:
    """The corpora of event types, grown by the events of a later month."""
    by, late = ["event_type"], F.col("ts") >= F.lit("2024-02-01").cast("timestamp_ntz")
    events = table(spark, d, "events").select("event_type", "event_id", "ts")
    before, after = events.where(~late), events.where(late)
    made = hashtree.grown(hashtree.tree(before, by, "event_id", 3), before, after, by, "event_id", 3)
    cost = made.groupBy(*by).agg(F.count("*").alias("nodes"), F.count_if("changed").alias("hashed"))
    return hashtree.roots(made, by).join(cost, by)


@query("""
with e as (select user_id, event_type, min(month(ts)) as first_month, count(*) as n from events group by user_id, event_type)
select first_month::bigint as epoch, event_type, count(*) as records from e group by first_month, event_type""")
def records_by_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of user and event type that each month brings anew, months written as epochs, each delivered twice."""
    events = table(spark, d, "events").select("user_id", "event_type", F.month("ts").alias("month"))
    path, made = new_folder(spark, "records"), store.with_id(events, "pair", ["user_id", "event_type"])
    for month in range(1, 13):
        for _ in range(2):
            records.commit(made.where(F.col("month") == month).drop("month"), month, path)
    kept = records.records(spark, path, made.drop("month").schema)
    return kept.groupBy(F.col("epoch").cast("bigint").alias("epoch"), "event_type").agg(F.count("*").alias("records"))


@query("""
with best as (select user_id, event_type, ts, arg_max(value, event_id) as value, count(*) as n from events group by user_id, event_type, ts),
known as (
  select user_id, event_type, ts, value, lag(value) over w as previous, row_number() over w as place, (sum(n) over w)::bigint as eligible_count
  from best window w as (partition by user_id, event_type order by ts))
select user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as valid_from, value, previous,
  case when place = 1 then 'first' when value = previous then 'confirmation' else 'correction' end as kind, eligible_count
from known where epoch_ms(ts) + 1 <= (select epoch_ms(max(ts)) - 86400000 from events)""")
def late_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream: every version that the watermark (a day behind) has passed, with what it corrects."""
    before = {k: spark.conf.get(k, None) for k in knowledge.STATE_STORE}
    for k, v in knowledge.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
        out = knowledge.corrections(stream, ["user_id", "event_type"], "ts", ["event_id"], "value", "1 day")
        made, checkpoint = new_folder(spark, "late"), new_folder(spark, "late-checkpoint")
        q = out.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(made)
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.schema(out.schema).parquet(made)
    return rows.withColumn("valid_from", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


# market corpora: line items are evidence of their suppliers' sessions, those of odd numbers stored before

_SESSIONS = """
evidence as (
  select 's' || l_suppkey as security_id, l_shipdate::date as trading_date, case when l_partkey % 9 <> 0 then l_shipdate::date + (l_linenumber % 5)::int end as available,
    case when l_orderkey % 23 = 0 then 'unknown' when l_orderkey % 2 = 0 then 'verified' else 'derived' end as status, 'p' || (l_orderkey % 2) as policy_id, l_linenumber % 2 as stored
  from lineitem)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    day, key = F.col("l_shipdate").cast("date"), F.col("l_orderkey")
    status = F.when(key % 23 == 0, "unknown").when(key % 2 == 0, "verified").otherwise("derived")
    made = [F.when(F.col("l_partkey") % 9 != 0, F.date_add(day, (F.col("l_linenumber") % 5).cast("int"))).alias("available"), status.alias("status")]
    names = [F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("security_id"), day.alias("trading_date")]
    return table(spark, d, "lineitem").select(*names, *made, F.concat(F.lit("p"), (key % 2).cast("string")).alias("policy_id"), (F.col("l_linenumber") % 2).alias("stored"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    rows = _evidence(spark, d)
    none = rows.limit(0)
    return market.merged_sessions(market.merged_sessions(none, rows.where("stored = 1")), rows.where("stored = 0"))


_KNOWN = "status in ('verified', 'derived') and available is not null"


@query(f"""
with {_SESSIONS}, r as (
  select *, row_number() over (partition by security_id, trading_date order by ({_KNOWN}), case when {_KNOWN} then available end desc, stored desc, policy_id desc) as place,
    bool_and({_KNOWN}) over (partition by security_id, trading_date) as all_known from evidence)
select security_id, trading_date::varchar as trading_date, all_known as known, case when all_known then available::varchar end as available from r where place = 1""")
def sessions_merged(spark: SparkSession, d: str) -> DataFrame:
    """When each session became known; of those that cannot be known only that."""
    known = F.coalesce(F.expr(_KNOWN), F.lit(False))
    return _merged(spark, d).select("security_id", F.col("trading_date").cast("string").alias("trading_date"), known.alias("known"), F.when(known, F.col("available").cast("string")).alias("available"))


@query("""
with leaves as (
  select distinct 's' || l_suppkey as security_id, unnest(['tv' || chr(0) || 'v1', 'pol' || chr(0) || 'p' || (l_orderkey % 2), 'raw' || chr(0) || 'd' || l_orderkey,
    'obs' || chr(0) || l_orderkey || '-' || l_linenumber]) as leaf from lineitem
  union select 's' || l_suppkey, 'act' || chr(0) || 'a' || l_orderkey from lineitem where l_returnflag = 'R'),
i as (select security_id, sha256(leaf) as h from leaves),
l2 as (select security_id, h[1:2] as p, sha256(string_agg(h, '' order by h)) as hash, count(*) as n from i group by security_id, h[1:2]),
l1 as (select security_id, p[1:1] as q, sha256(string_agg(p || hash, '' order by p)) as hash, sum(n) as n from l2 group by security_id, p[1:1]),
l0 as (select security_id, 'sha256:' || sha256(string_agg(q || hash, '' order by q)) as root, sum(n)::bigint as n from l1 group by security_id)
select 'one' as pinned, security_id, root, n from l0
union all select 'all', null, 'sha256:' || sha256(string_agg('{"security_id":"' || security_id || '"}=' || root, chr(10) order by security_id)), sum(n)::bigint from l0""")
def market_pins(spark: SparkSession, d: str) -> DataFrame:
    """The version of each supplier's market data, and one pin over all of them."""
    key = F.col("l_orderkey").cast("string")
    rows = table(spark, d, "lineitem").withColumn("security_id", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    observations = rows.select("security_id", F.concat(F.lit("d"), key).alias("document_id"), F.concat(key, F.lit("-"), F.col("l_linenumber").cast("string")).alias("observation_id"))
    actions = rows.where("l_returnflag = 'R'").select("security_id", F.concat(F.lit("a"), key).alias("action_id"))
    sessions = rows.select("security_id", F.concat(F.lit("p"), (F.col("l_orderkey") % 2).cast("string")).alias("policy_id"))
    each = market.market_version(observations, actions, sessions, "v1")
    whole = hashtree.pin(each, ["security_id"]).select(F.lit("all").alias("pinned"), F.lit(None).cast("string").alias("security_id"), "root", "n")
    return each.select(F.lit("one").alias("pinned"), "security_id", "root", "n").unionByName(whole)


@query(f"""
with {_CALENDAR}, bounds as (select c_mktsegment as segment, min(o_orderdate)::date as first, max(o_orderdate)::date as last from orders join customer on o_custkey = c_custkey group by 1),
traded as (select distinct c_mktsegment as segment, o_orderdate::date as day from orders join customer on o_custkey = c_custkey)
select b.segment, count(*) as days, count(t.day) as traded, min(c.day)::varchar as first_day, max(c.day)::varchar as last_day
from bounds b join business c on c.day between b.first and b.last left join traded t on t.segment = b.segment and t.day = c.day group by b.segment""")
def business_daily_cells(spark: SparkSession, d: str) -> DataFrame:
    """Each segment's axis of business days between its first and last order, and on how many of them it ordered."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    traded = joined.select(F.col("c_mktsegment").alias("segment"), F.col("o_orderdate").cast("date").alias("trading_date")).distinct()
    bounds = traded.groupBy("segment").agg(F.min("trading_date").alias("first"), F.max("trading_date").alias("last"))
    cells = market.business_days_within(bounds, ["segment"], "first", "last").join(traded.withColumn("_t", F.lit(1)), ["segment", "trading_date"], "left")
    ends = [f("trading_date").cast("string").alias(n) for f, n in ((F.min, "first_day"), (F.max, "last_day"))]
    return cells.groupBy("segment").agg(F.count("*").alias("days"), F.count("_t").alias("traded"), *ends)
