"""Point-in-time selection: what was known when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import followed, running


def eligible(available: Column, as_of: Column, status: Column | None = None) -> Column:
    """Known by as_of: a known time not after it and, where a status is given, a verified or derived one. Unknown fails closed."""
    known = available.isNotNull() & (available <= as_of)
    return known if status is None else known & F.coalesce(status.isin("verified", "derived"), F.lit(False))


def latest_as_of(df: DataFrame, keys: Sequence[str], available: str, ties: Sequence[str], as_of, status: str | None = None) -> DataFrame:
    """For each key the eligible row of latest availability (then of greatest ties), and how many were eligible.

    One shuffle by key, after a filter that reaches the scan; max_by aggregates before the shuffle, so a hot key is no hot task.
    """
    rows = df.where(eligible(F.col(available), F.lit(as_of), F.col(status) if status else None))
    others = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(available, *ties, F.struct(*others).alias("row"))).alias("best")
    return rows.groupBy(*keys).agg(best, F.count("*").alias("eligible_count")).select(*keys, *[F.col("best.row")[c].alias(c) for c in others], "eligible_count")


def frontier(df: DataFrame, available: str, status: str | None = None):
    """The ingestion frontier: the latest known availability of the corpus."""
    known = df.where(F.col(status).isin("verified", "derived")) if status else df
    return known.agg(F.max(available)).first()[0]


def revised(df: DataFrame, keys: Sequence[str], available: str, ties: Sequence[str], status: str | None = None) -> DataFrame:
    """latest_as_of at the frontier."""
    return latest_as_of(df, keys, available, ties, frontier(df, available, status), status)


def vintages(df: DataFrame, keys: Sequence[str], available: str, ties: Sequence[str], as_ofs: Sequence) -> DataFrame:
    """latest_as_of for several instants in one pass.

    A row belongs to the first instant that knows it. By key and such instant the winner is chosen and rows are counted, before the shuffle as well, so rows
    do not grow with the instants and a key that holds most rows comes to one row for each instant. A winner stands until the next instant that knows a later
    row: only then is it written out for each instant."""
    instants = sorted(set(as_ofs))
    held = F.array(*[F.lit(a) for a in instants])
    first = F.size(F.filter(held, lambda a: a < F.col(available)))
    rows = df.where(F.col(available).isNotNull() & (F.col(available) <= F.lit(instants[-1]))) if instants else df.limit(0)
    others = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(available, *ties, F.struct(*others).alias("row"))).alias("best")
    won = rows.withColumn("_first", first).groupBy(*keys, "_first").agg(best, F.count("*").alias("_n"))
    by_key = Window.partitionBy(*keys).orderBy("_first")
    until = F.coalesce(F.lead("_first").over(by_key), F.lit(len(instants))) - 1
    stands = won.withColumn("eligible_count", F.sum("_n").over(by_key)).withColumn("_until", until)
    stands = stands.withColumn("as_of", F.explode(F.slice(held, F.col("_first") + 1, F.col("_until") - F.col("_first") + 1)))
    return stands.select("as_of", *keys, *[F.col("best.row")[c].alias(c) for c in others], "eligible_count")


def validity(df: DataFrame, keys: Sequence[str], available: str, ties: Sequence[str]) -> DataFrame:
    """The winner of each key over time: a row for each instant at which it changes, with valid_from, valid_to (exclusive; null: still valid) and how many rows were known.

    Rows of one availability are reduced to their winner before the shuffle; versions are put in order over ranges, not in one task for each key. Rows of unknown
    availability are never valid."""
    others = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*ties, F.struct(*others).alias("row"))).alias("_best")
    known = df.where(F.col(available).isNotNull()).groupBy(*keys, F.col(available).alias("valid_from")).agg(best, F.count("*").alias("_n"))
    order = [F.col("valid_from").asc()]
    counted = running(followed(known, keys, order, "valid_from", "valid_to"), [*[F.col(k).asc_nulls_first() for k in keys], *order], {"_before": F.col("_n")})
    starts = counted.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_before").alias("_start"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    count = F.col("_before") + F.col("_n") - F.col("_start")
    return counted.join(starts, same).select(*keys, "valid_from", "valid_to", *[F.col("_best.row")[c].alias(c) for c in others], count.alias("eligible_count"))


def known_at(valid: DataFrame, instants: DataFrame, as_of: str, salts: int = 16) -> DataFrame:
    """The versions (of `validity`) that are valid at each instant of a table, however many: as_of and the columns of valid.

    The time between the first and the last instant is cut into as many stretches as there are instants; versions go to the stretches that they touch, which are about
    as many as the instants that they answer, and meet the instants there. Stretches are dealt by a hash of the version as well, so one that all touch is many tasks."""
    asked = instants.select(F.col(as_of).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    bounds = asked.agg(F.min(micros(F.col("_t"))).alias("_low"), F.max(micros(F.col("_t"))).alias("_high"), F.count("*").alias("_n"))
    width = F.greatest(F.call_function("div", F.col("_high") - F.col("_low"), F.col("_n")), F.lit(1))
    bounds = F.broadcast(bounds.select("_low", "_high", width.alias("_width")))  # one row
    at = lambda c: F.call_function("div", c - F.col("_low"), F.col("_width"))
    start, end = micros(F.col("valid_from")), F.coalesce(micros(F.col("valid_to")) - 1, F.col("_high"))
    rows = valid.join(bounds).where((start <= F.col("_high")) & (end >= F.col("_low")))
    dealt = rows.select(*[F.col(c) for c in valid.columns], F.explode(F.sequence(at(F.greatest(start, F.col("_low"))), at(F.least(end, F.col("_high"))))).alias("_b"), F.pmod(F.xxhash64(*valid.columns), F.lit(salts)).alias("_s"))
    met = asked.join(bounds).select("_t", at(micros(F.col("_t"))).alias("_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("_s"))
    inside = (F.col("_t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_t") < F.col("valid_to")))
    return dealt.join(met.hint("merge"), ["_b", "_s"]).where(inside).select(F.col("_t").alias(as_of), *valid.columns)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], strict: bool = False) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time (before it, if strict).

    A union of both sides and one window by key: rows are sorted once, and no pair is built.
    """
    payload = F.struct(F.col(right_time).alias("_time"), *values)
    kind = right.select(payload.alias("p")).schema["p"].dataType
    mine = left.select(*by, F.col(left_time).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(kind).alias("_p"), F.struct(*left.columns).alias("_row"))
    theirs = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("_at"), F.lit(1 if strict else 0).alias("_side"), payload.alias("_p"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = mine.unionByName(theirs).withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    return found.select("_row.*", F.col("_p._time").alias(f"{right_time}_matched"), *[F.col("_p")[v].alias(v) for v in values])


def policy_join(facts: DataFrame, policies: Sequence[tuple], time: str, form: str) -> DataFrame:
    """The policy whose era [from, to) and form scope cover each fact: (policy_id, from_ts, to_ts or None, forms) tuples, '*' for all forms.

    Policies are a handful of rows of a specification, so they are literals of the expression and nothing is joined. No policy
    gives status unknown, several an ambiguous one.
    """
    fits = [
        F.when((F.col(time) >= F.lit(since)) & (F.lit(True) if until is None else F.col(time) < F.lit(until)) & (F.lit("*" in forms) | F.col(form).isin(*forms)), F.lit(name))
        for name, since, until, forms in policies
    ]
    found = F.array_compact(F.array(*fits))
    status = F.when(F.size(found) == 1, "derived").when(F.size(found) == 0, "unknown").otherwise("ambiguous")
    return facts.withColumn("policy_status", status).withColumn("policy_id", F.when(F.size(found) == 1, F.element_at(found, 1)))
