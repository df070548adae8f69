"""Places and running sums over all rows, or over groups of any size, in a total order.

A window over everything, or over one group that holds most rows, is one task. Here the rows are dealt to ranges of their order, each range counts for itself,
and the totals of the ranges before it are added. What goes to one task is one row for each range (and group), never the rows.

Rows are written into the shared folder once they are sorted, so that a range keeps its rows when an executor is lost. Rows that are equal in all of `order`
come in any order; make it total where that matters. Null and repeated keys are ordinary values; an empty table gives an empty result. New columns replace
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Rows of one range are numbered below this by monotonically_increasing_id.
_PER_PART = 1 << 33
_PART, _AT = "_range", "_at_in_range"


def _ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df sorted over all its partitions, with the number of its range and its place there."""
    place = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_AT, place)
    return written(ranged.withColumn(_PART, F.expr(f"{_AT} div {_PER_PART}")).withColumn(_AT, F.col(_AT) % _PER_PART))


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place", within: Sequence[str] = ()) -> DataFrame:
    """df and `name`: how many rows come before (in the groups of the columns `within`, where given)."""
    groups = list(within)
    rows = _ranged(df, [*[F.col(c).asc_nulls_first() for c in groups], *order])
    if not groups:
        before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy(_PART).agg(F.count("*").alias("_n")).select(_PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
        return rows.join(F.broadcast(starts), _PART).withColumn(name, F.col("_start") + F.col(_AT)).drop(_PART, _AT, "_start")
    # a group is a run of places in each range that holds it: one row for each run
    runs = rows.groupBy(_PART, *groups).agg(F.count("*").alias("_n"), F.min(_AT).alias("_low"))
    before = Window.partitionBy(*groups).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col(_PART).alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_start"))
    same = (F.col(_PART) == F.col("_p")) & _same(groups)
    return rows.join(starts, same).withColumn(name, F.col("_start") + F.col(_AT)).select(*[c for c in df.columns if c != name], name)


def _same(groups: Sequence[str]) -> Column:
    at = F.lit(True)
    for i, c in enumerate(groups):
        at = at & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return at


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """df and, by name, the sums of columns over all rows before."""
    made = df.select("*", *[v.alias(f"_v_{k}") for k, v in sums.items()])
    rows = _ranged(made, order)
    totals = rows.groupBy(_PART).agg(*[F.coalesce(F.sum(f"_v_{k}"), F.lit(0)).alias(f"_t_{k}") for k in sums])
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(_PART, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums])
    here = Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(starts), _PART).select(*[c for c in df.columns if c not in sums], *[(F.col(f"_s_{k}") + F.coalesce(F.sum(f"_v_{k}").over(here), F.lit(0))).alias(k) for k in sums])
    return out


def followed(df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: str, name: str) -> DataFrame:
    """df and `name`: `value` of the next row of its group in the order; null for the last one."""
    rows = _ranged(df, [*[F.col(c).asc_nulls_first() for c in groups], *order])
    keyed = F.struct(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], F.col(value).alias("_v"))
    firsts = rows.groupBy(_PART).agg(F.min_by(keyed, _AT).alias("_first"))
    after = firsts.select(_PART, F.lead("_first").over(Window.orderBy(_PART)).alias("_after"))
    following = F.coalesce(F.lead(keyed).over(Window.partitionBy(_PART).orderBy(_AT)), F.col("_after"))
    same = F.lit(True)
    for i, c in enumerate(groups):
        same = same & F.col(c).eqNullSafe(F.col(f"_next._g{i}"))
    out = rows.join(F.broadcast(after), _PART).withColumn("_next", following)
    return out.select(*[c for c in df.columns if c != name], F.when(F.col("_next").isNotNull() & same, F.col("_next._v")).alias(name))
