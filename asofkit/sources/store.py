"""Content-addressed tables: ids from content, write-once appends, corpus roots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON with keys in order and nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def with_id(df: DataFrame, kind: str, columns: Sequence[str]) -> DataFrame:
    """df with payload (canonical JSON of the columns) and record_id (kind and its SHA-256)."""
    return df.withColumn("payload", canonical_json(columns)).withColumn("record_id", F.concat(F.lit(f"{kind}:"), F.sha2("payload", 256)))


def appended(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows that the store lacks, once each. A record_id with several payloads, among the new rows or in the store, is an error.

    Payloads are compared within each record_id before the shuffle, so repetitions of one record cost a row for each task."""
    others = [c for c in new.columns if c not in ("record_id", "payload")]
    payload = F.col("payload")
    mine = new.groupBy("record_id").agg(F.min(payload).alias("payload"), F.max(payload).alias("_most"), *[F.min_by(c, payload).alias(c) for c in others])
    both = mine.join(stored.groupBy("record_id").agg(F.min(payload).alias("_old"), F.max(payload).alias("_old_most")), "record_id", "left")
    clash = ~payload.eqNullSafe(F.col("_most")) | F.col("_old").isNotNull() & ((F.col("_old") != payload) | (F.col("_old_most") != payload))
    guarded = both.withColumn("record_id", F.when(clash, F.raise_error(F.concat(F.lit("record written with another payload: "), "record_id"))).otherwise(F.col("record_id")))
    return guarded.where(F.col("_old").isNull() | clash).select(*new.columns)


def _level(nodes: DataFrame, by: Sequence[str], height: int) -> DataFrame:
    """The tree's nodes `height` levels up: 2^height neighbours at most are paired within one row. Hashes are bytes between levels and hexadecimal digits within them."""
    block = F.shiftright(F.col("_i"), height)
    held = nodes.groupBy(*by, block.alias("_i")).agg(F.array_sort(F.collect_list(F.struct("_i", "_h"))).alias("_a"))
    pair = lambda a, j: F.when(j * 2 + 1 < F.size(a), F.sha2(F.concat(F.get(a, j * 2), F.lit("\0"), F.get(a, j * 2 + 1)), 256)).otherwise(F.get(a, j * 2))
    up = F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.transform("_a", lambda x: F.lower(F.hex(x["_h"]))), lambda a, _: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 2).cast("int")), lambda j: pair(a, j)))
    return held.select(*by, "_i", F.unhex(up[0]).alias("_h"))


def corpus_root(df: DataFrame, by: Sequence[str], id_col: str, height: int = 10, prefix: int = 5) -> DataFrame:
    """by, root, n: the root of the pairwise hash tree over all distinct ids in order; an odd last node goes up unchanged.

    Ids get their places by buckets (the first `prefix` characters of their text, so order is kept): ids are shuffled once, to their buckets, made distinct and
    numbered there; counts of buckets are summed. Each step up pairs 2^height neighbours in a row, so no group grows with the corpus. Ids are their texts; they should be hashes, spread evenly."""
    named = df.select(*by, F.col(id_col).cast("string").alias("_id")).withColumn("_b", F.substr("_id", F.lit(1), F.lit(prefix)))
    ids = named.repartition(*by, "_b").groupBy(*by, "_b", "_id").agg(F.lit(1).alias("_one")).drop("_one")
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_id")) - 1
    placed = written(ids.select(*by, "_b", place.alias("_p"), F.unhex(F.sha2("_id", 256)).alias("_h")))
    counts = placed.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_o", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    nodes = placed.join(offsets.select(*by, "_b", "_o"), [*by, "_b"]).select(*by, (F.col("_o") + F.col("_p")).cast("long").alias("_i"), "_h")
    total = counts.groupBy(*by).agg(F.sum("_n").alias("n"))
    most = total.agg(F.max("n")).first()[0] or 0
    while most > 1:
        nodes, most = _level(nodes, by, height), -(-most // (1 << height))
    root = F.concat(F.lit("sha256:"), F.lower(F.hex("_h"))).alias("root")
    if not by:
        return nodes.join(total, F.lit(True)).select(root, "n")  # one row each
    return nodes.join(total, list(by)).select(*by, root, "n")


def dataset_version(facts: DataFrame, by: Sequence[str], transformation: str, policies: Sequence[str], document_col: str, fact_col: str) -> DataFrame:
    """by, root, n: a version over a corpus: the transformation, policies, documents and facts it was made of, each under a tag, in order."""
    tagged = lambda tag, c: F.concat(F.lit(f"{tag}\0"), c)
    fixed = F.array(tagged("tv", F.lit(transformation)), *[tagged("pol", F.lit(p)) for p in policies])
    each = F.explode(F.array(tagged("raw", F.col(document_col)), tagged("fact", F.col(fact_col)))).alias("_leaf")
    common = facts.select(*by).distinct().select(*by, F.explode(fixed).alias("_leaf"))  # once for each corpus, not for each fact
    return corpus_root(facts.select(*by, each).unionByName(common), by, "_leaf", prefix=9)


def pins_match(derived: DataFrame, pinned: DataFrame, by: Sequence[str]) -> DataFrame:
    """pinned with status: match, mismatch, or missing where there is no such corpus any more."""
    joined = pinned.join(derived.select(*by, F.col("root").alias("_now")), list(by), "left")
    return joined.withColumn("status", F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("root"), "match").otherwise("mismatch")).drop("_now")
