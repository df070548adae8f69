"""A hash tree over the ids of growing corpora: inner nodes by prefix of the ids' digests, stored, so that an append hashes anew only what it changes.

An id stands at its SHA-256; a block holds the ids whose digests share `depth` hexadecimal digits, and a node the blocks or nodes that share one digit less. A
node's hash is that of its parts in order. The tree is a table (by, level, prefix, hash, n, changed): the root is the row of level 0. It does not depend on
the order in which ids came, nor on how many appends they came in. Blocks are even, as digests are; choose the depth for some thousand ids a block (4: up to
some hundred million ids). Null ids are left out, ids that come again change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(ids: DataFrame, by: Sequence[str], id_col: str, fresh: bool) -> DataFrame:
    known = ids.where(F.col(id_col).isNotNull())
    return known.select(*by, F.unhex(F.sha2(F.col(id_col).cast("string"), 256)).alias("_h"), F.lit(fresh).alias("_fresh"))


def _blocks(placed: DataFrame, by: Sequence[str], depth: int) -> DataFrame:
    """Blocks that hold an id which is new to them. Digests are shuffled once, as bytes, to their blocks; there they are made distinct and gathered."""
    sent = placed.withColumn("prefix", _prefix("_h", depth)).repartition(*by, "prefix")
    once = sent.groupBy(*by, "prefix", "_h").agg(F.min("_fresh").alias("_fresh"))
    held = once.groupBy(*by, "prefix").agg(F.array_sort(F.collect_list("_h")).alias("_parts"), F.count("*").alias("n"), F.max("_fresh").alias("changed"))
    text = F.concat_ws("", F.transform("_parts", _hex))
    return held.where("changed").select(*by, F.lit(depth).alias("level"), "prefix", F.sha2(text, 256).alias("hash"), "n", "changed")


def _hex(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def _prefix(digest: str, depth: int) -> Column:
    return F.substring(_hex(F.substring(digest, 1, (depth + 1) // 2)), 1, depth)


def _above(nodes: DataFrame, by: Sequence[str], level: int) -> DataFrame:
    """The changed nodes one level up: sixteen parts at most in each. Only they are hashed."""
    part = F.struct("prefix", "hash")
    held = nodes.groupBy(*by, F.substring("prefix", 1, level).alias("prefix")).agg(F.array_sort(F.collect_list(part)).alias("_parts"), F.sum("n").alias("n"), F.max("changed").alias("changed"))
    text = F.concat_ws("", F.transform("_parts", lambda p: F.concat(p["prefix"], p["hash"])))
    return held.where("changed").select(*by, F.lit(level).alias("level"), "prefix", F.sha2(text, 256).alias("hash"), "n", "changed")


def _newest(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    both = old.withColumn("changed", F.lit(False)).unionByName(new)
    best = F.max(F.struct("changed", "hash", "n")).alias("b")
    return both.groupBy(*by, "level", "prefix").agg(best).select(*by, "level", "prefix", "b.hash", "b.n", "b.changed")


def tree(ids: DataFrame, by: Sequence[str], id_col: str, depth: int = 4) -> DataFrame:
    """The tree of all ids of each corpus. Empty corpora have none."""
    levels = [_blocks(_placed(ids, by, id_col, True), by, depth)]
    for level in range(depth - 1, -1, -1):
        levels.append(_above(levels[-1], by, level))
    return reduce(DataFrame.unionByName, levels)


def grown(old: DataFrame, stored: DataFrame, new: DataFrame, by: Sequence[str], id_col: str, depth: int = 4) -> DataFrame:
    """The tree after an append; `changed` marks the nodes that were hashed for it. Of the stored ids only those of blocks that the append meets are shuffled.

    For a long series of appends write each tree and read it again."""
    fresh = _placed(new, by, id_col, True)
    met = fresh.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], _prefix("_h", depth).alias("_met")).distinct()
    before = _placed(stored, by, id_col, False)
    same: Column = _prefix("_h", depth) == F.col("_met")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    made = _blocks(before.join(met, same, "left_semi").unionByName(fresh), by, depth)
    levels = [_newest(old.where(F.col("level") == depth), made, by)]
    for level in range(depth - 1, -1, -1):
        levels.append(_newest(old.where(F.col("level") == level), _above(levels[-1], by, level), by))
    return reduce(DataFrame.unionByName, levels)


def roots(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, root, n."""
    return nodes.where(F.col("level") == 0).select(*by, F.concat(F.lit("sha256:"), "hash").alias("root"), "n")


def pin(corpora: DataFrame, by: Sequence[str], of: Sequence[str] = ()) -> DataFrame:
    """One root for several corpora (by, root, n), such as all that a specification reads: of, root, n and how many corpora."""
    leaf = F.struct(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("k"), "root")
    held = corpora.groupBy(*of).agg(F.array_sort(F.collect_list(leaf)).alias("_c"), F.sum("n").alias("n"), F.count("*").alias("corpora"))
    text = F.concat_ws("\n", F.transform("_c", lambda c: F.concat_ws("=", c["k"], c["root"])))
    return held.select(*of, F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("root"), "n", "corpora")


def verified(derived: DataFrame, pinned: DataFrame, by: Sequence[str]) -> DataFrame:
    """pinned, if each of its roots is that of the corpus as it is now; otherwise reading it is an error that names the corpus."""
    now = derived.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("root").alias("_now"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.lit(True))
    joined = pinned.join(now, same, "left")
    name = F.concat(F.lit("pin does not match: "), F.to_json(F.struct(*by)) if by else F.lit("corpus"))
    bad = F.raise_error(name).cast("string")
    return joined.withColumn("root", F.when(F.col("root").eqNullSafe(F.col("_now")), F.col("root")).otherwise(bad)).select(*pinned.columns)


def proofs(nodes: DataFrame, stored: DataFrame, asked: DataFrame, by: Sequence[str], id_col: str, depth: int = 4) -> DataFrame:
    """For each asked id (by, id) what proves that it is in the corpus: a row for each level with the parts of the node on its way (of a block: its digests).

    Ids that are not there get rows without themselves among the parts, so `proven` is false, or none at all."""
    ids = asked.select(*by, F.col(id_col).cast("string").alias("id")).distinct().withColumn("_h", F.sha2("id", 256))
    way = ids.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("_p", F.expr("substring(_h, 1, level)"))
    inner = nodes.where(F.col("level") > 0).groupBy(*by, (F.col("level") - 1).alias("level"), F.expr("substring(prefix, 1, level - 1)").alias("_p"))
    parts = inner.agg(F.array_sort(F.collect_list(F.struct(F.col("prefix").alias("at"), "hash"))).alias("parts"))
    wanted = way.where(F.col("level") == depth).select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_p").alias("_w")).distinct()
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[d]) for c, d in zip(by, [f"_by{i}" for i in range(len(by))])], F.lit(True))
    held = _placed(stored, by, id_col, False).withColumn("_h", _hex("_h")).drop("_fresh").distinct().withColumn("_p", F.substring("_h", 1, depth))
    held = held.join(wanted, (F.col("_p") == F.col("_w")) & same(held, wanted), "left_semi")
    blocks = held.groupBy(*by, "_p").agg(F.array_sort(F.collect_list(F.struct(F.col("_h").alias("at"), F.lit("").alias("hash")))).alias("parts"))
    every = parts.unionByName(blocks.withColumn("level", F.lit(depth)))
    other = every.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("level").alias("_l"), F.col("_p").alias("_q"), "parts")
    on = (F.col("level") == F.col("_l")) & (F.col("_p") == F.col("_q")) & same(way, other)
    return way.join(other, on, "left").select(*by, "id", "level", "parts")


def proven(made: DataFrame, root: DataFrame, by: Sequence[str], depth: int = 4) -> DataFrame:
    """by, id, proven: whether the parts of each level hash to what the level above says of them, up to the root (by, root). Needs neither tree nor corpus."""
    digest = F.sha2("id", 256)
    here = F.expr("substring(sha2(id, 256), 1, level + 1)")
    text = F.concat_ws("", F.transform("parts", lambda p: F.concat(p["at"], p["hash"])))
    says = F.when(F.col("level") == depth, F.when(F.exists("parts", lambda p: p["at"] == digest), "")).otherwise(F.get(F.filter("parts", lambda p: p["at"] == here), F.lit(0))["hash"])
    rows = made.select(*by, "id", "level", F.sha2(text, 256).alias("_hash"), says.alias("_says"))
    above = F.lag("_says").over(Window.partitionBy(*by, "id").orderBy("level"))  # depth + 1 rows
    rows = rows.withColumn("_fits", F.coalesce((F.col("level") == 0) | (F.col("_hash") == above), F.lit(False)) & F.col("_says").isNotNull())
    each = rows.groupBy(*by, "id").agg(F.bool_and("_fits").alias("_all"), F.count("*").alias("_n"), F.max(F.when(F.col("level") == 0, F.col("_hash"))).alias("_top"))
    now = root.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("root").alias("_root"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.lit(True))
    right = F.col("_all") & (F.col("_n") == depth + 1) & (F.concat(F.lit("sha256:"), "_top") == F.col("_root"))
    return each.join(now, same, "left").select(*by, "id", F.coalesce(right, F.lit(False)).alias("proven"))
