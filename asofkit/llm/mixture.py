"""Operator 12: mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Targets: source number i (by code point, null last) weighs `weights[i % len(weights)]`. The mix is `share` times all words; a source gets its part by weight, but
no more than `most` times its own words, and what is above goes to the others by weight until none is above.

Schedule: a source's documents, shuffled by a hash, stand one behind the other and are cut into blocks of `block_words` words. It gets as many slots as bring its
words nearest to its target: whole passes over its blocks, then the first blocks once more. The slots of all sources lie side by side as cumulative weights in
[0, 2^k); the van der Corput points in base 2 (i = 0, 1, ... with its k bits reversed) run through them, so each source comes up evenly and, over all points, in
each of its slots once. A slot's rank among those of its source is how many earlier points fall into the same stretch: a sum over the bits of its two ends, no
window. Slot of rank r takes block r mod n. A document's words in a block are joined to the slots of that block.

Sums and places over all documents are made over ranges of the order, so no source is one task; a source's slots are made in chunks. One row goes to the driver,
the number of slots.

Null texts have no words. A null source is a source, and so is an empty one. Documents without words have their row, with nothing taken. Each row is a
document, also where ids are null or repeated; of rows alike in id, source and text any comes first. Other columns are not looked at. An empty table gives an
empty result. Targets are doubles; words taken differ from them by half a block at most, and the same table gives the same mix again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered, running
from ..shared import written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Slots made from one row at once, and about so many in a task (of at most TASKS).
CHUNK, TASK, TASKS = 1 << 14, 1 << 18, 20_000
#: Copies of each source's row, among which its documents are dealt.
SALTS = 64


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, size (a row for each source). Adds at (its number), weight, target."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    weighed = numbered(sizes, [F.col("source").asc_nulls_last()], "at").withColumn("weight", weight).withColumn("cap", F.col("size") * float(most))
    # in the order of cap / weight the sources that get their caps come first
    ranked = running(weighed, [(F.col("cap") / F.col("weight")).asc(), F.col("at").asc()], {"caps": F.col("cap"), "weights": F.col("weight")})
    total = ranked.agg((F.sum("size") * float(share)).alias("mix"), F.sum("weight").alias("all_weights"))
    capped = F.col("cap") * (F.col("all_weights") - F.col("weights")) <= F.col("weight") * (F.col("mix") - F.col("caps"))
    marked = written(ranked.join(F.broadcast(total)).withColumn("capped", capped))
    left = marked.agg(
        F.coalesce((F.max("mix") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0.0))) / F.sum(F.when(~F.col("capped"), F.col("weight"))), F.lit(0.0)).alias("level")
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("level"), F.col("cap")))
    return marked.join(F.broadcast(left)).select("source", "size", "at", "weight", target.alias("target"))


def _slot_counts(targets: DataFrame, block_words: int) -> DataFrame:
    """Adds blocks (of the source), slots, first_slot (slots of the sources before) and first_word (words of the sources before)."""
    size = F.col("size")
    blocks = F.ceil(size / block_words).cast("long")
    passes = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    rest = F.least(F.round((F.col("target") - passes * size) / block_words).cast("long"), blocks)
    made = targets.withColumn("blocks", blocks).withColumn("slots", passes * blocks + rest)
    return written(running(made, [F.col("at").asc()], {"first_slot": F.col("slots"), "first_word": size}))


def _reversed(n: Column, bits: int) -> Column:
    return sum((F.shiftleft(F.shiftright(n, b).bitwiseAND(F.lit(1)), bits - 1 - b) for b in range(bits)), F.lit(0).cast("long"))


def _earlier(i: Column, end: Column, bits: int) -> Column:
    """How many of the points 0..i-1, bits reversed, lie below an end whose own reversed bits are given."""
    terms = (F.shiftright(end, j).bitwiseAND(F.lit(1)) * F.shiftright(i - end.bitwiseAND(F.lit((1 << j) - 1)) + ((2 << j) - 1), j + 1) for j in range(bits))
    return sum(terms, F.lit(0).cast("long"))


def schedule(sources: DataFrame) -> DataFrame:
    """The slots of sources (at, blocks, slots, first_slot): slot (in order, with gaps), at, rank, block, pass."""
    n = int(sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0])
    bits = max(1, n.bit_length())
    chunks = sources.where("slots > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {CHUNK}"))).alias("_chunk")).repartition(min(TASKS, 1 + n // TASK), "at", "_chunk")
    here = F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least((F.col("_chunk") + 1) * CHUNK, F.col("slots")) - 1))
    ends = [_reversed(F.col("first_slot"), bits).alias("_low"), _reversed(F.col("first_slot") + F.col("slots"), bits).alias("_high")]
    slots = chunks.select("at", "blocks", "first_slot", *ends, "_chunk", "slots").select("at", "blocks", "first_slot", "_low", "_high", here.alias("_n"))
    slots = slots.withColumn("slot", _reversed(F.col("first_slot") + F.col("_n"), bits))
    ranked = slots.withColumn("rank", _earlier(F.col("slot"), F.col("_high"), bits) - _earlier(F.col("slot"), F.col("_low"), bits))
    # not nullable, or a join on it would make the rank again in a filter, its point once for each bit
    block = F.coalesce(F.col("rank") % F.col("blocks"), F.lit(0))
    return ranked.select("slot", "at", "rank", block.alias("block"), F.expr("rank div blocks").alias("pass"))


def _pieces(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, most: float, block_words: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Documents cut at blocks, a row for each (one without a block for documents without words), and the sources."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.col(id_col), text)
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("_key"))
    placed = written(running(light, [F.col("source").asc_nulls_last(), F.col("_key").asc(), F.col("doc_id").asc(), F.col("size").asc()], {"_start": F.col("size"), "_row": F.lit(1).cast("long")}))
    sources = _slot_counts(source_targets(placed.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most), block_words)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    known = sources.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target", "at", "first_word", salts.alias("_salt"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.pmod(F.col("_key"), F.lit(SALTS)) == F.col("_salt"))
    start = F.col("_start") - F.col("first_word")
    # Spark takes exploded rows for few and would broadcast them
    joined = placed.join(known.hint("merge"), same).select("doc_id", "_row", "size", "source_size", "target", "at", start.alias("start"))
    covered = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")))
    cut = joined.select("*", F.explode_outer(covered).alias("block"))
    low, high = F.greatest("start", F.col("block") * block_words), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return cut.withColumn("from_word", low - F.col("start")).withColumn("n_words", high - low), sources


DEFAULTS = {"weights": (5, 2, 1), "share": 1.5, "most": 2.0, "block_words": 64, "seed": 12}


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix in its order: slot, pass, doc_id, from_word, n_words (a slot's words of one or more documents); sorted by slot it is what to train on."""
    pieces, sources = _pieces(docs, id_col, text_col, source_col, **(DEFAULTS | how))
    return schedule(sources).hint("merge").join(pieces, ["at", "block"]).select("slot", "pass", "at", "block", "doc_id", "start", "from_word", "n_words")


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """A row for each document: doc_id, size (words), source_size, target (of its source), taken (its words in the mix, repeats counted)."""
    pieces, sources = _pieces(docs, id_col, text_col, source_col, **(DEFAULTS | how))
    times = schedule(sources).groupBy("at", "block").agg(F.count("*").alias("times"))
    words = F.coalesce(F.sum(F.col("n_words") * F.col("times")), F.lit(0)).cast("long")
    return pieces.join(times.hint("merge"), ["at", "block"], "left").groupBy("_row", "doc_id", "size", "source_size", "target").agg(words.alias("taken")).drop("_row")
