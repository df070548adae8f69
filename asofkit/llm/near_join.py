"""Operator 5: n-gram Jaccard join with Bayesian candidate pruning.

A text's shingles are its runs of five words (lower case, split at white space); a text of one to four words is
one shingle. Two texts are linked if the Jaccard similarity of their shingle sets is at least 0.8.

1. Texts with equal sets form a class; one row stands for each class, copies are not paired.
2. MinHash bands (40 of 5) put classes into buckets. A pair at 0.8 misses all buckets with probability 1e-7, the
   one chance this operator takes beside the tolerance below. Buckets with the same members are one bucket.
3. A bucket's members are dealt into blocks, and each pair of blocks is a group of bounded size, so that no
   bucket lands in one task. Within a group MinHash values are compared in steps; a pair whose posterior
   probability of reaching the threshold (uniform prior) falls below the tolerance is dropped. What is left is
   verified exactly on the shingle sets, in the least bucket that both share, so that a link counts once.
4. A group gives for each class its number of links and the least class it is connected to: rows grow with the
   members, not with the pairs. Connected components over these edges give groups of near duplicates.

Null and empty texts have no shingles: no links, one class, and each its own group. Repeated rows are copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Memo, id_text, sliced, written

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP = 40, 5, 25
HASHES = BANDS * ROWS
BLOCK = 256
NO_ID = -(2**63)  # stands for a null id inside
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * _BASE)
_A, _B = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32)


def _word_hashes(memo: int = 150_000):
    """Hashes of words, for use within one task."""
    return Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), memo).__getitem__


def shingles(text: str, word_hash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.lower().split()
    w = np.fromiter(map(word_hash, words), np.uint64, len(words))
    if not len(w):
        return w
    n = min(WORDS, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * _BASE + w[i : i + len(h)]
    return np.unique(_mix(h))


def signature(shingle_set: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    h = (shingle_set >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 2048):
        np.minimum(out, (h[at : at + 2048, None] * _A[None, :] + _B[None, :]).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        keys = _mix(keys * _BASE + column.astype(np.uint64))
    return keys.view(np.int64)


def class_of(shingle_set: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest()


def least_matches(threshold: float = THRESHOLD, tolerance: float = 1e-6) -> list[int]:
    """For each step the least number of equal values at which the similarity may still reach the threshold.

    After c of m equal values the posterior is Beta(c + 1, m - c + 1); its tail above t is a binomial sum.
    """
    out = []
    for m in range(STEP, HASHES + 1, STEP):
        tail = 0.0
        for c in range(m + 1):
            tail += comb(m + 1, c) * threshold**c * (1 - threshold) ** (m + 1 - c)
            if tail >= tolerance:
                out.append(c)
                break
    return out


def text_hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def signed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, cls (of the shingle set), n_shingles, bands (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = _word_hashes()
        for batch in sliced(batches):
            sets = [shingles(t.as_py(), word_hash) for t in batch["text"]]
            bands = [band_keys(signature(s)) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array([class_of(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "cls", "n_shingles", "bands"])

    texts = id_text(df, id_col, text_col).withColumn("text_hash", text_hash(F.col("text")))
    return texts.mapInArrow(run, "doc_id long, text_hash binary, cls binary, n_shingles long, bands array<long>")


class _Group:
    """Members of two blocks of a bucket (or of one), compared pair by pair."""

    def __init__(self, rows: list[tuple], key: int, same: bool, least: list[int], threshold: float):
        self.cls, self.size, sig, sets, keys, self.block = zip(*rows, strict=True)
        self.sig = np.frombuffer(b"".join(sig), np.uint32).reshape(len(rows), HASHES)
        self.raw, self.sets, self.keys = sets, [None] * len(rows), [None] * len(rows)
        self.raw_keys, self.key, self.same, self.least, self.threshold = keys, key, same, least, threshold

    def _set(self, i: int) -> frozenset:
        if self.sets[i] is None:
            self.sets[i] = frozenset(np.frombuffer(self.raw[i], np.uint64).tolist())
            self.keys[i] = frozenset(self.raw_keys[i])
        return self.sets[i]

    def links(self) -> Iterator[tuple[int, int]]:
        n = len(self.cls)
        blocks = np.array(self.block)
        for a in range(n - 1):
            others = np.arange(a + 1, n)
            if not self.same:
                others = others[blocks[a + 1 :] != blocks[a]]
            matches = np.zeros(len(others), np.int64)
            for step, least in enumerate(self.least):
                if not len(others):
                    break
                part = slice(step * STEP, (step + 1) * STEP)
                matches = matches + np.count_nonzero(self.sig[others, part] == self.sig[a, part], axis=1)
                keep = matches >= least
                others, matches = others[keep], matches[keep]
            for b in others.tolist():
                x, y = self._set(a), self._set(b)
                if min(self.keys[a] & self.keys[b]) != self.key:
                    continue
                common = len(x & y)
                if common >= self.threshold * (len(x) + len(y) - common) - 1e-9:
                    yield a, b

    def rows(self) -> Iterator[tuple]:
        """(cls, documents linked, classes linked, least class connected) of each class with links here."""
        n = len(self.cls)
        parent, docs, classes = list(range(n)), [0] * n, [0] * n

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for a, b in self.links():
            docs[a] += self.size[b]
            docs[b] += self.size[a]
            classes[a] += 1
            classes[b] += 1
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)  # rows are in order of cls
        for i in range(n):
            if classes[i]:
                yield self.cls[i], docs[i], classes[i], self.cls[root(i)]


def _linked(dealt: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    least = least_matches(threshold, tolerance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        name = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["cls", "docs", "classes", "root"])

        def closed() -> list[tuple]:
            return list(_Group(held, name[0], name[1] == name[2], least, threshold).rows()) if len(held) > 1 else []

        for batch in sliced(batches):
            ready: list[tuple] = []
            columns = [batch[c].to_pylist() for c in ("key", "i", "j", "cls", "size", "sig", "shingles", "keys", "own")]
            for key, i, j, *row in zip(*columns, strict=True):
                if (key, i, j) != name:
                    ready += closed()
                    held, name = [], (key, i, j)
                held.append(tuple(row))
            yield out(ready)
        if held:
            yield out(closed())

    return dealt.mapInArrow(run, "cls binary, docs long, classes long, root binary")


def components(edges: DataFrame, salts: int = 16) -> DataFrame:
    """node, root (least node of its component) for edges (u, v), by alternating large and small stars until nothing changes.

    Each round joins components, so the rounds follow the logarithm of the longest path; there is no limit. The neighbours of a node are dealt to `salts` groups, so
    that the centre of a star is no single task."""
    edges = written(edges.select("u", "v").where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)))
        parts = both.groupBy("u", "s").agg(F.min("v").alias("m"))
        least = parts.groupBy("u").agg(F.least(F.first("u"), F.min("m")).alias("least"))
        centres = parts.select("u", "s").join(least, "u")
        large = both.where("v > u").join(centres, ["u", "s"]).select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _small(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = 1e-6, broadcast_rows: int = 200_000) -> DataFrame:
    """A row for each row of df: doc_id, n_shingles, class_id (least id with the same shingle set), class_size,
    n_links (other documents at the threshold or above, copies among them), n_class_links, group_id (least id of
    the group of near duplicates)."""
    return judged(df, id_col, text_col, threshold, tolerance, broadcast_rows).drop("text_hash", "stays")


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = 1e-6, broadcast_rows: int = 200_000) -> DataFrame:
    """The columns of near_duplicates, text_hash, and stays: whether the row has the least id and text hash of its group (a null
    id is the least; rows without shingles are each their own group)."""
    texts = id_text(df, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    marks = written(signed(texts))
    classes = written(marks.groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("class_size"), F.min("n_shingles").alias("n_shingles")))
    one = marks.join(classes.where("n_shingles > 0").select("cls", F.col("class_id").alias("doc_id")), ["cls", "doc_id"]).dropDuplicates(["cls"])
    entries = one.select("cls", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s"), F.min("cls").alias("m")).where("n > 1")
    buckets = written(buckets.groupBy("n", "s", "m").agg(F.min("key").alias("key")).select("key", "n"))
    members = written(entries.join(F.broadcast(buckets) if _small(buckets, broadcast_rows) else buckets, "key"))
    wanted = members.groupBy("cls").agg(F.collect_list("key").alias("keys")).join(classes, "cls").select(F.col("class_id").alias("doc_id"), "cls", "keys", F.col("class_size").alias("size"))
    wanted = written(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = _word_hashes()
        for batch in sliced(batches):
            made = [shingles(t.as_py(), word_hash) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in made], pa.binary()), pa.array([signature(s).tobytes() for s in made], pa.binary()), pa.array([s.tobytes() for s in made], pa.binary()), batch["cls"], batch["keys"], batch["size"]], names=["made", "sig", "shingles", "cls", "keys", "size"])

    few = _small(wanted, broadcast_rows)
    own = texts.join(F.broadcast(wanted) if few else wanted, "doc_id").select("text", "cls", "keys", "size")
    own = own.mapInArrow(sets, "made binary, sig binary, shingles binary, cls binary, keys array<long>, size long").where("made = cls").drop("made").dropDuplicates(["cls"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).select("key", "cls", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "own").join(own, "cls")
    found = written(_linked(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cls"), threshold, tolerance))
    links = found.groupBy("cls").agg(F.sum("docs").alias("docs"), F.sum("classes").alias("classes"))
    roots = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cls"), "root")
    grouped = classes.join(links, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = grouped.groupBy("root").agg(F.min("class_id").alias("group_id"), F.min("first").alias("group_first"))
    by_class = grouped.join(least, "root").select("cls", "class_id", "class_size", "group_id", "group_first", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("classes", F.lit(0)).alias("n_class_links"))
    some = F.col("n_shingles") > 0
    own = lambda c, name: F.nullif(c, F.lit(NO_ID)).alias(name)
    stays = ~some | (F.struct("doc_id", "text_hash") == F.col("group_first"))
    return marks.select("doc_id", "text_hash", "cls", "n_shingles").join(by_class, "cls").select(own(F.col("doc_id"), "doc_id"), "n_shingles", own(F.col("class_id"), "class_id"), "class_size", F.when(some, F.col("class_size") - 1 + F.col("docs")).otherwise(0).alias("n_links"), "n_class_links", own(F.when(some, F.col("group_id")).otherwise(F.col("doc_id")), "group_id"), "text_hash", stays.alias("stays"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", broadcast_rows: int = 200_000, text_col: str = "text", **options) -> DataFrame:
    """docs with one row, the one of least id and then text hash, of each group of near duplicates; all columns stay.

    Rows are judged by their id and text together, so rows that share an id (or have none) stay if their texts are no near
    duplicates. Of rows with the same id and text one stays; those without shingles all stay."""
    marks = judged(docs, id_col, text_col, broadcast_rows=broadcast_rows, **options)
    marks = written(marks.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays", (F.col("n_shingles") > 0).alias("some")))
    gone = marks.where("not stays").select("_id", "_hash").distinct()
    repeated = marks.where("stays and some").groupBy("_id", "_hash").count().where("count > 1").select("_id", "_hash")
    own, text = (next(c for i in range(len(docs.columns) + 1) if (c := f"_{name}{i}").lower() not in {x.lower() for x in docs.columns}) for name in ("own", "text"))
    keyed = docs.withColumn(own, F.col(id_col).cast("long")).withColumn(text, text_hash(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))

    def joined(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(keys) if _small(keys, broadcast_rows) else keys, rows[own].eqNullSafe(keys["_id"]) & (rows[text] == keys["_hash"]), how)

    kept = joined(keyed, gone, "left_anti")
    if not repeated.isEmpty():
        kept = joined(kept, repeated, "left_anti").unionByName(joined(kept, repeated, "left_semi").dropDuplicates([own, text]))
    return kept.drop(own, text)
