"""Operator 13: source divergence audit by length-bucketed packing of terms.

For each language, how the shares of its terms differ between its sources, and which terms a source uses more than its language does.

Terms are runs of letters A-Z and of characters beyond ASCII, only A-Z in lower case. Within a task the bytes of many texts are cut into terms at once and the
terms are packed by length: up to 8 bytes into one uint64, up to 16 into two (bytes in order, zeros behind; no term holds a zero byte), and each bucket is
sorted by radix, 16 bits at a time, together with the group (lang, source) of its documents; runs are counted. Longer terms are a bucket of their own, sorted
by their bytes. Spark adds up the counts by (lang, source, term), combining before it shuffles.

A language keeps the terms that occur in at least `min_docs` of its documents. A group's share of a term is 1 + floor(1e9 (count + 1) / (N + V)): N its
occurrences of kept terms, V the number of kept terms. f(p, q) = floor((p - q)^2 / q). All numbers are exact integers: the quotient is made in three steps of
1000, which stay below 2^63 up to 9e15 occurrences of a language, and all sums of f do so as well (shares add up to about 1e9).

Kept terms are dealt by hash to `buckets` buckets a language, so a language that holds most rows is many tasks; each sums f over its own terms for all pairs of
sources and keeps the `top` terms of each source. Only terms that occur in one of two sources are computed one by one; for the others f is the same. One row of
a bucket holds the sources of its language (the result has a row for each pair of them). Buckets are added up, and ranked within a group.

Null texts, languages and sources are empty ones. Each row is a document, repeated rows too. A group without terms has its rows; a language without kept terms
gives pairs of value 0 and no terms. Equal values rank by the item's UTF-8 bytes. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Bytes of text that are cut into terms at once, within a batch. A longer text is taken whole.
SLICE = 4 << 20
COUNTS = "lang string, source string, term string, n long, docs long"
#: Bytes of terms, and what they become.
_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def radix_order(*words: np.ndarray) -> np.ndarray:
    """The stable order of rows by unsigned words, the most significant first: counting sorts of 16 bits each, from the last digit."""
    order = None
    for word in reversed(words):
        digits = word.view(np.uint16).reshape(len(word), -1)  # little-endian: the last digit comes first
        for k in range(digits.shape[1]):
            digit = digits[:, k] if order is None else digits[order, k]
            if len(digit) and digit.min() == digit.max():
                continue
            by = np.argsort(digit, kind="stable")
            order = by if order is None else order[by]
    return np.arange(len(words[0])) if order is None else order


def runs(order: np.ndarray, keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order: where runs of equal keys begin, their lengths, and how many documents are in each (documents ascend within a run)."""
    n = len(order)
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        sorted_ = k[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    doc = docs[order]
    fresh = new.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, n)), np.add.reduceat(fresh.astype(np.int64), at) if n else np.zeros(0, np.int64)


def counted(data: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> list[tuple[np.ndarray, list | np.ndarray, np.ndarray, np.ndarray]]:
    """data: bytes of texts one behind the other; starts: where each begins, and the end; groups: the group of each. For each bucket of lengths: groups, terms,
    occurrences, documents."""
    data = _LOWER[data]
    inside = np.concatenate([[False], _IS_TERM[data], [False]])
    # a text's first byte begins a term even if the text before ends in one
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    doc = np.searchsorted(starts, begin, "right") - 1
    length = end - begin
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def word(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Up to 8 bytes from each place as one number, the first byte on top."""
        empty = (8 - size).astype(np.uint64) * np.uint64(8)
        return windows[at].view(">u8")[:, 0].astype(np.uint64) >> empty << empty

    out = []
    for low, high in ((1, 8), (9, 16)):
        rows = np.flatnonzero((length >= low) & (length <= high))
        if not len(rows):
            continue
        at, size, doc_of = begin[rows], length[rows], doc[rows]
        words = [word(at, np.minimum(size, 8))] + ([word(at + 8, size - 8)] if high > 8 else [])
        group = groups[doc_of].astype(np.uint32)
        order = radix_order(group, *words)
        first, n, docs = runs(order, [group, *words], doc_of)
        kept = order[first]
        packed = np.stack([w[kept] for w in words], 1).astype(">u8")  # the first byte in front again
        out.append((group[kept], packed.view(f"S{8 * len(words)}")[:, 0], n, docs))
    rows = np.flatnonzero(length > 16)
    if len(rows):
        terms = [data[a:b].tobytes() for a, b in zip(begin[rows].tolist(), end[rows].tolist(), strict=True)]
        held: dict[tuple[int, bytes], list[int]] = {}
        for g, d, term in sorted(zip(groups[doc[rows]].tolist(), doc[rows].tolist(), terms, strict=True), key=lambda r: (r[0], r[2], r[1])):
            n = held.setdefault((g, term), [0, 0, -1])
            n[:] = n[0] + 1, n[1] + (n[2] != d), d
        out.append((np.array([g for g, _ in held]), [t for _, t in held], np.array([n[0] for n in held.values()]), np.array([n[1] for n in held.values()])))
    return out


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        group = pa.StructArray.from_arrays([batch["lang"], batch["source"]], ["lang", "source"])
        names: dict[tuple[str, str], int] = {}
        of = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in group.to_pylist()])
        langs, sources = pa.array([g[0] for g in names], pa.string()), pa.array([g[1] for g in names], pa.string())
        text = batch["text"].cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        # one row without a term for each group, so that groups without terms stay
        yield _rows(langs, sources, pa.array([""] * len(names), pa.string()), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64))
        for low, high in _slices(offsets):
            a, b = int(offsets[low]), int(offsets[high])
            for groups, terms, n, docs in counted(data[a:b], offsets[low : high + 1] - a, of[low:high]):
                at = pa.array(groups.astype(np.int64))
                yield _rows(langs.take(at), sources.take(at), pa.array(terms, pa.binary()).cast(pa.string()), n, docs)


def _rows(lang: pa.Array, source: pa.Array, term: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it). Each group has a row without a term as well: '', 0, 0."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    return read.mapInArrow(_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """1 + floor(1e9 count / size), exactly, for 0 < count <= size < 9e15."""
    out, rest = np.zeros(np.broadcast(count, size).shape, np.int64), np.asarray(count, np.int64)
    for _ in range(3):
        q, rest = np.divmod(rest * 1000, size)
        out = out * 1000 + q
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Bucket:
    """Sums over the terms of one bucket of a language."""

    def __init__(self, lang: str, bucket: int, sources: pa.Array, sizes: np.ndarray, v: int, top: int):
        self.lang, self.bucket, self.sources, self.top, self.v = lang, bucket, sources, top, v
        self.size = sizes + v  # N + V of each source
        self.whole = int(sizes.sum()) + v
        k = len(sizes)
        self.none = shares(np.ones(k, np.int64), self.size) if v else np.ones(k, np.int64)
        self.base = divergence(self.none[:, None], self.none[None]) if v else np.zeros((k, k), np.int64)
        self.sums, self.best = np.zeros((k, k), np.int64), [[] for _ in range(k)]

    def add(self, terms: pa.Array, lists: pa.ListArray) -> None:
        k = len(self.size)
        step = max(1, (1 << 21) // k)
        for low in range(0, len(terms), step):
            part = lists.slice(low, step)
            owners, held = pc.list_parent_indices(part).to_numpy(), part.flatten()
            counts = np.zeros((len(part), k), np.int64)
            counts[owners, pc.index_in(held.field("source"), value_set=self.sources).to_numpy()] = held.field("n").to_numpy()
            self._add(terms.slice(low, step), counts)

    def _add(self, terms: pa.Array, counts: np.ndarray) -> None:
        p = shares(counts + 1, self.size[None])
        q = shares(counts.sum(1) + 1, self.whole)
        for g in range(len(self.size)):
            rows = np.flatnonzero(counts[:, g])
            if not len(rows):
                continue
            others, mine = p[rows], p[rows, g][:, None]
            self.sums[g] += divergence(mine, others).sum(0) - len(rows) * self.base[g]
            absent = counts[rows] == 0
            self.sums[:, g] += (divergence(self.none[None], mine) * absent).sum(0) - self.base[:, g] * absent.sum(0)
            mine, more = mine[:, 0], q[rows]
            over = np.flatnonzero(mine > more)
            f = divergence(mine[over], more[over])
            if len(f) > self.top:
                kept = f >= np.partition(f, len(f) - self.top)[len(f) - self.top]
                over, f = over[kept], f[kept]
            best = self.best[g]
            best += zip((-f).tolist(), [t.encode() for t in terms.take(pa.array(rows[over])).to_pylist()], strict=True)
            if len(best) > 8 * self.top:
                self.best[g] = heapq.nsmallest(self.top, best)

    def rows(self) -> Iterator[tuple[str, str, str, str, int]]:
        names, whole = self.sources.to_pylist(), self.sums + (self.base * self.v if self.bucket == 0 else 0)
        for g, source in enumerate(names):
            for h, other in enumerate(names):
                if g != h:
                    yield self.lang, source, "pair", other, int(whole[g, h])
            for f, term in heapq.nsmallest(self.top, self.best[g]):
                yield self.lang, source, "term", term.decode(), -f


RESULT = "lang string, source string, part string, item string, value long"
_RESULT_TYPES = [pa.string()] * 4 + [pa.int64()]


def _summed(top: int):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RESULT_TYPES, strict=True)], names=["lang", "source", "part", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: _Bucket | None = None
        for batch in batches:
            heads = np.flatnonzero(batch["kind"].to_numpy() == 0).tolist()
            low = 0
            for at in [*heads, batch.num_rows]:
                if at > low:
                    bucket.add(batch["term"].slice(low, at - low), batch["sources"].slice(low, at - low))
                if at < batch.num_rows:
                    if bucket is not None:
                        yield batch_of(list(bucket.rows()))
                    held = batch["sources"].slice(at, 1).flatten()
                    bucket = _Bucket(batch["lang"][at].as_py(), batch["bucket"][at].as_py(), held.field("source"), held.field("n").to_numpy(), batch["v"][at].as_py(), top)
                    low = at + 1
        if bucket is not None:
            yield batch_of(list(bucket.rows()))

    return run


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200, buckets: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: the other sources of the language by the sum of f over its kept terms; part `term`: the `top` terms of the
    source by f against its language, among those whose share is above the language's."""
    counts = term_counts(docs, text_col, lang_col, source_col)
    held = F.struct("source", "n")
    terms = written(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(held).alias("sources")).where((F.col("term") == "") | (F.col("docs") >= min_docs)))
    kept = terms.where("term <> ''")
    sizes = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n"))
    groups = terms.where("term = ''").select("lang", F.explode("sources.source").alias("source"))
    n = groups.join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    langs = n.groupBy("lang").agg(F.sort_array(F.collect_list(held)).alias("sources")).join(v, "lang", "left")
    heads = langs.select("lang", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(0).alias("kind"), F.lit("").alias("term"), "sources", F.coalesce("v", F.lit(0)).alias("v"))
    rows = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).alias("kind"), "term", "sources", F.lit(0).cast("long").alias("v"))
    dealt = heads.unionByName(rows).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", "kind")
    parts = dealt.mapInArrow(_summed(top), RESULT)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    made = pairs.unionByName(parts.where("part = 'term'"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc()))
    return made.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
