"""Operator 4: document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash among its s-mers is that of its first or its last
one. That depends on the k-mer alone, so the same passage gives the same anchors in any text and at any
position. Each anchor's hash falls into one of `BINS` bins and each bin keeps its least hash: equal texts have
equal fingerprints, and the share of equal bins estimates the share of common anchors.

Texts shorter than k are one anchor themselves; the empty text has none. The likeness of two empty texts is 1,
of an empty and another one 0. Null texts count as empty. Rows with equal ids are taken in order of their
texts; the row after the last is the first; a single row is its own next. Null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_text

K, S, BINS = 16, 8, 128
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
EMPTY = 0xFFFF
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_anchors long"
_POWER = {n: np.uint64(pow(int(_BASE), n, 1 << 64)) for n in (1, 2, 4, 8)}


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers of a text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < K:
        if not len(c):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return np.zeros(1, np.int64), np.frombuffer(digest, np.uint64)
    h = (c + np.uint64(1)) * _MIX
    for n in (1, 2, 4):  # hashes of 2, 4 and 8 characters from their halves
        h = h[:-n] * _POWER[n] + h[n:]
    kmers = h[:-8] * _POWER[8] + h[8:]
    s = _mix(h)
    span = K - S + 1
    least = s
    for n in (1, 2, 4):
        least = np.minimum(least[:-n], least[n:])
    least = np.minimum(least[: len(s) - span + 1], s[span - 1 :])
    at = np.flatnonzero((s[: len(least)] == least) | (s[span - 1 :] == least))
    return at, _mix(kmers[at] + np.uint64(1))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """For each bin the least hash in it, in 16 bits; EMPTY where there is none."""
    out = np.full(BINS, EMPTY, np.uint16)
    if len(hashes):
        h = np.sort(hashes)
        bins = (h >> np.uint64(57)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        out[bins[first]] = ((h[first] >> np.uint64(20)) % np.uint64(EMPTY)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = int(np.count_nonzero((a != EMPTY) | (b != EMPTY)))
    return float(np.count_nonzero((a == b) & (a != EMPTY))) / either if either else 1.0


def as_text(marks: np.ndarray) -> str:
    return marks.astype(">u2").tobytes().hex()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, n_anchors: a row for each row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t.as_py())[1] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([as_text(sketch(h)) for h in found], pa.string()), pa.array([len(h) for h in found], pa.int64())], names=["doc_id", "fingerprint", "n_anchors"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string, n_anchors long")


def positional_anchors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, position, anchor: a row for each anchor, to match passages by hash and offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                at, h = anchors(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(h.view(np.int64))], names=["doc_id", "position", "anchor"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, position long, anchor long")


def _bucketed(docs: DataFrame) -> tuple[DataFrame, list[int]]:
    """docs with the bucket of its id: ranges of nearly equal row counts, several for each partition."""
    spark = docs.sparkSession
    n = min(2000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = sorted({int(c) for c in cuts})
    literal = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(literal, lambda b: b <= F.col("doc_id"))), F.lit(0))
    return docs.withColumn("bucket", bucket), bounds


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form (last quarter replaced by the next document's start), and their likeness.

    The next document comes from one shuffle of the texts by ranges of ids. Each range also gets the first row
    of the next one; those heads are a row for each range, found by their ids.
    """
    docs, bounds = _bucketed(id_text(df, id_col, text_col))
    least = docs.groupBy("bucket").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("head")).orderBy("bucket").collect()  # a row for each range
    before = {r["head"]: least[i - 1]["bucket"] for i, r in enumerate(least)}
    ids = list(before)
    known = F.coalesce("doc_id", F.lit(-(2**63)))
    moved = F.create_map(*[x for k, v in before.items() for x in (F.lit(k).cast("long"), F.lit(v))]) if before else F.create_map().cast("map<bigint,int>")
    heads = docs.where(known.isin(ids) if -(2**63) in before else F.col("doc_id").isin(ids)).withColumn("bucket", moved[known]).withColumn("head", F.lit(True))
    dealt = docs.withColumn("head", F.lit(False)).unionByName(heads).repartition("bucket").sortWithinPartitions("bucket", "head", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = mine = None  # mine: the row that still waits for its next one
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, b, head in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["bucket"].to_pylist(), batch["head"].to_pylist(), strict=True):
                if b == bucket and mine is None and head:
                    continue
                marks_at = sketch(found := anchors(text)[1])
                if b == bucket and mine is not None:
                    was, whole, marks, n_anchors = mine
                    cut = len(whole) // 4
                    edited = whole[: len(whole) - cut] + text[:cut]
                    other = sketch(anchors(edited)[1]) if edited != whole else marks
                    rows.append((was, len(whole), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(marks), as_text(other), likeness(marks, other), likeness(marks, marks_at), n_anchors))
                bucket, mine = b, None if head else (doc, text, marks_at, len(found))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return dealt.mapInArrow(run, SCHEMA)
