"""Operator 8: suffix-array removal of repeated passages.

Each byte covered by a string of 400 bytes that also starts anywhere else in the corpus is removed; strings are judged on
the input and never cross documents.

Sorting the suffixes of the whole corpus would move each byte hundreds of times, so suffixes are sorted where they can match:

1. Anchors: of the 200-byte strings inside each 400-byte string, the one of least hash (the first of equals). Equal
   400-byte strings have equal anchors at the same place, so a repeat shows as a repeated anchor hash. About one
   position in a hundred is an anchor; rows hold hashes and positions, no text.
2. Around an anchor lie at most 200 bytes before and 400 from it on (its context). Anchors are counted by hash and
   context, pre-aggregated before the shuffle. Where a context occurs twice, all its 400-byte strings repeat: settled. The bytes
   of all settled contexts are verified: those of one hash must have one 128-bit digest (BLAKE2), else the job ends in an error
   rather than remove bytes that do not repeat.
3. Of the other anchors with a repeated hash, one context of each kind goes to the task of its hash. There, the
   suffixes that start at the anchors, and the reversed texts before them, are sorted by mergesort; two suffixes
   are compared through their longest common extension, found by binary search on prefix polynomial hashes. Orders and
   extensions are then verified on the bytes, and sorted by the bytes if a hash collided. A string that starts `a` bytes before
   the anchor repeats if another context shares `a` bytes before and 400 - a from the anchor on.
4. A hash with more than `hot` kinds of context does not go to one task: each of its 400-byte strings becomes a row, by its
   128-bit digest, counted with pre-aggregation.

Anchors learn the counts of their contexts, and strings those of their digests, without a task for all occurrences of a common
one: keys with more than a 100,000th of all rows, fewer than 100,000 by that very count, are sent to all tasks, the others are shuffled.

Null texts count as empty; texts below 400 bytes stay whole. Repeated rows repeat each other. Rows of one id with different texts
are documents of their own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_text, once, written

LENGTH, K = 400, 200
SPAN = LENGTH - K + 1  # k-strings inside a string of LENGTH; LENGTH - K bytes may lie before one
HEAVY = 100_000  # keys sent to all tasks are fewer
HOT = 8192  # contexts of 600 bytes: 5 MB at most go to one task together
NO_ID = -(2**63)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PART = 1 << 22
_LOW = np.uint64((1 << 24) - 1)
_TABLE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # a random value for each byte, so that no text's structure makes sums collide


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    return once(("powers", size), lambda: (_powers(_BASE, size), _powers(_INVERSE, size)))


def _sums(data: np.ndarray) -> np.ndarray:
    """s with (s[j] - s[i]) * base**i the polynomial hash of data[i:j], the same at any place."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _tables(len(data) + 1)[1][: len(data)], dtype=np.uint64)])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors, hashes of their k-strings and of their contexts."""
    n = len(data)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, n - LENGTH + 1, _PART):  # windows that start in [start, start + _PART)
        base = max(0, start - (LENGTH - K))
        part = np.frombuffer(data, np.uint8, min(n, start + _PART + 2 * LENGTH) - base, base)
        power = _tables(len(part) + 1)[0]
        s = _sums(part)
        skip = start - base
        windows = min(n - LENGTH + 1 - start, _PART)
        kh = _mix((s[skip + K : skip + K + windows + SPAN - 1] - s[skip : skip + windows + SPAN - 1]) * power[skip : skip + windows + SPAN - 1])
        least = kh & ~_LOW | np.arange(len(kh), dtype=np.uint64)
        width = 1
        while 2 * width <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:windows], least[SPAN - width : SPAN - width + windows]) & _LOW
        at = least[np.concatenate(([True], least[1:] != least[:-1]))].astype(np.int64)
        pos = at + start
        left, right = np.minimum(pos, LENGTH - K), np.minimum(n - pos, LENGTH)
        context = (s[pos - base + right] - s[pos - base - left]) * power[pos - base - left]
        found.append((pos, kh[at], _mix(_mix(context) + (left * 1000 + right).astype(np.uint64))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pos, h, ctx = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.concatenate(([True], pos[1:] != pos[:-1]))
    return pos[first], h[first], ctx[first]


def anchor_rows(texts: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos, h, ctx of the anchors of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [anchors(t.as_py().encode("utf-8", "surrogatepass")) for t in batch["text"]]
            counts = [len(m[0]) for m in made]
            owner = np.repeat(np.arange(batch.num_rows), counts)
            pos, h, ctx = (np.concatenate([m[i] for m in made]) if made else np.zeros(0, np.uint64) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(owner)), batch["th"].take(pa.array(owner)), pa.array(pos.astype(np.int64)), pa.array(h.astype(np.uint64).view(np.int64)), pa.array(ctx.astype(np.uint64).view(np.int64))], names=["doc_id", "th", "pos", "h", "ctx"])

    return texts.mapInArrow(run, "doc_id long, th long, pos long, h long, ctx long")


class SortedSuffixes:
    """Rows of bytes (padded) sorted within their groups, with the common extension of neighbours."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, group: np.ndarray):
        self.rows, self.size, self.group = rows, size, group
        n, width = rows.shape
        power, inverse = _tables(width + 1)
        self.sums = np.zeros((n, width + 1), np.uint64)
        np.cumsum(_TABLE[rows] * inverse[:width], axis=1, dtype=np.uint64, out=self.sums[:, 1:])
        self.order = self._mergesort()
        self.common = self._verified()

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common prefixes of rows x and y by binary search on prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.sums[x, mid] == self.sums[y, mid]  # both start at 0, so no power is needed
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether row x is below row y; of equal ones, that of the lower index."""
        e = self.extension(x, y)
        at_end = (e == self.size[x]) | (e == self.size[y])
        last = self.rows.shape[1] - 1
        a, b = self.rows[x, np.minimum(e, last)], self.rows[y, np.minimum(e, last)]
        by_size = (self.size[x] < self.size[y]) | (self.size[x] == self.size[y]) & (x < y)
        return np.where(at_end, by_size, a < b)

    def _mergesort(self) -> np.ndarray:
        """Bottom-up, all groups at once: each row finds by binary search how many rows of the neighbouring run are below it."""
        n = len(self.group)
        order = np.arange(n)
        starts = np.flatnonzero(np.concatenate(([True], self.group[1:] != self.group[:-1]))) if n else np.zeros(0, np.int64)
        spans = np.diff(np.append(starts, n))
        first, size = np.repeat(starts, spans), np.repeat(spans, spans)
        place = np.arange(n) - first  # within the group
        width = 1
        while width < spans.max(initial=0):
            mine = place // width
            run = mine * width
            other = np.where(mine % 2 == 0, run + width, run - width)
            low = np.minimum(other, size)
            high = np.minimum(other + width, size)
            base, count = low.copy(), high - low
            lo, hi = np.zeros(n, np.int64), count.copy()
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                below = self.less(order[first[open_] + base[open_] + mid], order[open_])
                lo[open_] = np.where(below, mid + 1, lo[open_])
                hi[open_] = np.where(below, hi[open_], mid)
            target = np.minimum(run, np.where(count > 0, other, run)) + (place - run) + lo
            merged = np.empty(n, np.int64)
            merged[first + target] = order
            order = merged
            width *= 2
        return order

    def _verified(self) -> np.ndarray:
        """Common extension of each sorted row and the one before it (-1 at a group's first), from the bytes themselves."""
        common, ordered = self._by_bytes()
        if not ordered:  # a hash collision led the sort astray
            keys = [(g, r[:s].tobytes(), i) for i, (g, r, s) in enumerate(zip(self.group.tolist(), self.rows, self.size.tolist(), strict=True))]
            self.order = np.array([k[2] for k in sorted(keys)], np.int64)
            common, _ = self._by_bytes()
        return common

    def _by_bytes(self) -> tuple[np.ndarray, bool]:
        o = self.order
        common = np.full(len(o), -1, np.int64)
        if len(o) < 2:
            return common, True
        x, y = o[:-1], o[1:]
        inside = self.group[x] == self.group[y]
        least = np.minimum(self.size[x], self.size[y])
        differs = self.rows[x] != self.rows[y]
        e = np.where(differs.any(axis=1), differs.argmax(axis=1), self.rows.shape[1])
        e = np.minimum(e, least)
        last = np.minimum(e, self.rows.shape[1] - 1)
        right = np.where(e == least, self.size[x] <= self.size[y], self.rows[x, last] < self.rows[y, last])
        common[1:] = np.where(inside, e, -1)
        return common, bool((right | ~inside).all())

    def runs(self, at_least: int) -> np.ndarray:
        """For each row the number of its run of rows that share at_least bytes with their neighbours."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum((self.common < at_least) | (self.common < 0))
        return out


def repeated_starts(group: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """For contexts of some anchors (rows, groups together): which strings that start a = 0..200 bytes before the anchor repeat (rows x 201)."""
    n = len(group)

    def matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(n, width), np.fromiter(map(len, parts), np.int64, n)

    before = SortedSuffixes(*matrix([p[::-1] for p in left], LENGTH - K), group)
    after = SortedSuffixes(*matrix(right, LENGTH), group)
    out = np.zeros((n, SPAN), bool)
    for a in range(SPAN):
        fit = np.flatnonzero((before.size >= a) & (after.size >= LENGTH - a))
        if len(fit) > 1:
            key = after.runs(LENGTH - a)[fit] * (n + 1) + before.runs(a)[fit]
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            out[fit[order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]], a] = True
    return out


def _spans(pos: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges covered by the strings that start a bytes before pos, for the a with starts[a]."""
    a = np.flatnonzero(starts)
    if not len(a):
        return []
    cut = np.flatnonzero(np.diff(a) > 1)
    return [(pos - int(a[hi]), pos - int(a[lo]) + LENGTH) for lo, hi in zip([0, *(cut + 1)], [*cut, len(a) - 1], strict=True)]


_EMIT = "kind int, key binary, digest binary, h long, doc_id long, th long, pos long, before binary, after binary, settled boolean"
_SPANS = "doc_id long, th long, start long, stop long"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts (kind 0) for sorting by hash, single strings (kind 1) of hot hashes, digests of settled contexts (kind 2) to verify."""
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())
    names = [x.split()[0] for x in _EMIT.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 10, kinds, strict=True)], names=names)

    for batch in batches:
        rows: list[tuple] = []
        for doc, th, text, marks in zip(batch["doc_id"].to_pylist(), batch["th"].to_pylist(), batch["text"], batch["marks"].to_pylist(), strict=True):
            if not marks:
                continue
            data = text.as_py().encode("utf-8", "surrogatepass")
            singles: set[int] = set()
            for m in marks:
                pos = m["pos"]
                if m["settled"]:
                    left = min(pos, LENGTH - K)
                    digest = hashlib.blake2b(data[pos - left : pos + LENGTH], digest_size=16, salt=left.to_bytes(2, "little")).digest()
                    rows.append((2, struct.pack("<qq", m["h"], m["ctx"]), digest, 0, doc, th, pos, None, None, True))
                if not m["emit"]:
                    continue
                if m["hot"]:
                    singles.update(range(max(0, pos - (LENGTH - K)), min(pos, len(data) - LENGTH) + 1))
                else:
                    rows.append((0, None, None, m["h"], doc, th, pos, data[max(0, pos - (LENGTH - K)) : pos], data[pos : pos + LENGTH], m["settled"]))
            for s in sorted(singles):
                rows.append((1, hashlib.blake2b(data[s : s + LENGTH], digest_size=16).digest(), None, 0, doc, th, s, None, None, False))
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
            if len(rows) >= 5_000:
                yield out(rows)
                rows = []
        yield out(rows)


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans from contexts in order of their hash; whole groups are sorted together, some thousand rows at a time."""
    held: list[tuple] = []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        spans: list[tuple] = []
        if len(rows) > 1:
            group = np.array([r[0] for r in rows], np.int64)
            found = repeated_starts(group, [r[4] for r in rows], [r[5] for r in rows])
            for i in np.flatnonzero(found.any(axis=1)).tolist():
                if not rows[i][6]:
                    spans += [(rows[i][1], rows[i][2], a, b) for a, b in _spans(rows[i][3], found[i])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*spans, strict=True)) or [()] * 4], names=["doc_id", "th", "start", "stop"])

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("h", "doc_id", "th", "pos", "before", "after", "settled")]
        for row in zip(*columns, strict=True):
            if len(held) >= 3000 and row[0] != held[-1][0]:
                yield out(held)
                held = []
            held.append(row)
    yield out(held)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        rows: list[tuple] = []
        for doc, text, marks, spans in zip(batch["doc_id"].to_pylist(), batch["text"], batch["marks"].to_pylist(), batch["spans"].to_pylist(), strict=True):
            data = text.as_py().encode("utf-8", "surrogatepass")
            n = len(data)
            ranges = [(s["start"], s["stop"]) for s in spans or ()]
            for m in marks or ():
                if m["settled"]:
                    a, b = max(0, m["pos"] - (LENGTH - K)), min(n, m["pos"] + LENGTH)
                    if b - a >= LENGTH:
                        ranges.append((a, b))
            kept, at, gone, runs, stop = [], 0, 0, 0, -1
            for a, b in sorted(ranges):
                if a > stop:
                    runs += 1
                    kept.append(data[at:a])
                    gone += b - a
                    at = stop = b
                elif b > stop:
                    gone += b - stop
                    at = stop = b
            kept.append(data[at:])
            left = b"".join(kept)
            rows.append((doc, n, gone, runs, hashlib.sha256(left).hexdigest(), left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names=names)


def counted_join(rows: DataFrame, keys: DataFrame, on: list[str], total: int, least: int) -> DataFrame:
    """rows with the columns of keys, which are unique by `on` and hold in n how many of the rows have the key; `total` is at least the number of all rows. Rows of keys
    with n above `least` and total / HEAVY (so fewer than HEAVY keys) are not shuffled."""
    heavy = F.col("n") > max(least, total // HEAVY)
    sent = F.broadcast(keys.where(heavy))
    return rows.join(sent, on).unionByName(rows.join(sent.select(*on), on, "left_anti").join(keys.where(~heavy), on))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, least: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, which may cut a character)."""
    texts = id_text(df, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("th", F.xxhash64("text"))
    found = written(anchor_rows(texts.where(F.octet_length("text") >= LENGTH)))
    kinds = found.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("first"))
    hashes = kinds.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    repeated = written(kinds.join(hashes, "h").select("h", "ctx", "n", "first", "kinds"))
    here = counted_join(found, repeated, ["h", "ctx"], found.count(), least)
    settled = F.col("n") > 1
    emit = (F.col("kinds") > 1) & (~settled | (F.struct("doc_id", "th", "pos") == F.col("first")))
    mark = F.struct("pos", "h", "ctx", settled.alias("settled"), emit.alias("emit"), (F.col("kinds") > hot).alias("hot"))
    marks = here.select("doc_id", "th", mark.alias("m")).where("m.settled or m.emit").groupBy("doc_id", "th").agg(F.collect_set("m").alias("marks"))
    marks = written(marks)
    strings = SPAN * (marks.agg(F.sum(F.size(F.filter("marks", lambda m: m["hot"] & m["emit"])))).first()[0] or 0)  # at most so many of kind 1
    joined = texts.join(marks, ["doc_id", "th"], "left")
    sent = joined.mapInArrow(_contexts, _EMIT)
    contexts = sent.where("kind = 0").select("h", "doc_id", "th", "pos", "before", "after", "settled")
    sorted_spans = contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_spans, _SPANS)
    singles = sent.where("kind > 0")
    counted = singles.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("digest").alias("least"), F.max("digest").alias("most"))
    collided = F.raise_error(F.lit("two contexts of one hash have different bytes")).cast("boolean")
    common = counted.where(F.when(F.col("least") < F.col("most"), collided).otherwise((F.col("kind") == 1) & (F.col("n") > 1))).select("key", "n")
    single_spans = counted_join(singles.where("kind = 1").select("key", "doc_id", "th", "pos"), common, ["key"], strings, least).select("doc_id", "th", F.col("pos").alias("start"), (F.col("pos") + LENGTH).alias("stop"))
    spans = sorted_spans.unionByName(single_spans).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    done = joined.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "marks", "spans").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
