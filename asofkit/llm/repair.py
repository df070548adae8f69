"""Operator 11: conversation structure repair by a square-root checkpointed dynamic program.

The rows of a conversation, by turn, are edited at the least cost into role initials of the form `(s?(ua)+)?`: a row is kept (0), given the role user or
assistant (1), or deleted (2); an empty user or assistant row may be put in anywhere (5). A row's first fault counts: blank (nothing but blanks) and duplicate
(role and text stand earlier) rows must be deleted, a truncated row (last character that is no blank is none of `.!?`) costs 5 more unless deleted. Of all
cheapest edits those whose initials (D, I, K, R) are ASCII-least are taken.

Four states suffice: at the start, after a system, a user, an assistant row; what is put in or renamed follows from the state. Costs from a place to the end are
a vector of four. Conversations are dealt, in order, to blocks of at most `BLOCK` rows whatever their length, each with its transitions multiplied up (least
sums of 4 x 4 costs). From the products, vectors at the ends of blocks are found backwards; each block, on its own again, keeps vectors at every 64th row only,
recomputes the stretches between them while it walks forward and emits the edits for each of the four states it may be entered in. One pass in order picks the
state. No task holds a conversation: the first steps take rows, the steps by conversation take one short row for each block, and the last one streams rows,
for a digest of a whole text can only be made in order; its memory holds one conversation's edits, a byte each.

Null roles and texts are one blank. Null turns come first; rows of one turn come in order of their roles and of their texts' digests. Rows equal in everything
are counted before they are shuffled. A null conversation id is a conversation; ids that have no rows left (`ids`) get zeros and the digest of nothing. Roles are
told by their first character; an empty role has none and is never kept. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

BLOCK, STRIDE = 4096, 64
BLANKS = " \t\n\x0b\x0c\r"
#: State after a user or assistant row: of the two the one that fits.
GO = (2, 2, 3, 2)
#: State after a kept row by its role's initial; -1: it does not fit.
KEEP = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
INITIALS = "sua"
DELETE, INSERT, RENAME, CUT = 2, 5, 1, 5
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs at the end of a conversation, and the edits still to come there.
END, TAIL = (0, 10, 5, 0), ("", "II", "I", "")
FAR = 1 << 40

Vector = tuple[int, int, int, int]


def _transitions() -> np.ndarray:
    """[code, state before, state after]: cost of rows put in before a row, and of the row. A code is 4 * fault + initial."""
    puts = np.full((4, 4), FAR)
    for s in range(4):
        puts[s, s] = 0
        puts[s, GO[s]] = INSERT
        if GO[GO[s]] != s:
            puts[s, GO[GO[s]]] = 2 * INSERT
    out = np.full((16, 4, 4), FAR)
    for code in range(16):
        row = np.full((4, 4), FAR)
        for s in range(4):
            for _, cost, to in _choices(code, s):
                row[s, to] = min(row[s, to], cost)
        out[code] = (puts[:, :, None] + row[None]).min(1)
    return out


def _choices(code: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) of a row, in the order of the edits' letters."""
    fault, initial = divmod(code, 4)
    out = [("D", DELETE, state)]
    if fault not in (BLANK, DUPLICATE):
        more = CUT if fault == TRUNCATED else 0
        if KEEP[initial][state] >= 0:
            out.append(("K", more, KEEP[initial][state]))
        out.append(("R", RENAME + more, GO[state]))
    return out


CHOICES = [[_choices(code, s) for s in range(4)] for code in range(16)]
TRANSITIONS = _transitions()


def product(codes: bytes) -> np.ndarray:
    """Least costs from each state before the rows to each state after them."""
    m = TRANSITIONS[np.frombuffer(codes, np.uint8)]
    while len(m) > 1:
        odd, m = m[len(m) & ~1 :], m[: len(m) & ~1]
        m = np.concatenate([(m[::2, :, :, None] + m[1::2, None]).min(2), odd])
    return m[0]


def costs_before(code: int, after: Vector) -> Vector:
    b0, b1, b2, b3 = (min(c + after[to] for _, c, to in way) for way in CHOICES[code])
    b2, b3 = min(b2, INSERT + b3), min(b3, INSERT + b2)
    return min(b0, INSERT + b2), min(b1, INSERT + b2), b2, b3


def walks(codes: bytes, after: Vector) -> tuple[list[str], list[int]]:
    """For each state before the rows the ASCII-least of the cheapest edits and the state after; `after`: costs from the rows' end."""
    n, v = len(codes), after
    marks = {n: v}
    for i in range(n - 1, -1, -1):
        v = costs_before(codes[i], v)
        if i % STRIDE == 0:
            marks[i] = v
    states, edits = [0, 1, 2, 3], [[], [], [], []]
    for low in range(0, n, STRIDE):
        high = min(n, low + STRIDE)
        costs = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            costs.append(costs_before(codes[i], costs[-1]))
        costs.reverse()
        for k in range(4):
            state, out = states[k], edits[k]
            for i in range(low, high):
                here, there = costs[i - low], costs[i - low + 1]
                while True:
                    need, ways = here[state], CHOICES[codes[i]][state]
                    if need == DELETE + there[state]:
                        out.append("D")
                        break
                    if need == INSERT + here[GO[state]]:
                        out.append("I")
                        state = GO[state]
                        continue
                    letter, _, state = next(w for w in ways if need == w[1] + there[w[2]])
                    out.append(letter)
                    break
            states[k] = state
    return ["".join(e) for e in edits], states


# in Spark


def _read(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    return rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")
    )


def _order(descending: bool = False) -> list[Column]:
    if descending:
        return [F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("digest").desc()]
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


BLOCKS = "conv_id long, turn long, role string, digest binary, seq long, codes binary, costs binary"
VECTORS = "conv_id long, turn long, role string, digest binary, seq long, codes binary, after binary, cost long"
WALKED = "conv_id long, turn long, role string, digest binary, seq long, edits array<string>, ends array<int>, faults array<long>, cost long"
KEY = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order into blocks of one conversation each."""
    open_, codes, seq = None, bytearray(), 0

    def closed() -> tuple:
        return (*open_, seq, bytes(codes), product(bytes(codes)).tobytes())

    for batch in batches:
        out = []
        for conv, turn, role, digest, n, fault, first in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "digest", "n", "fault", "first")), strict=True):
            if open_ is not None and open_[0] != conv:
                out.append(closed())
                open_, codes, seq = None, bytearray(), seq + 1
            initial = INITIALS.find(role[:1]) if role else -1
            initial = 3 if initial < 0 else initial
            again = 4 * (BLANK if fault == BLANK else DUPLICATE) + initial
            for code, times in ((4 * fault + initial if first else again, 1), (again, n - 1)):
                while times > 0:
                    if open_ is None:
                        open_ = (conv, turn, role, digest)
                    take = min(times, BLOCK - len(codes))
                    codes += bytes([code]) * take
                    times -= take
                    if len(codes) == BLOCK:
                        out.append(closed())
                        open_, codes, seq = None, bytearray(), seq + 1
        yield _batch(out, [*KEY, pa.binary(), pa.binary()], _names(BLOCKS))
    if open_ is not None:
        yield _batch([closed()], [*KEY, pa.binary(), pa.binary()], _names(BLOCKS))


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each conversation from its last to its first: costs from their ends."""
    conv, v = 0, None
    for batch in batches:
        out = []
        for row in zip(*(batch[c].to_pylist() for c in _names(BLOCKS)), strict=True):
            if v is None or row[0] != conv:
                conv, v = row[0], np.array(END)
            before = (np.frombuffer(row[-1], np.int64).reshape(4, 4) + v).min(1)
            out.append((*row[:-1], v.tobytes(), int(before[0])))
            v = before
        yield _batch(out, [*KEY, pa.binary(), pa.binary(), pa.int64()], _names(VECTORS))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in zip(*(batch[c].to_pylist() for c in _names(VECTORS)), strict=True):
            edits, ends = walks(row[5], tuple(np.frombuffer(row[6], np.int64).tolist()))
            faults = np.bincount(np.frombuffer(row[5], np.uint8) >> 2, minlength=4).tolist()
            out.append((*row[:5], edits, ends, faults, row[7]))
        yield _batch(out, [*KEY, pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64()], _names(WALKED))


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks with the edits for each state that they may be entered in."""
    kept = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(kept == "", BLANK).when(F.right(kept, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(TRUNCATED)
    light = rows.select("conv_id", "turn", "role", "digest", fault.alias("fault")).groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("fault").alias("fault"))
    # the earliest turn of a role and text is their first row: a join on all of the key, which no frequent text makes uneven
    firsts = light.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))).alias("least"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t"))
    marked = light.join(firsts.withColumn("t", F.col("least.turn")), same, "left").select("conv_id", "turn", "role", "digest", "n", "fault", F.col("r").isNotNull().alias("first"))
    by = [F.col("conv_id").asc_nulls_first(), *_order()]
    blocks = written(marked.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_packed, BLOCKS))
    last_first = blocks.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order(descending=True), F.col("seq").desc())
    return last_first.mapInArrow(_backwards, VECTORS).repartition("conv_id", "turn", "role", "digest", "seq").mapInArrow(_walked, WALKED)


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long, n_repaired long"
TURNS = "conv_id long, place long, edit string, turn long, role string, text string"
_AUDIT_TYPES = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int64()] * 2
_TURN_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
STEPS = frozenset(("su", "ua", "au"))


class _Conversation:
    """One conversation's rows and edits as they come: counts, digest, repaired rows."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.edit_state, self.cost = conv, 0, 0, None
        self.waiting, self.at, self.audit = deque(), 0, []
        self.low = self.high = self.turn = None
        self.distinct = self.illegal = self.rows = self.repaired = 0
        self.faults, self.initial, self.sha = [0] * 4, None, hashlib.sha256()

    def block(self, edits: list[str], ends: list[int], faults: list[int], cost: int) -> None:
        self.waiting.append(edits[self.edit_state])
        self.audit.append(edits[self.edit_state])
        self.edit_state = ends[self.edit_state]
        self.faults = [a + b for a, b in zip(self.faults, faults, strict=True)]
        if self.cost is None:
            self.cost = cost

    def _edit(self) -> str:
        while self.at == len(self.waiting[0]):
            self.waiting.popleft()
            self.at = 0
        self.at += 1
        return self.waiting[0][self.at - 1]

    def _said(self, edit: str, turn: int | None, role: str, text: str) -> tuple:
        self.sha.update((("\n" if self.repaired else "") + role + ":" + text).encode())
        self.repaired += 1
        return self.conv, self.repaired - 1, edit, turn, role, text

    def _fitting(self) -> str:
        """The role that follows here; the state moves on."""
        self.state = GO[self.state]
        return "user" if self.state == 2 else "assistant"

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        initial = role[:1]
        self.illegal += self.rows > 0 and self.initial + initial not in STEPS
        self.initial, self.rows = initial, self.rows + 1
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            self.distinct += 1
        edit = self._edit()
        while edit == "I":
            yield self._said("I", None, self._fitting(), "")
            edit = self._edit()
        if edit == "R":
            yield self._said("R", turn, self._fitting(), text)
        elif edit == "K":
            self.state = KEEP[INITIALS.find(initial)][self.state]
            yield self._said("K", turn, role, text)

    def end(self) -> Iterator[tuple]:
        for edit in TAIL[self.edit_state]:
            self.audit.append(edit)
            yield self._said(edit, None, self._fitting(), "")

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, *self.faults[1:], self.illegal, self.cost or 0, "".join(self.audit), self.sha.hexdigest(), self.rows, self.repaired)


def _merged(turns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk: _Conversation | None = None
        for batch in batches:
            out: list[tuple] = []
            for kind, conv, turn, role, text, edits, ends, faults, cost in zip(*(batch[c].to_pylist() for c in ("kind", "conv_id", "turn", "role", "text", "edits", "ends", "faults", "cost")), strict=True):
                if kind == 0:
                    if talk is not None:
                        said = list(talk.end())
                        out += said if turns else [talk.summary()]
                    talk = _Conversation(conv)
                elif kind == 1:
                    talk.block(edits, ends, faults, cost)
                else:
                    said = list(talk.row(turn, role, text))
                    if turns:
                        out += said
            yield _batch(out, _TURN_TYPES if turns else _AUDIT_TYPES, _names(TURNS if turns else AUDIT))
        if talk is not None:
            said = list(talk.end())
            yield _batch(said if turns else [talk.summary()], _TURN_TYPES if turns else _AUDIT_TYPES, _names(TURNS if turns else AUDIT))

    return run


def _in_order(rows: DataFrame, ids: DataFrame | None, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    read = _read(rows, conv_col, turn_col, role_col, text_col)
    blocks = _blocks(read).withColumn("kind", F.lit(1)).withColumn("text", F.lit(None).cast("string"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("edits", "array<string>"), ("ends", "array<int>"), ("faults", "array<long>"), ("cost", "long"))]
    heads = (read if ids is None else ids.select(F.col(conv_col).cast("long").alias("conv_id"))).select("conv_id").distinct()
    heads = heads.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.unhex(F.lit("")).alias("digest"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), *none)
    said = read.select("*", F.lit(0).cast("long").alias("seq"), F.lit(2).alias("kind"), *none)
    together = heads.unionByName(blocks).unionByName(said)
    return together.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("kind") > 0, *_order(), "kind", "seq")


def audits(rows: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation (of `ids`, where given): gaps in its turns, faults, steps between roles that are not allowed, the cheapest edits and their cost,
    the digest of the repaired rows."""
    return _in_order(rows, ids, conv_col, turn_col, role_col, text_col).mapInArrow(_merged(False), AUDIT)


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations, a row for each turn: conv_id, place (0, 1, ...), edit (K, R or I), the turn it had, role, text."""
    return _in_order(rows, None, conv_col, turn_col, role_col, text_col).mapInArrow(_merged(True), TURNS)


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with faults put in by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes `.!?` from it, 3 repeats the row, 4 sets the role
    user. Nulls are one blank, in the key as well."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce(F.col("text"), blank)
    read = rows.select("conv_id", "turn", F.coalesce(F.col("role"), blank).alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    changed = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = read.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"))
    return made.drop("_copy")
