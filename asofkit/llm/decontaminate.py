"""Operator 3: benchmark decontamination by pigeonhole edit matching.

A document is contaminated by a test item if some stretch of it is within the item's error budget (insertions,
deletions, substitutions) of the whole item. An item of n characters has a budget of floor(rate * n), less if
its pieces would get shorter than `min_piece`. It is split into budget + 1 pieces: a stretch within the
budget holds one of them unchanged. An Aho-Corasick automaton finds all exact piece hits in a document in one
pass; around each hit, Myers' bit-parallel distance verifies the whole item. Texts and items are compared in
lower case with runs of white space as one blank.

Items come from a table whose size is checked: they go to the tasks in blocks of at most `block_chars`
characters, one pass over the documents for each block, so memory is bounded for any number of items.

Items and texts are normalised by one function (`normal`), so all kinds of blanks count alike. An item shorter than
`min_item` characters in that form is found only where it is a whole document: inside longer texts its chance matches are no
leaks (`short_items` lists them). Null items, empty ones and those of blanks match nothing. Items of equal text each get their rows. Null
and empty documents match nothing. Repeated documents each get their rows; other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_text, once, sliced

SCHEMA = "doc_id long, item_id long, distance int, match_end long, n_chars long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(n: int, rate: float, min_piece: int) -> int:
    return max(0, min(int(rate * n), n // min_piece - 1))


def pieces_of(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length."""
    n, k = len(item), errors + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks_of(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int]:
    """Least edit distance of the pattern to a stretch of text, and where the first such stretch ends; limit + 1 if above limit."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = limit + 1, -1
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _merged(spans: list[tuple[int, int]], errors: int) -> Iterator[tuple[int, int]]:
    """Stretches of text that hold all spans; spans come in order of their ends, nearly in order of their starts."""
    low, high = spans[0]
    for a, b in spans[1:]:
        if low - errors <= a <= high:
            low, high = min(low, a), max(high, b)
        else:
            yield low, high
            low, high = a, b
    yield low, high


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float, min_piece: int, min_item: int = 0):
        """items: ids and normalised texts, none empty."""
        import ahocorasick

        self.short: dict[str, list[int]] = {}
        for i, t in items:
            if len(t) < min_item:
                self.short.setdefault(t, []).append(i)
        self.items = [(i, t, budget(len(t), rate, min_piece), masks_of(t)) for i, t in items if len(t) >= min_item]
        where: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text, errors, _) in enumerate(self.items):
            for offset, piece in pieces_of(text, errors):
                where.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self.automaton.add_word(piece, (len(piece), tuple(owners)))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end of the match) of each item found in the normalised text."""
        out = [(i, 0, len(text)) for i in self.short.get(text, ())]
        if not self.items:
            return out
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (length, owners) in self.automaton.iter(text):
            for at, offset in owners:
                _, item, errors, _ = self.items[at]
                start = last + 1 - length - offset
                windows.setdefault(at, []).append((max(0, start - errors), start + len(item) + errors))
        for at, spans in windows.items():
            item_id, item, errors, masks = self.items[at]
            best = (errors + 1, -1)
            for low, high in _merged(spans, errors):
                d, end = myers(masks, len(item), text[low:high], errors)
                if d < best[0]:
                    best = (d, low + end)
            if best[0] <= errors:
                out.append((item_id, *best))
        return out


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items that are not empty, some at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():  # one partition at a time; only a block is held
        text = normal(row.text)
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.doc_id, text))
        size += len(text)
    yield block


def short_items(items: DataFrame, id_col: str = "item_id", text_col: str = "text", min_item: int = 24) -> DataFrame:
    """item_id and text of the items that are searched for as whole documents only, or not at all (empty ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = pa.array([len(normal(t.as_py())) < min_item for t in batch["text"]], pa.bool_())
            yield batch.filter(short).rename_columns(["item_id", "text"])

    return id_text(items, id_col, text_col).mapInArrow(run, "item_id long, text string")


def _senders(spark, items: DataFrame, rate: float, min_piece: int, min_item: int, block_chars: int) -> Iterator[Callable[[], Matcher]]:
    """For each block of items, what makes its matcher in a task."""
    for block in _blocks(items, block_chars):
        sent, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex
        yield lambda sent=sent, name=name: once(("decontaminate", name), lambda: Matcher(sent.value, rate, min_piece, min_item))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = 0.05, min_piece: int = 12, min_item: int = 24, block_chars: int = 4_000_000) -> DataFrame:
    """A row for each document and item that it holds: doc_id, item_id, distance, match_end (in the normalised text), n_chars of the item."""
    texts = id_text(docs, id_col, text_col)

    def matched(matcher_of: Callable[[], Matcher]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of()
            size = {i: len(t) for i, t, _, _ in matcher.items} | {i: len(t) for t, ids in matcher.short.items() for i in ids}
            for batch in sliced(batches):
                rows: list[tuple] = []
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    rows += [(doc, i, d, end, size[i]) for i, d, end in matcher.hits(normal(text.as_py()))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "match_end", "n_chars"])

        return texts.mapInArrow(run, SCHEMA)

    senders = _senders(docs.sparkSession, id_text(items, item_id_col, item_text_col), rate, min_piece, min_item, block_chars)
    return reduce(DataFrame.unionByName, map(matched, senders))


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = 0.05, min_piece: int = 12, min_item: int = 24, block_chars: int = 4_000_000) -> DataFrame:
    """docs less the documents that hold a test item; all columns stay, nothing is shuffled."""
    at = docs.columns.index(text_col)
    for matcher_of in _senders(docs.sparkSession, id_text(items, item_id_col, item_text_col), rate, min_piece, min_item, block_chars):

        def run(batches: Iterator[pa.RecordBatch], matcher_of=matcher_of) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of()
            for batch in sliced(batches):
                yield batch.filter(pa.array([not matcher.hits(normal(t.as_py() or "")) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
