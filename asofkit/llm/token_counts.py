"""Operator 1: token counts by linear longest-match over a vocabulary trie.

Words are runs of non-space characters (str.split). A word is matched greedily, longest piece first,
against the vocabulary with the word mark before it. The automaton reads each character once: a trie of
the vocabulary has for each node a failure link and the number of tokens that following it completes, so
lengths come out without building pieces. A character in no piece counts as its UTF-8 bytes (byte
fallback), or makes its whole word one unknown token (unknown="word").

Null and empty texts, and texts of blanks, have 0 words and 0 tokens. Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import Memo, id_text, once
from .vocab import NORMAL, SPACE, USER_DEFINED, load_pieces, model_path

SCHEMA = "doc_id long, n_words long, n_tokens long, n_fallback long"
_SHIFT = 40


class LongestMatch:
    """Trie with failure links; `count(word)` gives (tokens, of them fallback or unknown)."""

    def __init__(self, pieces: Iterable[str], mark: str = SPACE, unknown: str = "bytes"):
        self.mark, self.unknown = mark, unknown
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        chars: set[str] = set()
        for piece in pieces:
            node = 0
            for c in piece:
                chars.add(c)
                child = self.next[node].get(c)
                if child is None:
                    child = self.next[node][c] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                node = child
            ends[node] = node != 0
        if unknown == "bytes":
            for c in chars:  # so that any path of the trie splits into pieces
                if c not in self.next[0] or not ends[self.next[0][c]]:
                    raise ValueError(f"byte fallback needs each character as a piece; {c!r} is none")
        # fail[v]: state after completing all tokens that the path to v settles, -1 if it can't be split; pops[v]: how many.
        self.fail, self.pops = [-1] * len(ends), [0] * len(ends)
        level = [(0, c, v) for c, v in self.next[0].items()]
        while level:
            following = []
            for parent, c, v in level:
                if ends[v]:
                    self.fail[v], self.pops[v] = 0, 1
                elif parent:
                    z, n = self.fail[parent], self.pops[parent]
                    while z > 0 and c not in self.next[z]:
                        z, n = self.fail[z], n + self.pops[z]
                    if z >= 0 and c in self.next[z]:
                        self.fail[v], self.pops[v] = self.next[z][c], n
                following += [(v, d, w) for d, w in self.next[v].items()]
            level = following

    def count(self, word: str) -> tuple[int, int]:
        nxt, fail, pops = self.next, self.fail, self.pops
        state = tokens = odd = 0
        for c in self.mark + word:
            while (to := nxt[state].get(c)) is None:
                if state == 0:
                    if self.unknown != "bytes":
                        return 1, 1
                    odd += len(c.encode("utf-8", "surrogatepass"))
                    to = 0
                    break
                tokens += pops[state]
                state = fail[state]
                if state < 0:
                    return 1, 1
            state = to
        while state > 0:
            tokens += pops[state]
            state = fail[state]
        return (1, 1) if state < 0 else (tokens + odd, odd)


def _matcher(path: str, unknown: str, memo: int) -> Memo:
    pieces = [p.text for p in load_pieces(path) if p.kind in (NORMAL, USER_DEFINED)]
    automaton = LongestMatch(pieces, unknown=unknown)

    def packed(word: str) -> int:
        tokens, odd = automaton.count(word)
        return tokens + (odd << _SHIFT)

    return Memo(packed, memo)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, unknown: str = "bytes", memo: int = 500_000) -> DataFrame:
    """One row for each row of df: doc_id, n_words, n_tokens, n_fallback. `memo` bounds the words a worker remembers."""
    path = model_path(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = once(("longest", path, unknown, memo), lambda: _matcher(path, unknown, memo)).__getitem__
        low = (1 << _SHIFT) - 1
        for batch in batches:
            words, sums = [], []
            for text in batch["text"]:
                split = text.as_py().split()
                words.append(len(split))
                sums.append(sum(map(of, split)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(words, pa.int64()), pa.array([s & low for s in sums], pa.int64()), pa.array([s >> _SHIFT for s in sums], pa.int64())], names=["doc_id", "n_words", "n_tokens", "n_fallback"])

    return id_text(df, id_col, text_col).mapInArrow(count, SCHEMA)
