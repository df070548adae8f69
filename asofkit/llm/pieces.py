"""Operator 2: SentencePiece encoding and decoding.

Encoding finds the segmentation of greatest likelihood under a unigram model of the pieces. The public models at hand are BPE
models, whose scores are merge ranks and no log probabilities; tokenizers are not trained here, so a piece of rank r has the
probability that Zipf's law gives it, in proportion to 1 / (r + 2.7) (`log_scores`; models that bring log probabilities keep
theirs). So ids are those of the likeliest segmentation, not those that replaying the BPE merges would give.

An Aho-Corasick automaton over the pieces
reads the text once; at each position its output links give all pieces that end there, longest first, and
each relaxes the best score of that position (Viterbi). A character that is no piece of its own may be taken
as unknown at the lowest score less 10, and is written as its UTF-8 bytes' pieces. Ties go to the longer
last piece. As the model says: nothing is normalised, one blank goes before a text that is not empty, and
blanks are written as U+2581.

No piece holds U+2581 after another character, nor a line end, so the best path of a text is made of the best
paths of its parts cut there; parts are encoded once and remembered (a bounded memo). For a model with
pieces across such cuts, whole texts are encoded.

Null and empty texts have no pieces and decode to the empty text. A text that itself holds U+2581 decodes to
blanks there; `round_trip` says so.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import fsum, inf, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Memo, id_text, once, sliced
from .vocab import BYTE, NORMAL, SPACE, UNKNOWN, USER_DEFINED, Piece, load_pieces, model_path

UNKNOWN_PENALTY = 10.0
ZIPF_SHIFT = 2.7
_LINES = "\n\r\t"


def log_scores(pieces: list[Piece]) -> list[Piece]:
    """pieces with log probabilities as scores: their own, or by Zipf's law where the scores are ranks (whole numbers from 0 down)."""
    scores = [p.score for p in pieces if p.kind == NORMAL]
    if len(scores) < 2 or any(x > 0 or x != int(x) for x in scores):
        return pieces
    total = log(fsum(1 / (ZIPF_SHIFT - x) for x in scores))
    return [p._replace(score=-log(ZIPF_SHIFT - p.score) - total) if p.kind == NORMAL else p for p in pieces]


class PieceCodec:
    def __init__(self, pieces: list[Piece], memo: int = 400_000):
        import ahocorasick

        self.pieces = pieces
        usable = [(i, p) for i, p in enumerate(pieces) if p.kind in (NORMAL, USER_DEFINED) and p.text]
        self.automaton = ahocorasick.Automaton()
        for i, p in usable:
            self.automaton.add_word(p.text, (len(p.text), p.score, i))
        self.automaton.make_automaton()
        self.lengths = [len(p.text) for p in pieces]
        self.single = {p.text for _, p in usable if len(p.text) == 1}
        self.unknown_score = min((p.score for _, p in usable), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, p in enumerate(pieces) if p.kind == UNKNOWN), 0)
        self.bytes = {int(p.text[3:5], 16): i for i, p in enumerate(pieces) if p.kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.out = [" " if p.kind == UNKNOWN else "" if p.kind != NORMAL and p.kind != USER_DEFINED else p.text.replace(SPACE, " ") for p in pieces]
        cuts = not any(SPACE in p.text.lstrip(SPACE) for _, p in usable)
        lines = "".join(c for c in _LINES if not any(c in p.text for _, p in usable))
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{lines}]*|[^{SPACE}{lines}]+|[{lines}]" if cuts and lines else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if cuts else "(?s:.+)").findall
        self.memo = Memo(self.best, memo)

    def best(self, part: str) -> tuple[int, ...]:
        """Ids of the best segmentation of one part."""
        if not self.single.issuperset(part):
            return self._best_with_unknown(part)
        n = len(part)
        score = [-inf] * (n + 1)
        score[0] = 0.0
        last_piece = [0] * (n + 1)
        for last, (length, value, piece) in self.automaton.iter(part):
            end = last + 1
            new = score[end - length] + value
            if new > score[end]:
                score[end], last_piece[end] = new, piece
        ids: list[int] = []
        while n:
            ids.append(last_piece[n])
            n -= self.lengths[last_piece[n]]
        return tuple(reversed(ids))

    def _best_with_unknown(self, part: str) -> tuple[int, ...]:
        """The same where some characters are no pieces: at those positions the unknown character is tried last."""
        n = len(part)
        score = [0.0] + [-inf] * n
        back = [(0, -1)] * (n + 1)
        found: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for last, hit in self.automaton.iter(part):
            found[last + 1].append(hit)
        for end in range(1, n + 1):
            for length, value, piece in found[end]:
                if (new := score[end - length] + value) > score[end]:
                    score[end], back[end] = new, (end - length, piece)
            if part[end - 1] not in self.single and (new := score[end - 1] + self.unknown_score) > score[end]:
                score[end], back[end] = new, (end - 1, -1)
        ids: list[int] = []
        while n:
            n, piece = back[n]
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(part[n].encode("utf-8", "surrogatepass"))]
            else:
                ids.append(self.unknown_id)
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        for part in map(self.memo.__getitem__, self.parts(SPACE + text.replace(" ", SPACE))):
            ids += part
        return ids

    def decode(self, ids: list[int]) -> str:
        if not self.byte_of.keys() & set(ids):
            text = "".join(map(self.out.__getitem__, ids))
        else:
            parts: list[str] = []
            run = bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    parts.append(run.decode("utf-8", "replace"))
                    run.clear()
                parts.append(self.out[i])
            parts.append(run.decode("utf-8", "replace"))
            text = "".join(parts)
        return text[1:] if text.startswith(" ") else text


def _codec(path: str, memo: int) -> PieceCodec:
    return once(("pieces", path, memo), lambda: PieceCodec(log_scores(load_pieces(path)), memo))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, memo: int = 400_000) -> DataFrame:
    """doc_id and ids array<int>, a row for each row."""
    path = model_path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, memo)
        for part in sliced(batches, 256):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([codec.encode(t.as_py()) for t in part["text"]], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id and text from ids; null ids give the empty text."""
    path = model_path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, 1000)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([codec.decode(i.as_py() or []) for i in batch["ids"]], pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def encoded_and_decoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, memo: int = 400_000) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, n_byte_pieces, ids, decoded_sha256, round_trip."""
    path = model_path(model)
    names = ["doc_id", "n_tokens", "n_byte_pieces", "ids", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, memo)
        for part in sliced(batches, 256):
            ids, n, odd, sha, same = [], [], [], [], []
            for text in part["text"].to_pylist():
                i = codec.encode(text)
                back = codec.decode(i)
                ids.append(i)
                n.append(len(i))
                odd.append(sum(map(codec.byte_of.__contains__, i)))
                sha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(back == text)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(odd, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(sha), pa.array(same)], names=names)

    return id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, n_byte_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean")
