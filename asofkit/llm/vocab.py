"""Reading public vocabulary files. The path is a parameter; the files stay where they are."""

from __future__ import annotations

import os
from typing import NamedTuple

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: sentencepiece's piece types (fixed values of its public format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


def model_path(path: str | None = None) -> str:
    return path or os.environ.get("ASOFKIT_PIECE_MODEL") or DEFAULT_MODEL


def load_pieces(path: str | None = None) -> list[Piece]:
    """The pieces of a sentencepiece model file in order of their ids."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_path(path), "rb") as f:
        model.ParseFromString(f.read())
    return [Piece(p.piece, p.score, p.type) for p in model.pieces]
