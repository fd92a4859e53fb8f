"""The vocabulary of a SentencePiece model file: pieces, scores and what kind they are."""

from __future__ import annotations

import os
from dataclasses import dataclass

#: Where the public tokenizer files lie unless the caller names another folder.
TOKENIZERS = os.environ.get("GLEANER_TOKENIZERS", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"
SPACE = "▁"


def model_path(folder: str = TOKENIZERS, name: str = MODEL) -> str:
    return os.path.join(folder, name)


@dataclass(frozen=True)
class Vocabulary:
    """Ids by piece, scores by piece (both without control, unknown and byte pieces), ids of the 256 bytes.

    by_merge: scores are ranks of merges (a BPE model), not log-probabilities.
    """

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    unknown: int
    by_merge: bool


def load(path: str) -> Vocabulary:
    """Read on the driver; the result (a megabyte for 32,000 pieces) goes to the tasks, which need no file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, byte_ids = {}, {}, {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ids[piece], scores[piece] = i, model.get_score(i)
    known = [s for s in scores.values() if s > -1e8]
    by_merge = all(s == int(s) for s in known) and min(known, default=0) < -1000
    return Vocabulary(ids, scores, tuple(byte_ids[b] for b in range(256)) if len(byte_ids) == 256 else (), model.unk_id(), by_merge)
