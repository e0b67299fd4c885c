"""The fixed public piece vocabulary, read from a model file of the box (never trained, never copied)."""

from __future__ import annotations

from functools import lru_cache

MODEL = "piece_bpe_32k.model"
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(path: str | None = None):
    """The sentencepiece processor of ``path`` (by default the 32k piece model)."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or model_path())


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> dict[str, int]:
    """Text of every normal piece -> id (no control, unknown or byte pieces)."""
    sp = load(path)
    return {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
