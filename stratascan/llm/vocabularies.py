"""Where vocabulary files lie. Workers import this module, so it imports little."""

from __future__ import annotations


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
