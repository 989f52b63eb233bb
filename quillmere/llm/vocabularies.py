"""Where the public vocabulary files are."""

from __future__ import annotations


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
