"""Where the public tokenizer files are. The path is a parameter of each operator; the files are never copied."""

from __future__ import annotations


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
