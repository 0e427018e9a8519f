"""Where vocabulary files of public tokenizers lie."""

from __future__ import annotations

import os


def tokenizer(name: str, folder: str | None = None) -> str:
    """The path of a vocabulary file, in folder or else where the installed package of vocabularies has it."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
