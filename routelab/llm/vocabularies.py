"""Where the public tokenizer files are: a folder given by TOKENIZERS_DIR, else that of the installed package."""

from __future__ import annotations

import os


def vocabulary_path(name: str) -> str:
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
