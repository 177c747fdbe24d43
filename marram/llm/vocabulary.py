"""Where the public vocabulary file lies: a parameter, with the installed package's path as its default."""

from __future__ import annotations

import os

#: Set to another file of the same format to encode with it.
VARIABLE = "MARRAM_BPE_VOCABULARY"
DEFAULT = "byte_bpe_50k.json"


def default_vocabulary() -> str:
    if path := os.environ.get(VARIABLE):
        return path
    import public_tokenizers

    return str(public_tokenizers.path(DEFAULT))
