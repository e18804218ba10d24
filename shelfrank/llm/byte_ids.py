"""Token ids of a byte-level vocabulary, for the operators that only need ids or their number."""

from __future__ import annotations

import base64

import numpy as np

END = 50256


def ranks_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """A public vocabulary of byte ranks and its pattern."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encoding(source: tuple[bytes, str]):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source[0].splitlines())}
    return tiktoken.Encoding("byte_bpe", pat_str=source[1], mergeable_ranks=ranks, special_tokens={})


def encode(own, text: str | None) -> np.ndarray:
    """Ids of the text and the closing ``END``; just that for a null or empty one."""
    ids = own.encode_ordinary(text) if text else []
    return np.array([*ids, END], dtype=np.uint16)
