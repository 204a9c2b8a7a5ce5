"""Encoding whole texts with a public byte-level BPE vocabulary inside tasks."""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np


def default_vocabulary() -> str:
    """Where this machine has the 50k byte-level BPE as ranks; executors look it up themselves."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of whole texts. Strings that name special tokens are ordinary text.

    `vocabulary` is a file of ranks that every executor can open, or None for the installed one.
    Made in a task, not on the driver.
    """

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(vocabulary or default_vocabulary(), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._encoding = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, texts: Iterable[str | None], end: int | None = None) -> Iterable[np.ndarray]:
        """32-bit ids per text (null as empty), followed by `end` if given."""
        tail = [] if end is None else [end]
        for text in texts:
            ids = self._encoding.encode_ordinary(text) if text else []
            yield np.array(ids + tail, "<u4")
