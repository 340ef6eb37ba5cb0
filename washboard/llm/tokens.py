"""Token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers

VOCABULARY = "byte_bpe_50k"
#: Characters on which both libraries split texts alike: ASCII without control characters, Latin letters and marks. Texts with
#: others, and those that spell a special token, go to the tokenizer itself.
OTHER = re.compile("[^\t\n\x20-\x7e\xa1-ɏ]|<\\|endoftext\\|>")


class Ids:
    """``encode(text)`` gives the ids the ``tokenizers`` library gives without special tokens, as an array of uint32."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.quick = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))

    def encode(self, text: str) -> np.ndarray:
        if OTHER.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


_READY: dict[str, Ids] = {}


def ids(vocabulary: str = VOCABULARY) -> Ids:
    """One reader per Python worker, made at first use."""
    if vocabulary not in _READY:
        _READY[vocabulary] = Ids(vocabulary)
    return _READY[vocabulary]
