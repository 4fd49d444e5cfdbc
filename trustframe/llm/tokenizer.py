"""A public byte-level BPE vocabulary, loaded once per Python worker."""

from __future__ import annotations

import functools
import json

import numpy as np
import public_tokenizers
import tiktoken

#: Fixed values of byte-level BPE: bytes that stand for themselves; the others are shifted past 255 in order.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


class Vocabulary:
    """Ids of a byte-level BPE file in the JSON format of ``tokenizers``.

    The merges of such a file are numbered in the order of their ids, so the ids are ranks and a rank-based
    encoder gives the ids that ``tokenizers`` gives, several times faster. Strings of special tokens in a text
    become their ids, which is also what ``tokenizers`` does by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        others = (x for x in range(256) if x not in set(PLAIN))
        to_byte = {chr(x): x for x in PLAIN} | {chr(256 + k): x for k, x in enumerate(others)}
        self.special = {x["content"]: x["id"] for x in content["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): rank for token, rank in content["model"]["vocab"].items()
                 if token not in self.special}
        self.encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens=self.special)
        self.widths = np.zeros(max(*ranks.values(), *self.special.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)
        for token, rank in self.special.items():
            self.widths[rank] = len(token.encode())

    def ids(self, text: str) -> np.ndarray:
        """Token ids of a text, as unsigned 32-bit numbers."""
        if any(token in text for token in self.special):
            return np.array(self.encoding.encode(text, allowed_special="all"), np.uint32)
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")
