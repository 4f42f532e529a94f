"""Token ids of a public byte-level BPE, the same as its `tokenizers` file gives.

The file's vocabulary and merges are run by tiktoken, which is several times faster;
tests hold its ids against those of `tokenizers`.
"""

from __future__ import annotations

import functools
import json

import numpy as np

#: The byte-to-character table of byte-level BPE shows these bytes as
#: themselves and the others, in order, as the characters from 256 on.
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: Fixed value: the pre-token pattern of this byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """A tiktoken encoding of a byte-level BPE `tokenizers` file."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    back = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("public", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(path: str, text: str | None) -> np.ndarray:
    """Ids as unsigned 32-bit integers; special tokens' strings in a text become their
    ids, as `tokenizers` has it by default. Null is empty."""
    return encoding(path).encode_to_numpy(text or "", allowed_special="all").astype("<u4", copy=False)
