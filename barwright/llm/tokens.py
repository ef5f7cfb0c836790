"""Token ids of a public byte-level BPE vocabulary.

The vocabulary exists as ``tokenizers`` JSON and as ranks for ``tiktoken``; both give the same ids (the tests compare them on
every code point and on the given documents). The ranks are about eight times as fast, so they are used when they lie
beside the JSON file. Special strings in a text become their special id, as the JSON file says.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib

import numpy as np

EOT = 0


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its ids as a little-endian unsigned 32-bit array; one per Python worker."""
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return _by_json(path)
    import public_tokenizers
    import tiktoken
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", ())}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
    slow = None

    def encode(text: str) -> np.ndarray:
        nonlocal slow
        try:
            if any(s in text for s in special):
                return np.asarray(fast.encode(text, allowed_special="all"), "<u4")
            return np.asarray(fast.encode_ordinary(text), "<u4")
        except ValueError:  # the pattern's backtracking limit, on odd texts
            slow = slow or _by_json(path)
            return slow(text)
    return encode


def _by_json(path: str):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def document_ids(encode, text: str | None) -> np.ndarray:
    """Ids of a document, the closing id 0 included."""
    ids = encode(text) if text else np.empty(0, "<u4")
    return np.append(ids, np.uint32(EOT)).astype("<u4", copy=False)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
