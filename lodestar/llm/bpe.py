"""Byte-level BPE ids from a tokenizer file whose path the caller gives.

The file (``tokenizers`` JSON) names the vocabulary and merges. Where every merge makes the next id, ids are
merge ranks, and ``tiktoken`` computes the same ids several times faster; otherwise ``tokenizers`` itself runs.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: how byte-level BPE of this kind splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else the
    next code point from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(path: str) -> tuple[dict[bytes, int], dict]:
    """(piece bytes -> id, the parsed file), without the added special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    letters = byte_alphabet()
    return {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, spec


class ByteBpe:
    def __init__(self, path: str):
        ranks, spec = vocabulary(path)
        letters = byte_alphabet()
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        ordered = all(ranks.get(bytes(letters[c] for c in a + b)) == 256 + i for i, (a, b) in enumerate(merges))
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if ordered and plain and not spec.get("normalizer"):
            import tiktoken

            self._fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self._fast, self._full = None, Tokenizer.from_file(path)
            self._full.encode_special_tokens = True

    def ids(self, text: str) -> np.ndarray:
        if self._fast is not None:
            return np.asarray(self._fast.encode_ordinary(text), dtype="<u4")
        return np.asarray(self._full.encode(text, add_special_tokens=False).ids, dtype="<u4")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One tokenizer for each worker process and path."""
    return ByteBpe(path)
