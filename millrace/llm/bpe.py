"""Token ids of whole texts for a byte-level tokenizer file of the tokenizers library.

Where the file is a plain byte-level BPE (no normalizer, the usual split pattern, token ids in the
order of the merges), tiktoken gives the same ids several times faster, so it encodes and the
tokenizers library takes what it refuses (very long runs of white space). The tests compare both
over every code point and over random strings. Any other file is encoded by tokenizers alone.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import cached_property

import numpy as np

# The split pattern of the byte-level pre-tokenizer.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, Encoder] = {}


def byte_of_char() -> dict[str, int]:
    """The byte for each character that byte-level vocabularies write: printable bytes stand for
    themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _fast(spec: dict):
    """A tiktoken encoding with the same ids, or None if the file isn't a plain byte-level BPE."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and not any(model.get(k) for k in ("dropout", "byte_fallback", "end_of_word_suffix", "continuing_subword_prefix"))
        and not any(a.get(k) for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        return None
    vocab, special = model["vocab"], {a["content"]: a["id"] for a in spec["added_tokens"]}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(set(merged)):
        return None
    import tiktoken

    byte = byte_of_char()
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding(
        hashlib.sha256(json.dumps(spec).encode()).hexdigest(), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special
    )


class Encoder:
    """Ids of texts as the library gives them, without begin, end or added tokens."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.fast = _fast(json.load(file))

    @cached_property
    def library(self):
        """The tokenizers library's own object, loaded when it is needed."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(self.path)
        loaded.no_truncation()
        loaded.no_padding()
        return loaded

    def ids(self, text: str) -> np.ndarray:
        """The text's ids as unsigned 32-bit numbers."""
        if self.fast is not None:
            try:
                return np.array(self.fast.encode(text, allowed_special="all"), "<u4")
            except ValueError:
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def count(self, text: str) -> int:
        """The number of the text's ids."""
        if self.fast is not None:
            try:
                return len(self.fast.encode(text, allowed_special="all"))
            except ValueError:
                pass
        return len(self.library.encode(text, add_special_tokens=False).ids)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def version(path: str) -> str:
    """Digest of the tokenizer's file and of how it is called."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + b"\nwithout special tokens added").hexdigest()
