"""Byte-level BPE ids, the same as the tokenizers library's, made fast by a cache.

The vocabulary file is a parameter. A text is cut into pieces by the
vocabulary's own pattern; the ids of a piece are kept in a bounded cache.
Texts that the cut might treat differently (rare scripts, the special
token's string) go through the tokenizers library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cached_property

import numpy as np

#: Pattern of the public byte-level vocabulary (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same cut for texts without RARE characters, in the standard library's dialect.
COMMON = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: All but the characters on which dialects and Unicode versions agree: Latin, Greek, Cyrillic, punctuation.
RARE = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɀΑ-Ρα-ωЀ-ѿ‐-‧‰-⁞€]"
CACHE = 150_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cached(dict):
    """Piece -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        letters = _byte_letters()
        self.token_bytes = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {b: i for i, b in self.token_bytes.items()}
        self.merge = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.special = sorted(special)

    @cached_property
    def full(self):
        """The whole tokenizer, for the few texts that need it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __missing__(self, piece: str) -> bytes:
        found = array("I", self.merge.encode_ordinary(piece)).tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(piece) < 64:
            self[piece] = found
        return found


_OWN: dict[str, tuple] = {}


def encoder(path: str):
    """str -> ids as bytes; one a worker and path."""
    if path not in _OWN:
        cache = Cached(path)
        cut, rare = re.compile(COMMON).findall, re.compile(RARE).search
        get = cache.__getitem__

        def encode(text: str) -> bytes:
            if rare(text) or any(s in text for s in cache.special):
                return np.asarray(cache.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            return b"".join(map(get, cut(text)))

        _OWN[path] = (encode, cache)
    return _OWN[path]
