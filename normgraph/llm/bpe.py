"""Byte-level BPE from a tokenizers JSON file, with the byte length of every id.

The ids are those of the tokenizers library (a test compares them); the engine is tiktoken's, which is several times faster. Its regular
expressions overflow their stack on a very long run of white space, so such runs are cut out as the pattern would cut them.
Encoder.encode() takes the file's added tokens in a text as tokens, as that library does by default; Encoder.ids() takes their strings as ordinary text.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np

#: The pre-token pattern of this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space runs of so many characters are not left to the engine.
LONG_RUN = 50_000
_LONG = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Vocabulary files write a printable byte as its Latin-1 character, the other bytes as characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", ())
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or spec.get("normalizer"):
            raise ValueError(f"{path}: added tokens that are more than their strings, or a normalizer, are not supported")
        special = self.special = {t["content"]: t["id"] for t in added}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.n_bytes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in ranks.items():
            self.n_bytes[i] = len(token)
        for token, i in special.items():
            self.n_bytes[i] = len(token.encode())

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if len(text) < LONG_RUN or not _LONG.search(text):
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4")
        parts = self.parts.split(text) if self.parts else [text]
        return np.concatenate([np.array([self.special[x]], "<u4") if i % 2 else self.ids(x) for i, x in enumerate(parts)])

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if len(text) < LONG_RUN or not _LONG.search(text):
            return np.array(self.encoding.encode_ordinary(text), "<u4")
        return np.concatenate(list(self._around_runs(text)))

    def _around_runs(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text with long runs of white space. A run is one pre-token but for its last character, which goes with what follows it."""
        at = 0
        for run in _LONG.finditer(text):
            low, high = run.span()
            cut = high if high == len(text) else high - 1
            yield np.array(self.encoding.encode_ordinary(text[at:low]), "<u4")
            yield np.array(self.encoding._encode_single_piece(text[low:cut].encode()), "<u4")
            at = cut
        yield np.array(self.encoding.encode_ordinary(text[at:]), "<u4")


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
