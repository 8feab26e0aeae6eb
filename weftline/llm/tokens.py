"""Exact byte-level BPE ids.

Texts go whole to the merges' compiled encoder, with the vocabulary's own pattern; the special token's string in a text
becomes its id, as the reference tokenizer does by default.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        import public_tokenizers

        ranks_path = path.rsplit(".", 1)[0] + ".tiktoken"
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        with open(path) as f:
            self.special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.plain = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pieces = [b""] * (max(max(ranks.values()), *self.special.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece

    def ids(self, text: str) -> list[int]:
        if not (self._special and "<|" in text and self._special.search(text)):
            return self.plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [*self.plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.plain(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids end."""
        found = [self.ids(t) for t in texts]
        ends = np.cumsum([len(f) for f in found], dtype=np.int64) if found else np.zeros(0, np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(ends[-1]) if found else 0), ends


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
