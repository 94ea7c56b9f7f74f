"""Byte-level BPE ids of whole texts with the vocabulary of a ``tokenizers`` file."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Characters on which both libraries' patterns agree in every Unicode version; other texts take the slower one.
_PLAIN = re.compile("[^\t\n\r -~¡-ɏ]")
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_WORD = 1000


def byte_bpe_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(spec: dict) -> bool:
    """Whether the file is a byte-level BPE whose ids are the ranks of its merges and whose words are split as
    ``_SPLIT`` does, so that ids may come from the vocabulary alone."""
    model, words = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
    if not plain or not split:
        return False
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in merges]
    return None not in made and made == sorted(set(made)) and set(_byte_of()) <= set(model["vocab"])


class Encoder:
    """``ids(text)`` equals ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``: a special token's
    string in a text is that token. Plain texts go through the faster library with the same vocabulary if the file's
    merges are in the order of the ids and its other settings agree, which is tested here: the ids are ranks then. Texts with
    a special token's string, other characters or very long words, and every text for another file, go through
    ``tokenizers``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.fast = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if _ranked(spec) else None
        size = {i: len(t) for t, i in ranks.items()} | {i: len(t.encode()) for t, i in added.items()}
        self.lengths = np.zeros(max(size) + 1, np.int64)
        self.lengths[list(size)] = list(size.values())

    def ids(self, text: str) -> list[int]:
        slow = self.fast is None or _PLAIN.search(text) or self.special and self.special.search(text)
        if slow or max(map(len, text.split()), default=0) > _LONG_WORD:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
