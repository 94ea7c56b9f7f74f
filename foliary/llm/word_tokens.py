"""Ids of whole texts for BPE vocabularies with word ends: words are found and told apart by whole arrays, and each
different word of a block of texts is encoded once."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

from .tokens import _byte_of

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose case, classes and normal forms agree in every Unicode version, one or two bytes each.
_PLAIN = re.compile("[^\t\n\r -~¡-įı-ſ]")
_TAILS = ("s", "t", "re", "ve", "m", "ll", "d")
_GAP, _LETTER, _DIGIT, _OTHER = range(4)
_KINDS = np.array([_LETTER if (c := unicodedata.category(chr(i))[0]) == "L" else _DIGIT if c == "N" else _GAP if chr(i).isspace() else _OTHER for i in range(0x180)], np.uint8)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are compared as two integers; longer ones are taken one by one.
_WIDE = 16


def word_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _kinds(data: np.ndarray) -> np.ndarray:
    kinds = _KINDS[np.minimum(data, 0x7F)]
    lead = np.flatnonzero(data >= 0xC2)
    kinds[lead] = kinds[lead + 1] = _KINDS[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
    return kinds


def find_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of lower-cased UTF-8 text: contractions after an apostrophe that begins a run of
    symbols, runs of letters, single digits, runs of symbols."""
    kinds = _kinds(data)
    begins = np.empty(len(data), bool)
    begins[:1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
    begins |= (kinds == _DIGIT) & ((data & 0xC0) != 0x80)
    mark = np.flatnonzero(begins & (data == 39))
    if len(mark):
        padded = np.concatenate((data, np.zeros(2, np.uint8)))
        tail = np.zeros(len(mark), np.int64)
        for t in _TAILS:
            hit = padded[mark + 1] == ord(t[0])
            if len(t) == 2:
                hit &= padded[mark + 2] == ord(t[1])
            tail[hit] = len(t)
        mark, tail = mark[tail > 0], tail[tail > 0]
        begins[mark + 1] = False
        after = mark + 1 + tail
        begins[after[after < len(data)]] = True
    at = np.flatnonzero(begins)
    ends = np.append(at[1:], len(data))
    word = kinds[at] != _GAP
    return at[word], ends[word]


class WordEncoder:
    """``ids(texts)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids`` of each text. Texts with other
    than plain characters, or with a special token's string, go through ``tokenizers``, as all texts do if the file's
    normalizer, word splitter or model aren't those that are worked out here."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [x["content"] for x in spec.get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.dtype = np.dtype("<u2" if self.slow.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.fast = None
        if _as_here(spec):
            self._build(spec)

    def _build(self, spec: dict) -> None:
        import tiktoken

        byte_of, vocab = _byte_of(), spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        single = sorted(byte_of, key=byte_of.get)
        ranked = [*single, *[c + "</w>" for c in single], *["".join(m) for m in merges]]
        if len(set(ranked)) < len(ranked) or not set(ranked) <= set(vocab):
            return
        self.id_of = np.array([vocab[t] for t in ranked], self.dtype)
        self.is_end = np.array([t.endswith("</w>") for t in ranked])
        # a zero byte stands for the end of a word; it joins the last byte before any merge does
        raw = [bytes(byte_of[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>") for t in ranked]
        if len(set(raw)) == len(raw):
            self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks={t: i for i, t in enumerate(raw)}, special_tokens={})

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's end."""
        if not words:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        ranks = self.fast.encode_to_numpy("\0".join(words) + "\0")
        return self.id_of[ranks], np.flatnonzero(self.is_end[ranks]) + 1

    def _of_plain(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.lower().encode() for t in texts]
        stops = np.cumsum([len(r) + 1 for r in raw])
        whole = b"\n".join(raw) + b"\n" + b"\0" * _WIDE
        data = np.frombuffer(whole, np.uint8)
        begins, ends = find_words(data[: stops[-1]])
        size = ends - begins
        eight = np.ndarray(len(whole) - 7, "<u8", whole, 0, (1,))  # the eight bytes from each place on
        a = eight[begins] & _MASK[np.minimum(size, 8)]
        b = eight[np.minimum(begins + 8, len(eight) - 1)] & _MASK[np.clip(size - 8, 0, 8)]
        mixed = a ^ ((b * np.uint64(0x9E3779B97F4A7C15)) ^ (b >> np.uint64(29)))
        _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
        odd = (size > _WIDE) | (a[first[which]] != a) | (b[first[which]] != b) | (size[first[which]] > _WIDE)
        own = np.flatnonzero(odd)  # long words, and those whose two integers mix to another word's
        which[own] = len(first) + np.arange(len(own))
        rep = np.concatenate((first, own))
        ids, stop = self._of_words([whole[i:j].decode() for i, j in zip(begins[rep].tolist(), ends[rep].tolist())])
        n = np.diff(stop, prepend=0)
        count = n[which]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        flat = ids[np.repeat((stop - n)[which] - upto + count, count) + np.arange(total)]
        cuts = np.searchsorted(begins, stops[:-1])
        return np.split(flat, np.append(0, upto)[cuts])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.fast is not None and not _PLAIN.search(t) and not (self.special and self.special.search(t)) for t in texts]
        quick = iter(self._of_plain([t for t, p in zip(texts, plain) if p]) if any(plain) else ())
        return [next(quick) if p else np.array(self.slow.encode(t, add_special_tokens=False).ids, self.dtype) for t, p in zip(texts, plain)]


def _as_here(spec: dict) -> bool:
    norm, words, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec["model"]
    norms = [(x["type"], x.get("pattern"), x.get("content")) for x in norm.get("normalizers", ())]
    if norms != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]:
        return False
    parts = words.get("pretokenizers", ())
    if [x["type"] for x in parts] != ["Split", "ByteLevel"]:
        return False
    split, level = parts
    if split["pattern"] != {"Regex": _SPLIT} or split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"]:
        return False
    others = ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
    return model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not any(model.get(k) for k in others) and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", ()))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
