"""Token ids of a public byte-level BPE vocabulary, as its own tokenizer gives them.

The ids come from the vocabulary file's ranks through tiktoken, several times faster than the file's own
library and equal to it (the tests compare them); a file whose settings differ goes to that library.
"""

from __future__ import annotations

import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pre-tokenizer's expression of this family of vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable letters by which such files write bytes: bytes that print stand for themselves, the others follow from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in prints}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(prints))}


def _ranked(content: dict, letters: dict[str, int]) -> bool:
    """Whether the file is what ranks and the fixed expression describe: a plain byte-level BPE without a normaliser,
    every merge's token numbered by the merge's place."""
    model, before = content["model"], content.get("pre_tokenizer") or {}
    if content.get("normalizer") is not None or model.get("type") != "BPE" or before.get("type") != "ByteLevel":
        return False
    if before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return False
    vocabulary = model["vocab"]
    if sorted(vocabulary.get(c, -1) for c in letters) != list(range(256)):
        return False
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {t["content"] for t in content.get("added_tokens", [])}
    return all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)) and len(vocabulary.keys() - special) == 256 + len(merges)


class ByteBpe:
    """encode() gives a text's ids as little-endian unsigned 32-bit integers, those that the tokenizers library gives.

    That library itself is asked for files that aren't plain byte-level BPE, for texts with a special token's
    string, and for what the fast way refuses (some million spaces in a row)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        letters = _byte_letters()
        self.special = [t["content"] for t in content.get("added_tokens", [])]
        self._path, self._exact, self._fast = path, None, None
        if _ranked(content, letters):
            vocabulary = {bytes(letters[c] for c in token): k for token, k in content["model"]["vocab"].items() if token not in self.special}
            self._fast = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=vocabulary, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self._fast is not None and not any(s in text for s in self.special):
            try:
                return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # its expression's stack is bounded
                pass
        if self._exact is None:
            self._exact = Tokenizer.from_file(self._path)
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
