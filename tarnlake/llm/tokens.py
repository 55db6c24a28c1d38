"""Token ids of whole texts, by a memo of words over a public tokenizer.

The tokenizer drops white space and splits at it before it merges, so the ids of a text are those of its words, one
after another. It also splits where a letter or digit meets a mark, so a blank put there changes nothing, and it lower-cases:
both are done first for all texts of a block at once, as far fewer words differ afterwards. A word's ids are worked out once
and kept. New words that are one piece to the tokenizer go to its merges at once, others through all its steps.

Texts with combining marks or with what may be a special token are left as they are, since there case and blanks may matter.
A tokenizer of other steps than these encodes whole texts.
"""

from __future__ import annotations

import gc
import json
import os
from array import array
from codecs import charmap_decode

import numpy as np

from .common import claim

_END = b"\xff"  # no byte of UTF-8: the end of a text
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # an apostrophe may belong to what follows
_AS_IT_IS = (b"\xcc", b"\xcd", b"<|")
#: The steps that the tokenizer takes before it merges.
_STEPS = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(128) if chr(b).isalnum()]] = 1
_KIND[list(_MARKS)] = 2
_ENCODERS: dict[str, Encoder] = {}


def _forget() -> None:
    for encoder in _ENCODERS.values():
        encoder.words.clear()


def _apart(data: bytes) -> bytes:
    """A blank between a letter of ASCII or of U+00C0 to U+00FF, or a digit, and a mark that follows it."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    ends = kind == 1
    # the second byte of a letter of that range; its two signs are no letters
    ends[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    at = np.flatnonzero(ends[:-1] & (kind[1:] == 2)) + 1
    return np.insert(raw, at, 32).tobytes() if len(at) else data


def _stepwise(path: str) -> bool:
    """Whether a tokenizer file normalizes and splits as this module takes it to."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normal, split = (made.get(k) or {} for k in ("normalizer", "pre_tokenizer"))
    own = [x.get("type") for x in normal.get("normalizers", [])], *[x.get("pattern", {}).get("Regex") for x in split.get("pretokenizers", [])[:1]]
    return own == _STEPS and made["model"]["type"] == "BPE" and [x["type"] for x in split["pretokenizers"]] == ["Split", "ByteLevel"]


def _byte_letters() -> str:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return "".join(chr(others.get(b, b)) for b in range(256))


class Encoder:
    """Encodes texts with one tokenizer file. ``limit`` bounds the words that the memo holds."""

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.stop = max(vocabulary.values()) + 1  # an id that no token has marks the end of a text
        self.dtype = np.dtype("<u2" if self.stop < 1 << 16 else "<u4")
        self.stepwise, self.letters = _stepwise(path), _byte_letters()
        self.words: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder a worker process: the memo serves all its tasks."""
        return _ENCODERS.setdefault(path, None) or _ENCODERS.update({path: cls(path)}) or _ENCODERS[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> None:
        merged, kind, known, other = self.tokenizer.model.tokenize, self.dtype.char, self.words, []
        for word in words:
            if word.isalpha():  # letters of ASCII alone, lower-cased
                text = word.decode()
            elif (text := word.decode()).isalpha() and max(text) <= "ÿ":
                text = charmap_decode(text.lower().encode(), "strict", self.letters)[0]
            elif word.strip(_MARKS) or b"<|" in word:
                other.append((word, text))
                continue
            known[word] = array(kind, [x.id for x in merged(text)]).tobytes()
        if other:
            known.update(zip((w for w, _ in other), self._whole([t for _, t in other]), strict=True))

    def encode_flat(self, texts: list[str | None], end_id: int | None = None, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each begins, with the end of the last; null is empty.

        Without special tokens; `end_id` is put after each text. `block` bounds the bytes that are worked on at once, but for a longer text.
        """
        claim("tokens", _forget)
        collecting = gc.isenabled()
        gc.disable()  # no cycles are made here, and searches for them would go through the whole memo
        try:
            parts, held, size = [], [], 0
            for t in texts:
                held.append(t.encode("utf-8", "replace") if t else b"")
                size += len(held[-1])
                if size >= block:
                    parts.append(self._block(held))
                    held, size = [], 0
            if held:
                parts.append(self._block(held))
        finally:
            if collecting:
                gc.enable()
        ids = np.concatenate(parts) if parts else np.empty(0, self.dtype)
        stops = np.flatnonzero(ids == self.stop)
        if end_id is not None:
            ids[stops] = end_id
            return ids, np.concatenate([[0], stops + 1])
        return np.delete(ids, stops), np.concatenate([[0], stops - np.arange(len(stops))])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, at = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _block(self, raw: list[bytes]) -> np.ndarray:
        between = b"\n" + _END + b"\n"
        if not self.stepwise:
            stop = np.array([self.stop], self.dtype).tobytes()
            return np.frombuffer(b"".join([x + stop for x in self._whole([r.decode() for r in raw])]), self.dtype)
        joined = between.join(raw) + between
        if not any(x in joined for x in _AS_IT_IS):
            joined = _apart(joined.lower())
        else:
            joined = b"".join([r + between if any(x in r for x in _AS_IT_IS) else _apart(r.lower()) + between for r in raw])
        words = joined.split()
        if len(self.words) > self.limit:
            self.words.clear()
        known = self.words
        known[_END] = np.array([self.stop], self.dtype).tobytes()
        new = set(words).difference(known)
        if new:
            self._learn(new)
        return np.frombuffer(b"".join(map(known.__getitem__, words)), self.dtype)
