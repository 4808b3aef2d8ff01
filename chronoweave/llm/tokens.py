"""Encoding whole texts with a public tokenizer file, word by word with a bounded cache.

The vocabulary used by default ends each word with its own token and drops white space, so that a text's
ids are those of its pieces between white space. Pieces of plain Latin letters and signs are split
and looked up in the BPE model directly; anything else goes through the whole tokenizer. A file that lowers, splits or
looks up in another way is known by what it states, and encodes whole texts.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

DEFAULT_FILE = "word_bpe_49k.json"
END_ID = 1
CACHED_PIECES = 900_000

# What a tokenizer file states that encodes piece by piece as below.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None, "truncation": None, "padding": None,
}

_PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\xff]+")
#: The vocabulary's own splitting pattern, its letter and number classes spelt out for Latin-1.
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable, else from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class _Made(dict):
    """A dictionary that makes the values it lacks: a text's pieces are looked up in one pass."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class PieceEncoder:
    """Texts (UTF-8 bytes) to ids, as little-endian unsigned 32-bit integers, without the end id."""

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        stated = json.loads(self.whole.to_str())
        added = [t["content"] for t in stated["added_tokens"]]
        self.by_pieces = all(stated.get(k) == v for k, v in KNOWN.items()) and stated["model"]["type"] == "BPE" and all(t.startswith("<|") for t in added)
        self.letters = byte_letters()
        self.cached = cached
        self.ids, self.counts = _Made(self.piece), _Made(lambda p: len(self.piece(p)) // 4)
        self.words: dict[str, bytes] = {}

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= self.cached // 2:
                self.words.clear()
            written = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])  # printable ASCII stands for itself
            found = self.words[word] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(written)])
        return found

    def piece(self, piece: bytes) -> bytes:
        """A piece without ASCII white space, A-Z already lower."""
        if piece.isalpha():  # a-z alone: one word
            return self._word(piece.decode())
        text = piece.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text):
            return b"".join([self._word(w) for w in _SPLIT.findall(text.lower())])
        return self._whole(piece)

    def _known(self, made: _Made) -> _Made:
        if len(made) >= self.cached:
            made.clear()
        return made

    def encode(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if not self.by_pieces or b"<|" in text:  # may hold a special token, which is found before letters are lowered
            return self._whole(text)
        return b"".join(map(self._known(self.ids).__getitem__, text.lower().split()))

    def count(self, text: bytes | None) -> int:
        if not text:
            return 0
        if not self.by_pieces or b"<|" in text:
            return len(self._whole(text)) // 4
        return sum(map(self._known(self.counts).__getitem__, text.lower().split()))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
