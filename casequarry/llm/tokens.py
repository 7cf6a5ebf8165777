"""A public byte-level tokenizer, applied to each different pre-token once and remembered within bounds."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import public_tokenizers
import regex
from tokenizers import Tokenizer

DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Pre-tokens that one worker remembers; beyond that it begins anew.
REMEMBERED = 1_000_000
#: Characters that every version of the Unicode tables puts into the same class.
_UNSURE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-ԯ]")
_LONG = 4_000_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


class Pieces:
    """Pre-tokens of a text as the library splits it, and their ids."""

    def __init__(self, path: str = DEFAULT_TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        self.tokenizer = Tokenizer.from_file(path)
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = frozenset(special)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._ids = _Remembered(self.encode)

    def _plain(self, text: str) -> Iterable[str]:
        if _UNSURE.search(text):
            return (text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        if len(text) > _LONG:
            return (m[0] for m in self._pattern.finditer(text))
        return self._pattern.findall(text)

    def split(self, text: str) -> Iterable[str]:
        """Pre-tokens in order; a special string is one of them."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        return (p for part in self._special.split(text) if part for p in ((part,) if part in self.special else self._plain(part)))

    def encode(self, piece: str) -> bytes:
        """Ids of one pre-token, as little-endian unsigned 32-bit numbers."""
        if piece in self.special:
            ids = [self.tokenizer.token_to_id(piece)]
        else:
            ids = [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return array("I", ids).tobytes()

    def count(self, piece: str) -> int:
        """Number of ids of one pre-token; the ids aren't kept."""
        return len(self.encode(piece)) // 4

    def ids(self, text: str) -> bytes:
        return b"".join(map(self._ids.__getitem__, self.split(text)))


class _Remembered(dict):
    """Ids by pre-token, made when first asked for; begins anew when it is full."""

    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[piece] = self._encode(piece)
        return found


def pieces_of(path: str) -> Pieces:
    """The tokenizer of this worker. Tasks bring this package's code along, so it is kept at the installed package."""
    loaded = vars(public_tokenizers).setdefault("_loaded_pieces", {})
    if path not in loaded:
        loaded[path] = Pieces(path)
    return loaded[path]
