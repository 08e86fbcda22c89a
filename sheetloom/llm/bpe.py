"""Whole-text encoding with the tokenizers library, at the cost of the distinct words.

A byte-level BPE encodes the pieces that its pattern cuts a text into one by one. A space that a
non-space follows always begins a new piece, and no piece reaches past it, so the text between two such
spaces encodes alike wherever it stands. Those stretches are encoded once per worker and looked up after
that; texts with any other run of spaces, or with the name of an added token, go to the library whole. The
result is the library's with its default flags: the name of an added token in a text gives that token's id.
"""

from __future__ import annotations

import os
import re
from array import array

#: Stretches, and words in them, that a worker remembers (about 250 bytes each). Beyond it, a stretch is put together each time: slower, never different.
REMEMBERED = 700_000
#: Characters of the longest stretch that is remembered.
LONG = 64
_ODD_SPACE = r" (?:\s|\Z)"
#: A run of letters at a stretch's start, with what is neither letter nor digit after it: one piece of the pattern.
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]{1,64}(?=\W|\Z)")
_LOADED: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Stretches(dict):
    """Ids of stretches; what isn't there is put together when it is asked for.

    A key is a stretch without the space before it. A text's first stretch, which has none, ends with a
    space instead: no other key holds one.
    """

    def __init__(self, tokenizer: object, most: int):
        super().__init__()
        self.tokenizer, self.most = tokenizer, most
        self.parts: dict[str, bytes] = {"": b""}
        self.letters = _byte_letters()

    def __missing__(self, stretch: str) -> bytes:
        if stretch.endswith(" "):
            m = _WORD.match(stretch)
            head, tail = (m[0], stretch[m.end() : -1]) if m else ("", stretch[:-1])
        else:
            m = _WORD.match(stretch)
            head, tail = (" " + m[0], stretch[m.end() :]) if m else ("", " " + stretch)
        parts = self.parts
        ids = parts.get(head)
        if ids is None:
            ids = self._keep(head, self.tokenizer.model.tokenize(head.encode().decode("latin-1").translate(self.letters)))
        if tail:
            more = parts.get(tail)
            if more is None:
                more = self._keep(tail, None)
            ids += more
        if len(self) < self.most and len(stretch) <= LONG:
            self[stretch] = ids
        return ids

    def _keep(self, part: str, pieces: list | None) -> bytes:
        ids = array("I", [p.id for p in pieces] if pieces is not None else self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if len(self.parts) < self.most * 2 // 3 and len(part) <= LONG:
            self.parts[part] = ids
        return ids


class Encoder:
    """A vocabulary file's tokenizer; with ``plain`` the names of added tokens in a text are ordinary text. ``most``: stretches that are remembered."""

    def __init__(self, path: str, plain: bool = False, most: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        names = [] if plain else sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.odd = re.compile("|".join([_ODD_SPACE, *map(re.escape, names)]))
        self.known = _Stretches(self.tokenizer, most)

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        """Ids of each whole text and then ``end``, as little-endian unsigned 32-bit integers. Null: as empty."""
        last = array("I", [end]).tobytes()
        look, out = self.known.__getitem__, []
        for text in texts:
            if not text:
                out.append(last)
            elif self.odd.search(text):
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + last)
            else:
                parts = text.split(" ")
                parts[0] += " "
                parts = list(map(look, parts))
                parts.append(last)
                out.append(b"".join(parts))
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    """Path of the public byte-level BPE with 50,257 ids; the file must be at the same path on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
