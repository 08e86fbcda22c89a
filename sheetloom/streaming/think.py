"""Removal of <think> blocks from text that arrives in chunks."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: What a text is made of outside a block: the tag that opens one, or other text; and inside it: all up to the closing tag.
_OUTSIDE = re.compile(r"(?P<tag><think>)|(?P<text>[^<]+|<(?!think>))")
_INSIDE = re.compile(r"(?s).*?</think>")
#: The end of a text that may become a tag once more text comes.
_UNDECIDED = re.compile(r"</?(?:t(?:h(?:i(?:n(?:k)?)?)?)?)?\Z")


@dataclass
class ThinkStripper:
    """State between chunks. What comes out doesn't depend on where the text was cut.

    At most seven characters are held back: the end of what has come, where it may be the beginning of a tag. White
    space is dropped at the start and after a block, until other text comes. Blocks are removed in one pass: what meets where one
    stood is text, even if it reads as a tag.
    """

    held: str = ""
    inside: bool = False
    fresh: bool = True

    def push(self, chunk: str) -> str:
        text = self.held + chunk
        undecided = _UNDECIDED.search(text)
        self.held = text[undecided.start() :] if undecided else ""
        return self._decided(text[: len(text) - len(self.held)])

    def flush(self) -> str:
        """What was held back when the stream ends; an open block stays dropped."""
        rest, self.held = self.held, ""
        return self._decided(rest)

    def _decided(self, text: str) -> str:
        """The part of a text outside of blocks; no tag reaches beyond its end."""
        shown, at = [], 0
        while at < len(text):
            found = (_INSIDE if self.inside else _OUTSIDE).match(text, at)
            if found is None:  # a block that isn't closed yet
                break
            at = found.end()
            if self.inside or found["tag"]:
                self.inside = not self.inside
                self.fresh = True
                continue
            kept = found["text"].lstrip() if self.fresh else found["text"]
            if kept:
                shown.append(kept)
                self.fresh = False
        return "".join(shown)
