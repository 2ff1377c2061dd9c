"""Cuts of a text between which byte-level BPE never merges, so that the ids of a chunk depend on the chunk alone.

The published splitting pattern always starts a new piece at a blank that a visible character follows, a newline before
a visible character is a piece of its own, and a run of marks after a letter is one too. Cutting there is plain string
work, and the chunks (words, their marks) repeat often enough to be worth remembering. Special tokens break this where
they follow several blanks, so texts that contain one are not cut here.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Remembered chunks of one Python worker; forgetting them changes no result.
REMEMBERED = 400_000
_RUN = re.compile(r"[ \n](?:\s|\Z)")
_CUT = re.compile(r"([ \n](?=\S))")
_MARKS = ".,!?;:"


def cut(text: str) -> list[str]:
    out: list[str] = []
    if _RUN.search(text):
        pieces = _CUT.split(text)
        out.append(pieces[0])
        for gap, piece in zip(pieces[1::2], pieces[2::2], strict=True):
            out.extend([" " + piece] if gap == " " else ["\n", piece])
        return out
    for line in text.split("\n"):
        first, *words = line.split(" ")
        out += ["\n", first]
        out += [" " + w for w in words]
    return out[1:]


def _core(chunk: str) -> str:
    """The chunk without the marks at its end."""
    core = chunk.rstrip(_MARKS)
    return core if core[-1:].isalpha() else chunk


class Remembered:
    """Ids of chunks by an encoder of many chunks at once. Half of the least recently used are dropped at the limit."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = REMEMBERED) -> None:
        self.encode, self.limit = encode, limit
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _want(self, chunks: set[str]) -> list[str]:
        """Takes what is known into ``now`` and returns the rest."""
        new = []
        for chunk in chunks.difference(self.now):
            if chunk in self.old:
                self.now[chunk] = self.old[chunk]
            else:
                new.append(chunk)
        return new

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """Of each text, given as its chunks."""
        if len(self.now) > self.limit // 2:
            self.old, self.now = self.now, {}
        new = self._want(set().union(*texts))
        cores = {chunk: chunk if chunk[-1:].isalpha() else _core(chunk) for chunk in new}
        parts = {part for chunk, core in cores.items() for part in (core, chunk[len(core) :])}
        unknown = self._want(parts)
        self.now.update(zip(unknown, self.encode(unknown), strict=True))
        for chunk, core in cores.items():
            if core is not chunk:
                self.now[chunk] = self.now[core] + self.now[chunk[len(core) :]]
        get = self.now.__getitem__
        return [b"".join(map(get, chunks)) for chunks in texts]
