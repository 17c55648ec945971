"""Words of a text as bytes: maximal runs of ASCII letters and digits and of all characters beyond ASCII, with only A-Z lower-cased."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

_KEPT = {c: c for c in [*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]}
_KEPT |= {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_TABLE = bytes(_KEPT.get(c, 32) for c in range(256))
PIECE = 1 << 20


def words(text: str) -> Iterator[list[bytes]]:
    """All words in order, in lists of about a megabyte of text, so that a very long text is never a list of all its words."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def counted(text: str, known: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Number of words, and how often each known one occurs, by its number."""
    n, found = 0, Counter()
    for part in words(text):
        n += len(part)
        found.update(map(known.get, part))
    found.pop(None, None)
    return n, found
