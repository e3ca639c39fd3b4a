"""Words of one text as bytes, in lists of bounded size."""

from __future__ import annotations

import re
from collections.abc import Iterator

_CAPITALS, _SMALL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_BLANK = re.compile(rb"\s")
_ALNUM = frozenset(b"0123456789" + _CAPITALS + _SMALL)

#: Words end at space and U+0009 to U+000D; A-Z count as a-z.
BY_BLANKS = bytes.maketrans(_CAPITALS, _SMALL)
#: Words are runs of 0-9, a-z and signs beyond U+007F; A-Z count as a-z.
BY_LETTERS = bytes(
    BY_BLANKS[b] if b in _ALNUM or b > 0x7F else 0x20 for b in range(256)
)


def word_lists(text: bytes | None, table: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order; each list holds those of about ``limit`` bytes."""
    text = (text or b"").translate(table)
    start = 0
    while start < len(text):
        blank = _BLANK.search(text, start + limit)
        stop = blank.start() if blank else len(text)
        yield text[start:stop].split()
        start = stop
