"""Words as runs of letters, in lower case, at the speed of bytes.translate for Latin-1 texts."""

from __future__ import annotations

import re

_LETTERS = re.compile(r"[^\W\d_]+").findall
_TABLE = bytes(c if _LETTERS(chr(c)) else 32 for c in range(256))


def letter_words(text: str) -> list[str]:
    """The runs of letters of a text in lower case, in order."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(_TABLE).decode("latin-1").split()
    except UnicodeEncodeError:
        return _LETTERS(low)
