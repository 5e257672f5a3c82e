"""Pre-tokenization shared by the token operators."""

from __future__ import annotations

import re
from functools import cache

import regex

#: Letters, numbers and white space below U+0250, as the Unicode classes have them there (fixed values).
_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = r"\t-\r \x85\xa0"
#: White space of all planes (fixed values).
_ALL_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN_END = "\u0250"


def is_latin(text: str) -> bool:
    return not text or text.isascii() or max(text) < LATIN_END


@cache
def _plain(pattern: str) -> re.Pattern:
    """The pattern for texts below U+0250; ``re`` is several times as fast as ``regex``.

    A word of letters can't begin like any other branch, so it is tried first.
    """
    branches = pattern.split("|")
    first = [b for b in branches if "\\p{L}+" in b and "^" not in b]
    ordered = "|".join([*first, *(b for b in branches if b not in first)])
    ordered = ordered.replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}")
    inside = ordered.replace("[^\\s\\p{L}\\p{N}]", f"[^{_SPACES}{_LETTERS}{_NUMBERS}]")
    inside = inside.replace("\\p{L}", f"[{_LETTERS}]").replace("\\p{N}", f"[{_NUMBERS}]")
    return re.compile(inside.replace("\\s+(?!\\S)", f"[{_SPACES}]+(?![^{_SPACES}])").replace("\\s", f"[{_SPACES}]"))


@cache
def _full(pattern: str) -> regex.Pattern:
    spaces = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{_ALL_SPACES}\\p{{L}}\\p{{N}}]")
    return regex.compile(spaces.replace("\\S", f"[^{_ALL_SPACES}]").replace("\\s", f"[{_ALL_SPACES}]"))


def pretokens(text: str, pattern: str) -> list[str]:
    """Every match of ``pattern`` (of letters, numbers, white space and the rest) in ``text``."""
    return (_plain(pattern) if is_latin(text) else _full(pattern)).findall(text)
