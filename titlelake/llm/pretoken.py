"""The byte-level pattern cut of a text into words, as the public 50k vocabulary's files state it.

Most texts take the standard library's engine, whose classes agree with the
pattern's unless a text holds numbers other than decimal digits; those texts
take the ``regex`` module.  White space is listed in full in both, since the
engines differ on the control characters 0x1C-0x1F.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import regex

# The contractions of the pattern and Unicode's white space.
CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # the hyphen makes a range

# Letters come first, as the most frequent: no other kind can match where they do.
_ASCII = re.compile(rf" ?[A-Za-z]+|{CONTRACTIONS}| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_PLAIN = re.compile(rf" ?[^\W\d_]+|{CONTRACTIONS}| ?\d+| ?(?:[^\w{SPACES}]|_)+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_FULL = regex.compile(rf" ?\p{{L}}+|{CONTRACTIONS}| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def odd_characters() -> frozenset:
    """Characters that the two engines class differently (numbers that are no decimal digits, above all)."""
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    plain_l, plain_n = re.compile(r"[^\W\d_]"), re.compile(r"\d")
    every = (c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() or unicodedata.category(c)[0] in "LN")
    return frozenset(c for c in every if bool(letter.match(c)) != bool(plain_l.match(c)) or bool(number.match(c)) != bool(plain_n.match(c)))


_odd: frozenset | None = None


def words(text: str) -> list[str]:
    """The pieces of the text in order; joined they are the text."""
    global _odd
    if text.isascii():
        return _ASCII.findall(text)
    if _odd is None:
        _odd = odd_characters()
    return (_PLAIN if _odd.isdisjoint(set(text)) else _FULL).findall(text)
