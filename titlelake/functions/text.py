"""Text column functions.

Each function maps Column -> Column with built-in expressions only, so it
stays inside whole-stage codegen. Regex classes are written so that Java
regex (Spark) and RE2 (DuckDB oracles) read them the same way.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes: ASCII whitespace, the information
# separators 0x1C-0x1F, NEL and every Unicode separator (Zs, Zl, Zp) -- as a
# regex class (used for splitting and by the SQL oracles) and as the literal
# set of all 29 code points (used by ``trim``).
STRIP_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}]"
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
              + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
STRIP_RE = rf"^{STRIP_CLASS}+|{STRIP_CLASS}+\z"
# Line boundaries of Python's str.splitlines().
LINE_BREAK_CLASS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
# Python's Unicode \w: letters, numbers and underscore.
NON_WORD_RE = r"[^\p{L}\p{N}_]+"

# The English stop-word list of the language heuristic.
ENGLISH_STOPWORDS = (
    "the", "and", "you", "your", "for", "this", "that", "with", "from",
    "about", "what", "when", "how", "why", "who", "into", "over", "under",
)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_strip(x) -> Column:
    """Null -> '', strip Unicode whitespace at both ends.

    ``trim`` with an explicit character set: native, one reference to its
    input (nested strips do not multiply the expression tree)."""
    return F.coalesce(F.trim(_c(x).cast("string"), F.lit(WHITESPACE)), F.lit(""))


def not_blank(x) -> Column:
    """``safe_strip(x) != ""``, which looks at the beginning only: a strip of the other end goes through the whole text."""
    return F.coalesce(F.ltrim(_c(x).cast("string"), F.lit(WHITESPACE)), F.lit("")) != ""


def normalize_title(t) -> Column:
    """Lower-case, runs of non [a-z0-9] -> one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(t), F.lit(""))), "[^a-z0-9]+", " "))


def title_len(t) -> Column:
    """Length in code points, null -> 0."""
    return F.length(F.coalesce(_c(t), F.lit("")))


def ascii_letter_ratio(t) -> Column:
    """Share of ASCII letters; empty -> 0."""
    s = F.coalesce(_c(t), F.lit(""))
    return F.length(F.regexp_replace(s, "[^A-Za-z]", "")) / F.greatest(F.length(s), F.lit(1))


def word_tokens(t) -> Column:
    """Lower-cased Unicode word tokens (Python ``\\w+``)."""
    parts = F.split(F.lower(F.coalesce(_c(t), F.lit(""))), NON_WORD_RE)
    return F.filter(parts, lambda x: x != "")


def has_stopword(t, stopwords: Iterable[str] = ENGLISH_STOPWORDS) -> Column:
    """P10: any token in the stop-word list."""
    return F.arrays_overlap(word_tokens(t), F.array(*[F.lit(w) for w in stopwords]))


def is_english_like(t, min_ratio: float = 0.6, stopwords: Iterable[str] = ENGLISH_STOPWORDS) -> Column:
    """ASCII-letter ratio >= min_ratio OR a stop word present (empty -> False)."""
    s = F.coalesce(_c(t), F.lit(""))
    return (s != "") & ((ascii_letter_ratio(s) >= min_ratio) | has_stopword(s, stopwords))


def contains_any(t, patterns: Iterable[str], mode: str = "literal", case_insensitive: bool = True) -> Column:
    """Does the text contain any of the patterns.

    ``mode="literal"`` is a plain substring test. ``mode="regex"`` treats each
    pattern as a regular expression, which reproduces pattern lists written
    for regex matching (so ``"live |"`` matches every text).
    """
    s = F.coalesce(_c(t), F.lit(""))
    if case_insensitive:
        s = F.lower(s)
    out = F.lit(False)
    for p in patterns:
        p2 = p.lower() if case_insensitive else p
        hit = s.rlike(p2) if mode == "regex" else F.contains(s, F.lit(p2))
        out = out | hit
    return out


def first_line(x) -> Column:
    """Text up to the first line boundary (Python ``splitlines()[0]``)."""
    return F.element_at(F.split(F.coalesce(_c(x), F.lit("")), LINE_BREAK_CLASS, 2), 1)


def clean_prediction(raw) -> Column:
    """P20: strip, first line, strip, strip '"' then "'" runs at both ends."""
    line = safe_strip(first_line(safe_strip(raw)))
    no_dq = F.regexp_replace(line, '^"+|"+\\z', "")
    return F.regexp_replace(no_dq, "^'+|'+\\z", "")


def join_snippets(arr) -> Column:
    """Strip every snippet, drop blanks, join with one space."""
    stripped = F.transform(_c(arr), lambda s: safe_strip(s))
    return safe_strip(F.array_join(F.filter(stripped, lambda s: s != ""), " "))


def fmt4(x) -> Column:
    """null/NaN -> 'nan', else four decimals."""
    v = _c(x).cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit("nan")).otherwise(F.format_string("%.4f", v))
