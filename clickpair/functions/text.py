"""Column expressions for cleaning and tokenising pair text (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference:
#   characters kept by the digit cleaner: 0 1 2 3 4 5 6 7 8 9 and the space
#   token separator: one space; empty tokens are kept
#   word pattern of the vectorizers: two or more Unicode letters, digits or '_'
#   padded sequence length: 50
DIGIT_CLEAN = "[^0-9 ]"
SEP = " "
WORD_RE = "[\\p{L}\\p{N}_]{2,}"
PAD_LEN = 50


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_digits(c) -> Column:
    """Keep only the ASCII digits and the space."""
    return F.regexp_replace(_c(c), DIGIT_CLEAN, "")


def strip_tab(c) -> Column:
    """Drop one trailing tab."""
    return F.regexp_replace(_c(c), "\\t\\z", "")


def concat_text(q, t, sep: str | None = SEP) -> Column:
    """``q + sep + t``; ``sep=None`` glues the boundary tokens together."""
    return F.concat(_c(q), _c(t)) if sep is None else F.concat_ws(sep, _c(q), _c(t))


def tokenize(c) -> Column:
    """``str.split(' ')``: keeps empty tokens from repeated/edge spaces."""
    return F.split(_c(c), SEP, -1)


def word_tokens(c) -> Column:
    """Lower-cased Unicode word tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD_RE), 0)


def pad_tokens(tokens, n: int = PAD_LEN, pad: str = "") -> Column:
    """First ``n`` tokens, right-padded with ``pad``."""
    return F.slice(F.concat(_c(tokens), F.array_repeat(F.lit(pad), n)), 1, n)
