"""Text columns: normalisation, code points, bytes, whole-token array edits."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Code point ranges whose members are NFC on their own, have combining class 0 and never
# compose with what stands before them. Text inside them needs no normalisation.
# (checked against unicodedata in tests/test_text.py)
NFC_SAFE_RANGES = (
    (0x0000, 0x02FF),  # Latin
    (0x0400, 0x0482),  # Cyrillic letters
    (0x048A, 0x052F),  # Cyrillic supplement
    (0x1E00, 0x1EFF),  # Latin extended additional (Vietnamese)
    (0x2010, 0x2027),  # dashes, quotes
    (0x2030, 0x205E),  # punctuation
    (0x3001, 0x3029),  # CJK punctuation
    (0x3041, 0x3096),  # Hiragana
    (0x30A1, 0x30FA),  # Katakana
    (0x4E00, 0x9FFF),  # CJK unified ideographs
    (0xAC00, 0xD7A3),  # Hangul syllables
    (0xFF01, 0xFF5E),  # full-width forms
)

_BEYOND_LATIN = r"[\x{300}-\x{10FFFF}]"
_ALL_SAFE = r"\A[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in NFC_SAFE_RANGES) + r"]*+\z"

# Letters, digits and underscore of any script; the word counter counts runs of them.
WORD_PATTERN = r"[\p{L}\p{N}_]+"

# What Python's str.strip() removes, as a character class.
_PY_SPACE = (r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
             r"\x{202F}\x{205F}\x{3000}")
BLANK_PATTERN = f"^[{_PY_SPACE}]*$"


@F.pandas_udf(StringType())
def _nfc_batch(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def nfc(text: Column) -> Column:
    """NFC form of a column.

    Spark has no normaliser, so the rare rows that may need one go to an Arrow batch; every
    other row sends a null and keeps its own value. One scan, and the text of plain rows
    never leaves the JVM. The cheap one-range test comes first and settles Latin text.
    """
    suspect = F.when(text.rlike(_BEYOND_LATIN) & ~text.rlike(_ALL_SAFE), text)
    return F.coalesce(_nfc_batch(suspect), text)


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def char_count(text: Column) -> Column:
    """Code points (of text already in NFC)."""
    return F.char_length(text).cast("bigint")


def byte_count(text: Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(text).cast("bigint")


def word_count(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("bigint")


def ascii_count(text: Column) -> Column:
    """Code points that are ASCII: what an ASCII-only vocabulary can decode again."""
    return F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", "")).cast("bigint")


def code_points(text: Column) -> Column:
    """UTF-32 token ids, one per code point."""
    ids = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(ids)


def from_code_points(ids: Column) -> Column:
    """Inverse of :func:`code_points`."""
    words = F.transform(ids, lambda i: F.lpad(F.hex(i), 8, "0"))
    return F.decode(F.unhex(F.array_join(words, "")), "UTF-32")


def strip_space(text: Column) -> Column:
    """Python's str.strip()."""
    return F.regexp_replace(text, f"^[{_PY_SPACE}]+|[{_PY_SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return text.rlike(BLANK_PATTERN)


def split_lines(text: Column, keep_terminal: bool = False) -> Column:
    """Positional lines of a text: any newline style, no filtering.

    The empty piece after a terminal newline is dropped unless ``keep_terminal`` is set.
    """
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    if keep_terminal:
        return lines
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def remove_subsequence(ids: Column, sub: list[int]) -> Column:
    """Drop every whole-token occurrence of ``sub`` from a token array, left to right.

    Each token becomes ``,id,`` so that a match can neither begin nor end inside a longer id.
    The work stays in one linear string replace.
    """
    fenced = F.concat(F.lit(","), F.array_join(ids.cast("array<string>"), ",,"), F.lit(","))
    needle = "," + ",,".join(str(i) for i in sub) + ","
    left = F.replace(fenced, F.lit(needle), F.lit(""))
    left = F.when(F.size(ids) == 0, F.lit("")).otherwise(left)
    kept = F.filter(F.split(left, ","), lambda s: s != "")
    return F.transform(kept, lambda s: s.cast("bigint"))


def unknown_count(n_tokens: Column, n_chars: Column, n_known_chars: Column) -> Column:
    """Tokens that stand for unknown text, from the share of characters that do not decode.

    Truncated toward zero and never negative; null for empty text. The product is taken in
    decimals, so it stays exact for whole corpora.
    """
    lost = (n_chars - n_known_chars).cast("decimal(19,0)")
    share = F.call_function("div", n_tokens.cast("decimal(19,0)") * lost,
                            F.nullif(n_chars, F.lit(0)).cast("decimal(19,0)"))
    return F.when(n_chars > 0, F.greatest(F.lit(0).cast("bigint"), share.cast("bigint")))
