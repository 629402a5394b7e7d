"""Cleaning, counting and filtering of post text.

Patterns with classes start with ``(?U)`` so that Java's ``\\s``, ``\\w`` and ``\\d`` follow
Unicode, as they must for ideographic spaces and CJK text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from feltgrid import domain

ZH_CHARS = "[\\u4E00-\\u9FFF]"

# Unicode white space and the four ASCII separators that text cleaning also treats as blanks.
BLANK = r"[\s\x1C-\x1F]"
SOLID = r"[^\s\x1C-\x1F]"

# Removal patterns in the order they must be applied, then the topic unwrap.
REMOVED_PATTERNS = [f"http{SOLID}+", f"回复@{SOLID}+:", f"//@{SOLID}+:", r"\[[^\]]+\]"]
TOPIC_PATTERN = r"#([^#]+)#"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` only removes U+0020)."""
    return F.regexp_replace(text, f"(?U)^{BLANK}+|{BLANK}+$", "")


def blank_to_null(text: Column | str) -> Column:
    """Stripped text, with blanks and the text ``nan`` read as missing."""
    text = strip(as_column(text).cast("string"))
    return F.when((text != "") & (text != "nan"), text)


def has_text(text: Column | str) -> Column:
    return F.coalesce(as_column(text).rlike("(?U)" + SOLID), F.lit(False))


def clean_text(text: Column | str) -> Column:
    text = as_column(text)
    out = F.when(text == "nan", "").otherwise(F.coalesce(text, F.lit("")))
    for pattern in REMOVED_PATTERNS:
        out = F.regexp_replace(out, "(?U)" + pattern, "")
    out = F.regexp_replace(out, TOPIC_PATTERN, "$1")
    return strip(F.regexp_replace(out, f"(?U){BLANK}+", " "))


def count_chars(text: Column | str, char_class: str = ZH_CHARS) -> Column:
    """Number of characters of the class (Chinese characters by default)."""
    return F.regexp_count(as_column(text), F.lit(char_class))


def truncate_raw(text: Column | str, length: int = domain.RAW_TEXT_LENGTH) -> Column:
    return F.substring(as_column(text), 1, length)


def normalise_province(name: Column | str) -> Column:
    """Drop administrative suffixes, each tested once in list order."""
    out = strip(F.coalesce(as_column(name), F.lit("")))
    for suffix in domain.PROVINCE_SUFFIXES:
        out = F.regexp_replace(out, suffix + "$", "")
    short = {"宁夏回族": "宁夏", "广西壮族": "广西", "新疆维吾尔": "新疆"}
    for long_name, short_name in short.items():
        out = F.when(out == long_name, short_name).otherwise(out)
    return out


def is_valid_province(name: Column | str, provinces: Sequence[str] = domain.PROVINCES) -> Column:
    """In the white list and not one of the noise values."""
    name = strip(as_column(name).cast("string"))
    return ~F.lower(name).isin(domain.NOISE_PROVINCES) & name.isin(list(provinces))


def reject_reason(
    created_at: Column | str,
    text: Column | str,
    province: Column | str,
    char_class: str = ZH_CHARS,
    min_chars: int = domain.MIN_ZH_CHARS,
    keep_unknown: bool = False,
) -> Column:
    """First failing check of a post, null when the post is kept.

    ``created_at`` is the parsed timestamp and ``text`` the cleaned text.
    """
    reason = (
        F.when(as_column(created_at).isNull(), "bad_date")
        .when(count_chars(text, char_class) < min_chars, "too_short")
        .when(F.length(as_column(text)) == 0, "empty_content")
    )
    if not keep_unknown:
        reason = reason.when(as_column(province) == domain.UNKNOWN_PROVINCE, "unknown_province")
    return reason


def is_valid_token(word: Column | str, pos: Column | str | None = None) -> Column:
    """Shape and part-of-speech checks of one token; word lists are applied by the caller."""
    word = as_column(word)
    # Cheap tests come first and settle nearly all words without a full match.
    latin = (F.length(word) <= 4) & word.rlike("^[a-zA-Z]{1,4}$")
    symbols = ~word.rlike(r"^\p{L}") & word.rlike(r"(?U)^(?:[\d.]+|[\W_]+)$")
    valid = (F.length(word) >= 2) & ~latin & ~symbols
    if pos is None:
        return valid
    pos = F.coalesce(as_column(pos), F.lit(""))
    return valid & ((pos == "") | pos.isin(domain.POS_KEEP))
