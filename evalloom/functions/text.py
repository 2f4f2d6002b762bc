"""Text functions as Spark columns: tokens, words, hashes, letter forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that count as white space between words.
WHITESPACE = "\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
# Letters and digits of Unicode.
ALNUM = "\\p{L}\\p{N}"


def words(text: Column) -> Column:
    """The words of a text, separated by any Unicode white space; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WHITESPACE}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, single characters left out.

    Case folding follows Unicode, so the four code points that fold into a-z (dotted and dotless I, long s,
    Kelvin sign) count as letters too.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?iu)[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(found, lambda t: F.char_length(t) > 1), lambda t: F.lower(t))


def ascii_token_count(text: Column) -> Column:
    """How many longest runs of two or more ASCII letters and digits a text has."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]{2,}"))


def is_blank(text: Column) -> Column:
    """Whether a text is missing or nothing but white space of any kind."""
    return F.coalesce(text.rlike(f"^[{WHITESPACE}]*\\z"), F.lit(True))


def letters_only(text: Column) -> Column:
    """The letters and digits of a text, in order and in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{ALNUM}]+", "")


def spaced_words(text: Column) -> Column:
    """Longest stretches of letters and digits in lower case, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{ALNUM}]+", " "))


def content_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def digest16(text: Column) -> Column:
    """The first 128 bits of a text's SHA-256, as binary."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def hashed_bucket(token: Column, width: int = 128) -> Column:
    """The slot of a token in a hashed vector: the first four bytes of its SHA-256, modulo the width."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint") % width).cast("int")


def hashed_sign(token: Column) -> Column:
    """1.0 if the fifth byte of the token's SHA-256 is odd, else -1.0."""
    byte = F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("bigint")
    return F.when(byte % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
