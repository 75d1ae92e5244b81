"""Text rules as Columns, with the meaning that Python's str methods have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which str.isspace() holds.
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"
# The characters for which str.isdigit() holds, within the basic plane.
DIGIT = r"[\p{Nd}²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]"
# The same for Java alone: most characters fail the three plain ranges, which hold every digit, and are not looked up.
DIGIT_FAST = rf"[[0-9²³¹\x{{660}}-\x{{10FFFF}}]&&{DIGIT}]"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once: named in a lambda directly, it would be for each element."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def text_of(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c, F.lit(""))


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{IsUppercase}") & ~c.rlike(r"[\p{IsLowercase}\p{Lt}]")


def is_digits(c: Column) -> Column:
    return c.rlike(f"^{DIGIT}+$")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def word_set(c: Column) -> Column:
    """Distinct lower-case words, first seen first."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(c)), F.lit(WORD), F.lit(0)))


def split_spaces(c: Column) -> Column:
    """Split at runs of two or more white-space characters."""
    return F.split(c, SPACE + "{2,}")


def preview(c: Column, n: int) -> Column:
    """The first n characters, with dots where there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def keywords(c: Column) -> Column:
    """Distinct words of three letters or more, Cyrillic or Latin, compared in lower case; the first form seen stays."""
    found = F.regexp_extract_all(text_of(c), F.lit("[а-яА-ЯёЁa-zA-Z]{3,}"), F.lit(0))
    first = lambda words, lowered: F.transform(F.array_distinct(lowered), lambda w: F.get(words, F.array_position(lowered, w).cast("int") - 1))
    return let(found, lambda words: let(F.transform(words, lambda w: F.lower(w)), lambda lowered: first(words, lowered)))


def file_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(c), r"(?<=.)\.[^.]*$", "")
