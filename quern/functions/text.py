"""Further text, array, UUID and enum functions of the dialects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find_in_set(word: Column, words: Column) -> Column:
    """FIND_IN_SET: the place of a word among comma-separated ones, 0 if it is none or has a comma."""
    return F.find_in_set(word, words)


def substring_index(text: Column, separator: str, n: int) -> Column:
    """SUBSTRING_INDEX: what is before the n-th separator, or after the n-th from the end."""
    return F.substring_index(text, separator, n)


def trim_chars(text: Column, chars: str, side: str = "both") -> Column:
    """LTRIM, RTRIM, BTRIM with a set of characters; TRIM(LEADING | TRAILING | BOTH ... FROM ...)."""
    kind = {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[side]
    return kind(text, F.lit(chars))


def quote(text: Column) -> Column:
    """QUOTE of MariaDB: backslashes before backslash, quote and newline zero; NULL for null."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.coalesce(F.concat(F.lit("'"), escaped, F.lit("'")), F.lit("NULL"))


def ordinal(text: Column) -> Column:
    """ORD: the first character's UTF-8 bytes as a number."""
    return F.conv(F.hex(F.encode(F.substring(text, 1, 1), "UTF-8")), 16, 10).cast("long")


def character(n: Column) -> Column:
    """CHR of PostgreSQL: the character of a code point of up to 16 bits."""
    low = F.concat(F.lpad(F.hex(n), 4, "0"))
    return F.decode(F.unhex(low), "UTF-16BE")


def sformat(pattern: str, *values: Column) -> Column:
    """SFORMAT: {} in turn by each value."""
    parts = pattern.split("{}")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [value.cast("string"), F.lit(part)]
    return F.concat(*out)


def regexp_instr(text: Column, pattern: str) -> Column:
    """REGEXP_INSTR: the 1-based place of the first match, 0 without one."""
    return F.when(text.rlike(pattern), F.locate_of(text, pattern)) if hasattr(F, "locate_of") else F.regexp_instr(text, F.lit(pattern))


def is_uuid(text: Column) -> Column:
    """IS_UUID: 32 hexadecimal digits, with dashes or without."""
    return F.lower(text).rlike("^([0-9a-f]{32}|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$")


def uuid_to_bin(text: Column) -> Column:
    return F.unhex(F.replace(text, F.lit("-"), F.lit("")))


def bin_to_uuid(data: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(data)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid_version(text: Column) -> Column:
    """UUID_EXTRACT_VERSION."""
    return F.conv(F.substring(F.replace(text, F.lit("-"), F.lit("")), 13, 1), 16, 10).cast("int")


def array_positions(values: Column, wanted: Column) -> Column:
    """ARRAY_POSITIONS: all 1-based places."""
    return F.filter(F.transform(values, lambda x, i: F.when(x.eqNullSafe(wanted), i + 1)), lambda x: x.isNotNull())


def array_replace(values: Column, old: Column, new: Column) -> Column:
    """ARRAY_REPLACE."""
    return F.transform(values, lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def array_dims(values: Column) -> Column:
    """ARRAY_DIMS of an array of one dimension; null if it is empty."""
    return F.when(F.size(values) > 0, F.concat(F.lit("[1:"), F.size(values).cast("string"), F.lit("]")))


def enum_range(kinds: list[str], low: str | None = None, high: str | None = None) -> Column:
    """ENUM_RANGE of an enum's values in order; ENUM_FIRST and ENUM_LAST are its ends."""
    begin, end = kinds.index(low) if low else 0, kinds.index(high) + 1 if high else len(kinds)
    return F.array(*map(F.lit, kinds[begin:end]))


def enum_place(value: Column, kinds: list[str]) -> Column:
    """By which an enum's values sort; null for what is none of them."""
    return F.nullif(F.array_position(F.array(*map(F.lit, kinds)), value), F.lit(0))
