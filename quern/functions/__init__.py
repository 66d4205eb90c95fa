"""Functions of the MariaDB, PostgreSQL and SQLite dialects as expressions of Spark columns.

Only those that Spark lacks or means differently are here; the rest are pyspark.sql.functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(value: Column, *options: str) -> Column:
    """The 1-based place of value among the options, 0 if it is null or none (FIELD)."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, options)), value), F.lit(0)).cast("int")


def elt(n: Column, *options: str) -> Column:
    """The n-th option, null outside them (ELT)."""
    return F.when(n.between(1, len(options)), F.element_at(F.array(*map(F.lit, options)), F.greatest(n, F.lit(1)).cast("int")))


def insert_text(text: Column, at: int, length: int, new: str) -> Column:
    """text with `length` characters from `at` replaced (INSERT, OVERLAY)."""
    return F.overlay(text, F.lit(new), at, length)


def strcmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a sorts before, with or after b (STRCMP)."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def initial_upper(text: Column) -> Column:
    """Upper case after anything that is no letter or digit (PostgreSQL's INITCAP)."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), 0)
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x)))), "")


def integer_division(a: Column, b: Column) -> Column:
    """The quotient cut towards zero, null for division by zero (DIV)."""
    return F.when(b != 0, F.call_function("div", a, b))


def truncate(x: Column, digits: int) -> Column:
    """x cut towards zero after `digits` decimals (TRUNCATE, TRUNC)."""
    exact = F.round(x.cast("decimal(38,12)"), 12)
    unit = F.lit(10**digits).cast("decimal(18,0)")
    cut = F.when(x < 0, F.ceil(exact * unit)).otherwise(F.floor(exact * unit))
    return (cut / unit).cast("double")


def since_epoch(ts: Column, unit: str = "SECOND") -> Column:
    """Whole units since 1970, without a time zone (UNIX_TIMESTAMP, EXTRACT(EPOCH))."""
    return F.timestamp_diff(unit, F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def rounded_epoch(ts: Column) -> Column:
    """Seconds since 1970 to the nearest whole one, halves to the even one (an epoch cast to an integer type)."""
    return F.rint(since_epoch(ts, "MICROSECOND") / 1e6).cast("long")


def week_start(ts: Column) -> Column:
    """The Monday of the week (DATE_TRUNC('week'))."""
    return F.to_date(F.date_trunc("week", ts))


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def months_between_whole(start: Column, end: Column) -> Column:
    """Whole months from start to end (TIMESTAMPDIFF(MONTH, ...))."""
    return F.timestamp_diff("MONTH", start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))


def ip_to_number(text: Column) -> Column:
    """The number of a dotted IPv4 address (INET_ATON); null for anything else."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    part = [F.try_element_at(F.split(text, r"\."), F.lit(i)).try_cast("long") for i in range(1, 5)]
    number = part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3]
    return F.when(text.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


def number_to_ip(n: Column) -> Column:
    """The dotted IPv4 address of a number (INET_NTOA)."""
    return F.concat_ws(".", *[F.pmod(F.shiftright(n.cast("long"), s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def json_number(text: Column, path: str) -> Column:
    """The number at a path of a JSON text, null if there is none (JSON_EXTRACT, ->>)."""
    return F.get_json_object(text, path).cast("double")


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null for division by zero, as in MariaDB."""
    return F.when(b != 0, a / b)


#: What each letter of a MariaDB date format means as a Spark date pattern.
DATE_LETTERS = {"Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "j": "DDD", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "p": "a", "T": "HH:mm:ss"}


def date_pattern(text: str) -> str:
    """A MariaDB date format such as %Y-%m-%d as a Spark pattern; other letters are quoted."""
    out, plain, at = [], "", 0

    def quoted() -> str:
        return "'" + plain.replace("'", "''") + "'" if plain else ""

    while at < len(text):
        if text[at] == "%" and at + 1 < len(text):
            letter = text[at + 1]
            if letter in DATE_LETTERS:
                out += [quoted(), DATE_LETTERS[letter]]
                plain = ""
            else:
                plain += letter
            at += 2
        else:
            plain += text[at]
            at += 1
    return "".join([*out, quoted()])


def _ordinal(ts: Column) -> Column:
    day = F.dayofmonth(ts)
    ending = F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd").otherwise("th")
    return F.concat(day.cast("string"), ending)


#: Letters that no Spark pattern has.
OTHER_LETTERS = {
    "l": lambda ts: F.date_format(ts, "h"),
    "D": _ordinal,
    "w": lambda ts: (F.dayofweek(ts) - 1).cast("string"),
    "r": lambda ts: F.date_format(ts, "hh:mm:ss a"),
    "U": lambda ts: F.lpad(F.floor((F.dayofyear(ts) + 6 - (F.dayofweek(ts) - 1)) / 7).cast("string"), 2, "0"),
    "V": lambda ts: F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
    "v": lambda ts: F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
    "x": lambda ts: F.extract(F.lit("YEAROFWEEK"), ts).cast("string"),
}


def date_format(ts: Column, text: str) -> Column:
    """DATE_FORMAT with a MariaDB format; a letter that has no meaning here raises."""
    parts, plain, at = [], "", 0
    while at < len(text):
        two = text[at : at + 2]
        if len(two) == 2 and two[0] == "%":
            if two[1] in OTHER_LETTERS:
                parts += [F.date_format(ts, date_pattern(plain))] if plain else []
                parts.append(OTHER_LETTERS[two[1]](ts))
                plain = ""
            elif two[1] in DATE_LETTERS or two[1] == "%":
                plain += two
            else:
                raise ValueError(f"{two} of DATE_FORMAT")
            at += 2
        else:
            plain += two[0]
            at += 1
    parts += [F.date_format(ts, date_pattern(plain))] if plain or not parts else []
    return F.concat(*parts)


def str_to_date(text: Column, form: str) -> Column:
    """STR_TO_DATE with a MariaDB format; null for what doesn't fit."""
    return F.try_to_timestamp(text, F.lit(date_pattern(form))).cast("timestamp_ntz")


def seconds_to_time(n: Column) -> Column:
    """hh:mm:ss of a number of seconds, with a sign if negative (SEC_TO_TIME)."""
    a = F.abs(n.cast("long"))
    text = F.format_string("%02d:%02d:%02d", F.floor(a / 3600), F.floor(a / 60) % 60, a % 60)
    return F.when(n < 0, F.concat(F.lit("-"), text)).when(n >= 0, text)


def time_to_seconds(text: Column) -> Column:
    """Seconds of hh:mm:ss (TIME_TO_SEC)."""
    part = [F.try_element_at(F.split(text, ":"), F.lit(i)).try_cast("long") for i in (1, 2, 3)]
    return part[0] * 3600 + part[1] * 60 + part[2]


def json_keys(text: Column) -> Column:
    """The keys of a JSON object (JSON_KEYS, JSONB_OBJECT_KEYS)."""
    return F.json_object_keys(text)


def json_put(text: Column, key: str, value: Column) -> Column:
    """A JSON object with one key set to a value of any type, keys in order (JSON_SET, JSONB_SET at the top level)."""
    from . import json

    return json.put(text, [key], F.to_json(F.to_variant_object(F.array(value))).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))


def array_to_text(values: Column, separator: str, null: str | None = None) -> Column:
    """ARRAY_TO_STRING: nulls left out, or as a given text."""
    return F.array_join(values, separator, null) if null is not None else F.array_join(values, separator)


def width_bucket(x: Column, low: float, high: float, n: int) -> Column:
    """The bucket of n equal ones between low and high, 0 below and n + 1 from high on."""
    return F.when(x < low, 0).when(x >= high, n + 1).otherwise(F.floor((x - low) * n / (high - low)) + 1).cast("int")
