"""Further dialect functions: quoting, bit sets, periods, divisors, patterns and JSON kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def space(n: Column) -> Column:
    """n spaces (SPACE)."""
    return F.repeat(F.lit(" "), n)


def quote_literal(text: Column) -> Column:
    """text as an SQL string (QUOTE_LITERAL); null stays null."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_nullable(text: Column) -> Column:
    """As quote_literal, but null is the word NULL (QUOTE_NULLABLE)."""
    return F.coalesce(quote_literal(text), F.lit("NULL"))


def quote_ident(text: Column) -> Column:
    """text as an SQL identifier, in double quotes unless it is a plain lower-case name (QUOTE_IDENT)."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike("^[a-z_][a-z0-9_]*$"), text).otherwise(quoted)


def make_set(bits: Column, *options: str) -> Column:
    """The options whose bit is set, joined by commas (MAKE_SET)."""
    chosen = [F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(o)) for i, o in enumerate(options)]
    return F.when(bits.isNotNull(), F.concat_ws(",", *chosen))


def export_set(bits: Column, on: str, off: str, separator: str = ",", n: int = 64) -> Column:
    """`on` or `off` for each of n bits, the lowest first (EXPORT_SET)."""
    each = [F.when(F.shiftright(bits, i).bitwiseAND(F.lit(1)) == 1, F.lit(on)).otherwise(F.lit(off)) for i in range(n)]
    return F.when(bits.isNotNull(), F.concat_ws(separator, *each))


#: Euclid's algorithm on 64-bit integers ends within so many steps.
_STEPS = 92


def gcd(a: Column, b: Column) -> Column:
    """The greatest common divisor (GCD)."""
    begin = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % s["y"]).alias("y")))

    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), begin, step, lambda s: s["x"]))


def lcm(a: Column, b: Column) -> Column:
    """The least common multiple (LCM), 0 if either is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(_div(F.abs(a), gcd(a, b)) * F.abs(b))


def period_add(period: Column, n: Column | int) -> Column:
    """A yyyymm period n months on (PERIOD_ADD)."""
    months = _div(period, 100) * 12 + period % 100 - 1 + n
    return _div(months, 12) * 100 + months % 12 + 1


def period_diff(a: Column, b: Column) -> Column:
    """Months from the yyyymm period b to a (PERIOD_DIFF)."""
    return (_div(a, 100) - _div(b, 100)) * 12 + a % 100 - b % 100


#: The day number of 1970-01-01 counted from the year 0.
EPOCH_DAYS = 719528


def to_days(day: Column) -> Column:
    """Days since the year 0 (TO_DAYS)."""
    return F.unix_date(day.cast("date")) + EPOCH_DAYS


def from_days(n: Column) -> Column:
    """The date of a day number (FROM_DAYS)."""
    return F.date_from_unix_date((n - EPOCH_DAYS).cast("int"))


def make_date(year: Column, day_of_year: Column) -> Column:
    """The n-th day of a year, null for n below 1 (MAKEDATE)."""
    return F.when(day_of_year >= 1, F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day_of_year - 1).cast("int")))


def regexp_match(text: Column, pattern: str, groups: int) -> Column:
    """The groups of the first match as an array, null without one (REGEXP_MATCH)."""
    return F.when(text.rlike(pattern), F.array(*(F.regexp_extract(text, pattern, i) for i in range(1, groups + 1))))


def json_kind(text: Column) -> Column:
    """object, array, string, boolean, null or number (JSONB_TYPEOF); of text that is valid JSON."""
    head = F.substring(F.ltrim(text), 1, 1)
    kinds = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}
    kind = F.lit("number")
    for sign, name in kinds.items():
        kind = F.when(head == sign, name).otherwise(kind)
    return F.when(text.isNotNull(), kind)


def json_entries(text: Column) -> Column:
    """The entries of a JSON object as an array of (key, value), values as text (JSONB_EACH_TEXT)."""
    return F.map_entries(F.from_json(text, "map<string,string>"))
