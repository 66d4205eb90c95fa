"""Numeric functions of the dialects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_degrees(f, x: Column) -> Column:
    """ACOSD, ASIND, ATAND: an inverse function's angle in degrees."""
    return F.degrees(f(x))


def of_degrees(f, x: Column) -> Column:
    """SIND, COSD, TAND, COTD: a function of degrees."""
    return f(F.radians(x))


def log(base: Column, x: Column) -> Column:
    """LOG(base, x); null outside its domain, as in MariaDB."""
    return F.when((base > 0) & (base != 1) & (x > 0), F.ln(x) / F.ln(base))


def bit_at(n: Column, place: int) -> Column:
    """GET_BIT, places from the lowest bit."""
    return F.shiftright(n, place).bitwiseAND(F.lit(1)).cast("int")


def with_bit(n: Column, place: int, bit: int) -> Column:
    """SET_BIT."""
    mask = 1 << place
    return n.bitwiseOR(F.lit(mask)) if bit else n.bitwiseAND(F.lit(~mask))


def in_base(n: Column, base: int) -> Column:
    """CONV(n, 10, base), BIN, OCT, TO_BIN, TO_OCT, in lower case."""
    return F.lower(F.conv(n.cast("string"), 10, base))


def scale(x: Column) -> Column:
    """Digits after the point of a decimal's text (SCALE)."""
    text = x.cast("string")
    return F.when(x.isNotNull(), F.when(F.instr(text, ".") > 0, F.length(F.substring_index(text, ".", -1))).otherwise(0))


def trim_scale(x: Column) -> Column:
    """A decimal as text without zeros at its end (TRIM_SCALE)."""
    text = x.cast("string")
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def min_scale(x: Column) -> Column:
    """MIN_SCALE."""
    return F.when(x.isNotNull(), F.when(F.instr(trim_scale(x), ".") > 0, F.length(F.substring_index(trim_scale(x), ".", -1))).otherwise(0))


def format_bytes(n: Column) -> Column:
    """FORMAT_BYTES."""
    text = F.format_string("%d bytes", n.cast("long"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        text = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", n / float(1024**power))).otherwise(text)
    return text


#: Lanczos' coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0 (LGAMMA)."""
    y = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (y + i)
    t = y + 7.5
    return F.when(x > 0, 0.9189385332046727 + (y + 0.5) * F.ln(t) - t + F.ln(total))


def gamma(x: Column) -> Column:
    """GAMMA for x > 0."""
    return F.exp(lgamma(x))


#: Cody's rational approximations of erf and erfc (1969) up to 0.46875, up to 4 and beyond, numerators
#: and denominators from the highest power.
NEAR = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
MIDDLE = ((2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3), (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3))
FAR = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346047, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def _ratio(of: tuple[tuple[float, ...], tuple[float, ...]], x: Column) -> Column:
    over, under = (reduce(lambda total, c: total * x + c, rest, F.lit(first)) for first, *rest in of)
    return over / under


def erf(x: Column) -> Column:
    """The error function (ERF), some thirty multiplications a row; 1 - erf(x) is ERFC."""
    y = F.abs(x)
    far = F.exp(-y * y) / y * (0.5641895835477563 - _ratio(FAR, 1 / (y * y)) / (y * y))
    some = F.when(y <= 4, F.exp(-y * y) * _ratio(MIDDLE, y)).when(y < 6, far).otherwise(0.0)
    return F.when(y <= 0.46875, x * _ratio(NEAR, x * x)).otherwise(F.signum(x) * (1 - some))


def greatest(*xs: Column) -> Column:
    """GREATEST of MariaDB: null if any is null."""
    ok = F.lit(True)
    for x in xs:
        ok = ok & x.isNotNull()
    return F.when(ok, F.greatest(*xs))


def least(*xs: Column) -> Column:
    """LEAST of MariaDB: null if any is null."""
    ok = F.lit(True)
    for x in xs:
        ok = ok & x.isNotNull()
    return F.when(ok, F.least(*xs))


def divide_integers(a: Column, b: Column) -> Column:
    """a / b of integers in PostgreSQL and SQLite: cut towards zero. Null for division by zero, as in SQLite."""
    return F.when(b != 0, F.call_function("div", a, b))
