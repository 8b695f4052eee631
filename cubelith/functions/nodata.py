"""Arithmetic whose missing value is NULL and whose other values follow IEEE.

Spark orders NaN above everything and equal to itself, raises on division by zero, and
gives NULL where IEEE gives an infinity; these helpers settle it in one place: no expression
made here returns NaN.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = math.inf


def col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def clean(c: Column) -> Column:
    """NaN becomes NULL."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def divide(a, b) -> Column:
    a, b = col(a).cast("double"), col(b).cast("double")
    by_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return clean(F.when(b == 0, by_zero).otherwise(F.try_divide(a, b)))


def modulo(a, b) -> Column:
    """Remainder with the sign of the divisor; none for a divisor of 0."""
    a, b = col(a), col(b)
    return F.when(b != 0, a - F.floor(F.try_divide(a.cast("double"), b.cast("double"))) * b)


def power(a, b) -> Column:
    return clean(F.pow(col(a).cast("double"), col(b).cast("double")))


def compare(how: str, a, b) -> Column:
    """0 or 1 as float; a missing side compares as NaN does."""
    a, b = col(a), col(b)
    found = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[how]
    return F.coalesce(found.cast("float"), F.lit(1.0 if how == "!=" else 0.0).cast("float"))


def _log(f, pole: float):
    def of(c: Column) -> Column:
        x = c.cast("double")
        return F.when(x == pole, F.lit(-INF)).when(x > pole, f(x))

    return of


def _plain(f):
    return lambda c: clean(f(c.cast("double")))


def lgamma(c: Column) -> Column:
    """log of the absolute gamma function: Stirling's series after a shift of 8, reflected below 1/2."""
    x = c.cast("double")

    def stirling(z: Column) -> Column:
        shift = F.lit(0.0)
        for i in range(8):
            shift = shift + F.ln(z + i)
        w = z + 8
        r = 1 / (w * w)
        return (w - 0.5) * F.ln(w) - w + 0.5 * math.log(2 * math.pi) + (1 / w) * (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) - shift

    mirrored = F.ln(F.lit(math.pi) / F.abs(F.sin(math.pi * x))) - stirling(1 - x)
    pole = (x <= 0) & (x == F.floor(x))
    return F.when(pole, F.lit(INF)).when(x < 0.5, mirrored).otherwise(stirling(x))


def gamma(c: Column) -> Column:
    x = c.cast("double")
    sign = F.when((x < 0) & (F.pmod(F.floor(x), F.lit(2)) == 1), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when((x <= 0) & (x == F.floor(x)), F.lit(None).cast("double")).otherwise(sign * F.exp(lgamma(x)))


def digamma(c: Column) -> Column:
    """Asymptotic series after a shift of 8; reflected below 1/2; missing at the poles."""
    x = c.cast("double")

    def series(z: Column) -> Column:
        shift = F.lit(0.0)
        for i in range(8):
            shift = shift + 1 / (z + i)
        w = z + 8
        r = 1 / (w * w)
        return F.ln(w) - 0.5 / w - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - shift

    pole = (x <= 0) & (x == F.floor(x))
    return F.when(~pole & (x < 0.5), series(1 - x) - math.pi / F.tan(math.pi * x)).when(~pole, series(x))


def trigamma(c: Column) -> Column:
    x = c.cast("double")

    def series(z: Column) -> Column:
        shift = F.lit(0.0)
        for i in range(8):
            shift = shift + 1 / ((z + i) * (z + i))
        w = z + 8
        r = 1 / (w * w)
        return 1 / w + 0.5 * r + (1 / w) * r * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * (5 / 66))))) + shift

    pole = (x <= 0) & (x == F.floor(x))
    return F.when(~pole & (x < 0.5), (math.pi / F.sin(math.pi * x)) * (math.pi / F.sin(math.pi * x)) - series(1 - x)).when(~pole, series(x))


# fixed values: coefficients of the published rational approximations of erf (up to 0.46875) and erfc (up to 4, and beyond), highest power first
_ERF = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
_ERFC = ((2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3), (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3))
_ERFC_FAR = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def erf(c: Column) -> Column:
    """Error function, to the precision of doubles."""
    x = c.cast("double")
    a, xx = F.abs(x), x * x

    def ratio(table: tuple, z: Column) -> Column:
        up, down = (reduce(lambda p, k: p * z + k, row[1:], F.lit(row[0])) for row in table)
        return up / down

    far = 1 / xx
    tail = F.exp(-xx) / a * (1 / math.sqrt(math.pi) - far * ratio(_ERFC_FAR, far))
    beyond = F.when(a <= 4, F.exp(-xx) * ratio(_ERFC, a)).when(a < 27, tail).otherwise(0.0)
    return F.when(a <= 0.46875, x * ratio(_ERF, xx)).otherwise(F.signum(x) * (1 - beyond))


def round_half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c.cast("double"), digits)


def signif(c: Column, digits: int = 6) -> Column:
    x = c.cast("double")
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


#: Functions of one cell, by name.  Those of ``KEEPS`` keep an integer type; the others make floats.
MATH = {
    "abs": lambda c: F.abs(c),
    "sign": lambda c: F.signum(c.cast("double")),
    "floor": lambda c: F.floor(c.cast("double")).cast("double"),
    "ceiling": lambda c: F.ceil(c.cast("double")).cast("double"),
    "trunc": lambda c: F.when(c >= 0, F.floor(c.cast("double"))).otherwise(F.ceil(c.cast("double"))).cast("double"),
    "round": round_half_even,
    "signif": signif,
    "sqrt": _plain(F.sqrt),
    "exp": _plain(F.exp),
    "expm1": _plain(F.expm1),
    "log": _log(F.ln, 0.0),
    "log2": _log(F.log2, 0.0),
    "log10": _log(F.log10, 0.0),
    "log1p": _log(F.log1p, -1.0),
    "cos": _plain(F.cos),
    "sin": _plain(F.sin),
    "tan": _plain(F.tan),
    "cospi": _plain(lambda x: F.cos(x * math.pi)),
    "sinpi": _plain(lambda x: F.sin(x * math.pi)),
    "tanpi": _plain(lambda x: F.tan(x * math.pi)),
    "acos": _plain(F.acos),
    "asin": _plain(F.asin),
    "atan": _plain(F.atan),
    "cosh": _plain(F.cosh),
    "sinh": _plain(F.sinh),
    "tanh": _plain(F.tanh),
    "acosh": _plain(F.acosh),
    "asinh": _plain(F.asinh),
    "atanh": lambda c: F.when(c == 1, F.lit(INF)).when(c == -1, F.lit(-INF)).otherwise(clean(F.atanh(c.cast("double")))),
    "gamma": gamma,
    "lgamma": lgamma,
    "digamma": digamma,
    "trigamma": trigamma,
    "erf": erf,
}
KEEPS = {"abs", "sign", "floor", "ceiling", "trunc", "round", "signif"}
