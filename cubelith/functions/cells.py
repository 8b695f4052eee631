"""The vocabulary of cell expressions: choices, casts, bits, decoders, axes as arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dtypes
from ..errors import WriteError
from .nodata import clean, col


def ifelse(cond, yes, no) -> Column:
    """``yes`` where ``cond`` is true and not 0; a missing condition chooses ``no``."""
    c = col(cond)
    return F.when(F.coalesce(c.cast("double") != 0, F.lit(False)), col(yes)).otherwise(col(no))


def is_nodata(c: Column) -> Column:
    return c.isNull()


def fill(value: float, like: Column) -> Column:
    """A plane of one value."""
    del like
    return F.lit(value)


def clamp(c: Column, lo, hi) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, col(lo)), col(hi)))


def cast(c: Column, dtype: str) -> Column:
    """Integers take whole numbers towards zero and are missing out of range."""
    if dtype in ("f32", "f64"):
        return c.cast(dtypes.spark_type(dtype))
    if dtype == "pred":
        return c.cast("double") != 0
    lo, hi = dtypes.integer_range(dtype)
    whole = F.when(c >= 0, F.floor(c.cast("double"))).otherwise(F.ceil(c.cast("double")))
    return F.when(whole.between(lo, hi), whole).try_cast(dtypes.spark_type(dtype))


def quantize(c: Column, dtype: str, scale: float = 1.0, offset: float = 0.0, nodata: float | None = None) -> Column:
    """Digital numbers: ``(v - offset) / scale`` rounded half to even, clamped to the type, missing as ``nodata``."""
    lo, hi = dtypes.integer_range(dtype)
    if nodata is not None and not lo <= nodata <= hi:
        raise WriteError(f"nodata {nodata} does not fit {dtype}")
    dn = clamp(F.bround((c.cast("double") - offset) / scale, 0), float(lo), float(hi))
    return (dn if nodata is None else F.coalesce(dn, F.lit(float(nodata)))).cast(dtypes.spark_type(dtype))


def dequantize(c: Column, scale: float = 1.0, offset: float = 0.0, nodata: float | None = None) -> Column:
    """Values of digital numbers; the sentinel goes before scale and offset are applied."""
    v = c.cast("double")
    if nodata is not None:
        v = F.when(v != nodata, v)
    return v * scale + offset


def bit_and(a, b) -> Column:
    return col(a).bitwiseAND(col(b))


def bit_or(a, b) -> Column:
    return col(a).bitwiseOR(col(b))


def bit_xor(a, b) -> Column:
    return col(a).bitwiseXOR(col(b))


def bit_not(a) -> Column:
    return F.bitwise_not(col(a))


def shift_left(a, n: int) -> Column:
    return F.shiftleft(col(a), n)


def shift_right(a, n: int) -> Column:
    """Logical: zeros come in from the left."""
    return F.shiftrightunsigned(col(a), n)


def qa_bits(*bits: int):
    """A predicate of quality words: any of the bits is set; a missing word is clear."""
    mask = reduce(lambda a, b: a | 1 << b, bits, 0)
    return lambda c: F.coalesce(c.cast("long").bitwiseAND(F.lit(mask)) > 0, F.lit(False))


def in_values(values):
    return lambda c: F.coalesce(c.isin(list(values)), F.lit(False))


def dequantize_aef(c: Column) -> Column:
    """Embedding bytes to values: the signed square of v / 127.5."""
    v = c.cast("double") / 127.5
    return v * F.abs(v)


def dequantize_esd(c: Column, level: int, levels: tuple[int, ...] = (8, 8, 8, 5, 5, 5)) -> Column:
    """One component of a code of mixed radix, centred to about -1 to 1."""
    base = reduce(lambda a, b: a * b, levels[:level], 1)
    own, half = levels[level], levels[level] // 2
    code = F.pmod(F.floor(c.cast("double") / base), F.lit(own))
    return (code - half) / F.lit(float(half))


# An axis as an array of a row


def stack(*values) -> Column:
    return F.array(*[col(v) for v in values])


def slice_axis(a: Column, begin: int, end: int) -> Column:
    """Places ``begin`` to ``end``, from 1, both included."""
    return F.slice(a, begin, end - begin + 1)


def concat_axis(*arrays: Column) -> Column:
    return F.concat(*arrays)


def repeat(a, n: int) -> Column:
    return F.array_repeat(col(a), n)


def item(a: Column, i: int) -> Column:
    """The value at place ``i``, from 1; missing beyond the end."""
    return F.try_element_at(a, F.lit(i))


def scan(a: Column, init: Column, body, reverse: bool = False) -> Column:
    """``body(carry, x) -> (carry, out)`` over an array; the outs, each at its place."""
    source = F.reverse(a) if reverse else a

    def step(s, x):
        carry, out = body(s["carry"], x)
        return F.struct(carry.alias("carry"), F.array_append(s["out"], out).alias("out"))

    probe = body(init, F.lit(0.0))[1]
    start = F.struct(init.alias("carry"), F.slice(F.array(probe), 1, 0).alias("out"))
    outs = F.aggregate(source, start, step, lambda s: s["out"])
    return F.reverse(outs) if reverse else outs


def nan_to_null(c: Column) -> Column:
    return clean(c)
