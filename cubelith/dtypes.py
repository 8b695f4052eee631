"""Data types of cells and how they combine.

Catalyst's own widening does not decide: operators cast to what these rules give.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .errors import CubeError

#: Name, Spark type, and the type that carries it where Spark has none of its own.
_SPARK = {
    "f32": T.FloatType(),
    "f64": T.DoubleType(),
    "i8": T.ByteType(),
    "i16": T.ShortType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "u8": T.ShortType(),
    "u16": T.IntegerType(),
    "u32": T.LongType(),
    "u64": T.DoubleType(),
    "pred": T.BooleanType(),
}


def valid(dtype: str) -> bool:
    return dtype in _SPARK


def spark_type(dtype: str) -> T.DataType:
    if not valid(dtype):
        raise CubeError(f"unknown dtype {dtype!r}")
    return _SPARK[dtype]


def _parts(dtype: str) -> tuple[str, int]:
    if not valid(dtype):
        raise CubeError(f"unknown dtype {dtype!r}")
    if dtype == "pred":
        return "p", 0
    kind, width = re.fullmatch(r"([fiu])(\d+)", dtype).groups()
    return kind, int(width)


def promote(a: str, b: str, division: bool = False) -> str:
    """Type of an operation on ``a`` and ``b``.

    Floats win; among floats, or integers of one family, the wider wins; a predicate gives way;
    signed with unsigned is signed of twice the unsigned width, at most 64; signed with u64 is f64.
    Division of integers is f32, or f64 if one has 64 bits.
    """
    (ka, wa), (kb, wb) = _parts(a), _parts(b)
    if division and ka != "f" and kb != "f":
        return "f64" if max(wa, wb) == 64 else "f32"
    if ka == "f" or kb == "f":
        return f"f{max(w for k, w in ((ka, wa), (kb, wb)) if k == 'f')}"
    if ka == "p" or kb == "p":
        return b if ka == "p" else a
    if ka == kb:
        return f"{ka}{max(wa, wb)}"
    signed, unsigned = (wa, wb) if ka == "i" else (wb, wa)
    if unsigned == 64:
        return "f64"
    return f"i{min(64, max(signed, 2 * unsigned))}"


def floating(dtype: str) -> str:
    """The float type of a function that makes floats."""
    return promote(dtype, "i8", division=True)


def with_scalar(dtype: str, value: float | int | bool, division: bool = False) -> str:
    """Scalars are weakly typed: they never widen, but a fraction makes an integer float."""
    if division:
        return floating(dtype)
    if isinstance(value, float) and not value.is_integer() and _parts(dtype)[0] != "f":
        return floating(dtype)
    return "i32" if dtype == "pred" else dtype


def of_reduction(op: str, dtype: str) -> str:
    if op in ("mean", "median", "quantile", "sd", "var"):
        return floating(dtype)
    return {"count": "i32", "any": "pred", "all": "pred"}.get(op, dtype)


def integer_range(dtype: str) -> tuple[int, int]:
    kind, width = _parts(dtype)
    if kind not in "iu":
        raise CubeError(f"{dtype} is no integer type")
    return (0, 2**width - 1) if kind == "u" else (-(2 ** (width - 1)), 2 ** (width - 1) - 1)
