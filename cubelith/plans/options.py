"""Options of the engine: validated keys of the session's configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import OptionError

PREFIX = "spark.cubelith."


def _positive(v: str) -> int:
    n = int(v)
    if n < 1:
        raise ValueError
    return n


def _choice(*of: str):
    def check(v: str) -> str:
        if v not in of:
            raise ValueError
        return v

    return check


#: name: (default, check, meaning)
OPTIONS = {
    "tile": ("256", _positive, "side of a tile of neighbourhood functions"),
    "focalPath": ("auto", _choice("auto", "cells", "tiles"), "path of linear neighbourhood operators"),
    "readFail": ("error", _choice("error", "nodata"), "whether an unreadable file stops the query or reads as missing"),
    "previewSize": ("256", _positive, "longest side of a preview"),
}


def get(spark: SparkSession, name: str):
    if name not in OPTIONS:
        raise OptionError(f"unknown option {name!r}")
    default, check, _ = OPTIONS[name]
    raw = spark.conf.get(PREFIX + name, default)
    try:
        return check(raw)
    except ValueError:
        raise OptionError(f"{name}: {raw!r} is not allowed") from None


def put(spark: SparkSession, **values) -> None:
    for name, v in values.items():
        if name not in OPTIONS:
            raise OptionError(f"unknown option {name!r}")
        try:
            OPTIONS[name][1](str(v))
        except ValueError:
            raise OptionError(f"{name}: {v!r} is not allowed") from None
        spark.conf.set(PREFIX + name, str(v))


def table(spark: SparkSession) -> dict:
    return {n: get(spark, n) for n in OPTIONS}
