"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number_or(value: Column | str, default: float | int = 0.0) -> Column:
    """Numeric reading of any column; what does not parse becomes ``default``."""
    return F.coalesce(_c(value).try_cast("double"), F.lit(float(default)))


def clip01(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def round_half_even(value: Column, digits: int = 0) -> Column:
    """Round the scaled double half to even, as array libraries do."""
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def flag(condition: Column) -> Column:
    """1/0 as TINYINT, with null read as false."""
    return F.coalesce(condition, F.lit(False)).cast("tinyint")


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    return F.when(bottom != 0, top.cast("double") / bottom).otherwise(F.lit(empty))


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp, whatever the session zone."""
    return F.timestamp_diff(
        "MICROSECOND",
        F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
        _c(ts).cast("timestamp_ntz"),
    )


def add_seconds(base: Column | str, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, _c(base).cast("timestamp_ntz"))


def add_micros(base: Column | str, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, _c(base).cast("timestamp_ntz"))


def first_reasons(rules: list[tuple[str, Column]], limit: int | None = None) -> Column:
    """Names of the rules that hold, in rule order, at most ``limit`` of them."""
    held = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))
    return held if limit is None else F.slice(held, 1, limit)
