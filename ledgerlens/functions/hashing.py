"""Stable salted hashing of strings and the values derived from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.scalar import _c


def stable_hash(value: Column | str, salt: str = "") -> Column:
    """Non-negative 60-bit integer, equal on every engine that has MD5."""
    text = _c(value).cast("string")
    if salt:
        text = F.concat(F.lit(f"{salt}:"), text)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def pick(hashed: Column, choices: Sequence[str]) -> Column:
    options = F.array(*[F.lit(choice) for choice in choices])
    return F.element_at(options, (hashed % len(choices) + 1).cast("int"))


def choose_by_hash(value: Column | str, choices: Sequence[str], salt: str) -> Column:
    return pick(stable_hash(value, salt), choices)


def id_by_hash(value: Column | str, prefix: str, modulo: int, salt: str) -> Column:
    number = (stable_hash(value, salt) % modulo).cast("string")
    return F.concat(F.lit(prefix), F.lpad(number, 7, "0"))


def int_div(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


def fake_ip(hashed: Column) -> Column:
    """Dotted quad in 10-219 . 0-255 . 0-255 . 1-254."""
    parts = (
        hashed % 210 + 10,
        int_div(hashed, 210) % 256,
        int_div(hashed, 210 * 256) % 256,
        int_div(hashed, 210 * 256 * 256) % 254 + 1,
    )
    return F.concat_ws(".", *[part.cast("string") for part in parts])
