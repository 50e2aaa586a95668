"""The comparison of the rule language: as integers if both sides are, else by bytes."""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}

_INTEGER = "^[+-]?[0-9]([0-9_]*[0-9])?$"


def as_integer(text: Column) -> Column:
    """The 64-bit integer that ``text`` is written as, else null."""
    return F.when(text.rlike(_INTEGER), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"))


def integer_of(text: str) -> int | None:
    if not re.match(_INTEGER, text) or text.endswith("\n"):
        return None
    value = int(text.replace("_", ""))
    return value if -(1 << 63) <= value < 1 << 63 else None


def compare(left: Column | str, op: str, right: Column | str, integers: tuple[Column | None, Column | None] = (None, None)) -> Column:
    """``left op right`` where a str is a constant. A constant that is no integer leaves a plain, pushable text comparison.

    ``integers`` are those of the two columns' texts where the caller has them already.
    """
    test = OPERATORS[op]
    numbers, texts = [], []
    for side, known in zip((left, right), integers, strict=True):
        if isinstance(side, str):
            value = integer_of(side)
            numbers.append(None if value is None else F.lit(value).cast("bigint"))
            texts.append(F.lit(side))
        else:
            numbers.append(as_integer(side) if known is None else known)
            texts.append(side)
    plain = test(texts[0], texts[1])
    if None in [None if n is None else 1 for n in numbers]:
        return plain
    both = numbers[0].isNotNull() & numbers[1].isNotNull()
    return F.when(both, test(numbers[0], numbers[1])).otherwise(plain)
