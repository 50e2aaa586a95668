"""Typed entity keys as binary columns whose byte order is the order of their values.

A key is the entity type, a zero byte, a tag, and the value: text and bytes as they are, numbers
big-endian (signed ones with the sign bit flipped).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tag of each value type.
TAGS = {"string": 1, "u16": 2, "u32": 3, "i64": 4, "u64": 5, "uuid": 6, "ipv4": 7, "ipv6": 8, "bytes": 9}
#: Bytes of each type of fixed width.
WIDTHS = {"u16": 2, "u32": 4, "i64": 8, "u64": 8, "uuid": 16, "ipv4": 4, "ipv6": 16}

_HALF = 1 << 32


def _big_endian(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))


def _value_bytes(value: Column, kind: str) -> Column:
    if kind == "string":
        return F.encode(value, "utf-8")
    if kind in ("uuid", "ipv6", "bytes"):
        return value.cast("binary")
    if kind == "i64":
        high = F.shiftrightunsigned(value.cast("bigint"), 32).bitwiseXOR(F.lit(1 << 31).cast("bigint"))
        low = value.cast("bigint").bitwiseAND(F.lit(_HALF - 1).cast("bigint"))
        return F.concat(_big_endian(high, 4), _big_endian(low, 4))
    if kind == "u64":
        whole = value.cast("decimal(20,0)")
        return F.concat(_big_endian(F.floor(whole / _HALF), 4), _big_endian(whole % _HALF, 4))
    return _big_endian(value, WIDTHS[kind])


def encode_key(entity_type: Column, value: Column, kind: str) -> Column:
    """The key of ``value``; an error if the type holds a zero byte or a value of fixed width has another length."""
    body = _value_bytes(value, kind)
    good = ~F.contains(entity_type, F.lit("\0"))
    if kind in WIDTHS:
        good = good & (F.octet_length(body) == WIDTHS[kind])
    key = F.concat(F.encode(entity_type, "utf-8"), F.unhex(F.lit(f"00{TAGS[kind]:02X}")), body)
    return F.when(good, key).when(value.isNull() | entity_type.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit(f"invalid {kind} key")))


def _parts(key: Column) -> tuple[Column, Column, Column]:
    """Position of the separator (1-based, 0 if missing), tag, and value bytes."""
    at = F.instr(F.decode(key, "iso-8859-1"), "\0")
    tag = F.conv(F.hex(F.substring(key, at + 1, F.lit(1))), 16, 10).cast("int")
    return at, tag, F.substring(key, at + 2, F.octet_length(key))


def valid_key(key: Column) -> Column:
    at, tag, body = _parts(key)
    widths = F.create_map(*[F.lit(x) for k, w in WIDTHS.items() for x in (TAGS[k], w)])
    width = F.try_element_at(widths, tag)
    return (at > 0) & tag.between(1, len(TAGS)) & (width.isNull() | (width == F.octet_length(body)))


def key_type(key: Column) -> Column:
    """The entity type of a key, null where the bytes are no key."""
    at, _, _ = _parts(key)
    return F.when(valid_key(key), F.decode(F.substring(key, F.lit(1), at - 1), "utf-8"))


def decode_key(key: Column, kind: str) -> Column:
    """The value of a key of ``kind``; null for bytes that are no key, or a key of another kind."""
    at, tag, body = _parts(key)
    number = lambda b: F.conv(F.hex(b), 16, 10)
    if kind == "string":
        value = F.decode(body, "utf-8")
    elif kind in ("uuid", "ipv6", "bytes"):
        value = body
    elif kind == "i64":
        high = number(F.substring(body, 1, 4)).cast("bigint").bitwiseXOR(F.lit(1 << 31).cast("bigint"))
        value = F.shiftleft(high, 32).bitwiseOR(number(F.substring(body, 5, 4)).cast("bigint"))
    elif kind == "u64":
        value = number(body).cast("decimal(20,0)")
    else:
        value = number(body).cast("bigint")
    return F.when(valid_key(key) & (tag == TAGS[kind]), value)


def sort_part(key: Column) -> Column:
    """What keys are ordered by: tag, then value bytes; the entity type is not part of it."""
    at, _, _ = _parts(key)
    return F.substring(key, at + 1, F.octet_length(key))
