"""Self-describing ids as column expressions, and the names made of them.

A table id has 16 bits: two for the number of key columns less one, two for each key column's
type, the rest an index. A column id has 8 bits: two for the type, six for the index.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The type tags in their order.
TYPES = ("bytes", "text", "i64", "uuid")


def _bits(c: Column, shift: int | Column, mask: int | Column) -> Column:
    shifted = F.call_function("shiftright", c, shift if isinstance(shift, Column) else F.lit(shift))
    return shifted.bitwiseAND(mask if isinstance(mask, Column) else F.lit(mask))


def key_count(table_id: Column) -> Column:
    return _bits(table_id, 14, 3) + 1


def key_type(table_id: Column, place: int) -> Column:
    """Type tag of the key column at a place; null beyond the key."""
    return F.when(key_count(table_id) > place, _bits(table_id, 12 - 2 * place, 3))


def table_index(table_id: Column) -> Column:
    """The bits that count and types leave: 12, 10, 8 or 6."""
    ones = F.expr("array(4095, 1023, 255, 63)")
    return table_id.bitwiseAND(F.element_at(ones, key_count(table_id)))


def pack_table_id(index: Column, types: list[Column]) -> Column:
    """The id of a table with these key types; null if the index is too large or the key has no or over four columns."""
    if not 1 <= len(types) <= 4:
        return F.lit(None).cast("int")
    out = F.lit(len(types) - 1 << 14) + index
    for i, t in enumerate(types):
        out = out + F.shiftleft(t, 12 - 2 * i)
    return F.when((index >= 0) & (index < 1 << 14 - 2 * len(types)), out.cast("int"))


def column_type(column_id: Column) -> Column:
    return _bits(column_id, 6, 3)


def column_index(column_id: Column) -> Column:
    return column_id.bitwiseAND(63)


def pack_column_id(kind: Column, index: Column) -> Column:
    """An index over 63 loses its upper bits."""
    return F.shiftleft(kind, 6).bitwiseOR(index.bitwiseAND(63)).cast("int")


def type_name(tag: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), tag.cast("int") + 1)


def table_name(prefix: str, table_id: Column) -> Column:
    return F.format_string(f"{prefix}__t0x%04x", table_id.cast("int"))


def column_name(column_id: Column, stamp: bool = False) -> Column:
    return F.format_string("c0x%02x_lww" if stamp else "c0x%02x", column_id.cast("int"))


def parse_table_name(prefix: str, name: Column) -> Column:
    """The id in a table's name; null if it has another form."""
    hexed = F.regexp_extract(name, rf"^{prefix}__t0x([0-9a-f]{{4}})$", 1)
    return F.when(hexed != "", F.conv(hexed, 16, 10).cast("int"))


def parse_column_name(name: Column) -> Column:
    hexed = F.regexp_extract(name, r"^c0x([0-9a-f]{2})(?:_lww)?$", 1)
    return F.when(hexed != "", F.conv(hexed, 16, 10).cast("int"))
