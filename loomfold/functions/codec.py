"""Bytes of operations: variable-length integers, values, operations; as Arrow maps over columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomfold.session import ship, spread

#: What the first byte of an operation says.
UPSERT, DELETE = 0, 1


class DecodeError(ValueError):
    pass


def put_uint(v: int) -> bytes:
    """Seven bits a byte, lowest first, the top bit saying that more follow; the ninth byte has eight."""
    if not 0 <= v < 1 << 64:
        raise ValueError("not an unsigned 64-bit integer")
    out = bytearray()
    while len(out) < 8 and v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def get_uint(b: bytes, at: int = 0) -> tuple[int, int]:
    """(value, next place). Spellings that are longer than need be are errors."""
    out = 0
    for i in range(9):
        if at + i >= len(b):
            raise DecodeError("ends within an integer")
        x = b[at + i]
        last = i == 8 or x < 0x80
        if last and x == 0 and i:
            raise DecodeError("integer longer than need be")
        out |= (x if i == 8 else x & 0x7F) << 7 * i
        if last:
            return out, at + i + 1
    raise AssertionError


def put_int(v: int) -> bytes:
    return put_uint((v << 1 ^ v >> 63) & (1 << 64) - 1)


def get_int(b: bytes, at: int = 0) -> tuple[int, int]:
    u, at = get_uint(b, at)
    return (u >> 1) ^ -(u & 1), at


def put_value(kind: int, v) -> bytes:
    if kind == 2:
        if not isinstance(v, int) or not -(2**63) <= v < 2**63:
            raise ValueError("not a signed 64-bit integer")
        return put_int(v)
    if kind == 1:
        if not isinstance(v, str) or "\0" in v:
            raise ValueError("not text without NUL")
        v = v.encode()
    if not isinstance(v, (bytes, bytearray)):
        raise ValueError("not bytes")
    if kind == 3:
        if len(v) != 16:
            raise ValueError("a uuid has 16 bytes")
        return bytes(v)
    return put_uint(len(v)) + bytes(v)


def get_value(kind: int, b: bytes, at: int):
    if kind == 2:
        return get_int(b, at)
    n, at = (16, at) if kind == 3 else get_uint(b, at)
    if at + n > len(b):
        raise DecodeError("ends within a value")
    v = b[at : at + n]
    if kind == 1:
        try:
            v = v.decode("utf-8")
        except UnicodeDecodeError as e:
            raise DecodeError("text that isn't UTF-8") from e
        if "\0" in v:
            raise DecodeError("text with NUL")
    return v, at + n


def key_kinds(table_id: int) -> list[int]:
    return [table_id >> 12 - 2 * i & 3 for i in range((table_id >> 14) + 1)]


def encode_op(table_id: int, key: list, sets: list[tuple[int, object]] | None, nulls: list[int] | None) -> bytes:
    """An upsert, or a delete if ``sets`` is None."""
    kinds = key_kinds(table_id)
    if len(kinds) != len(key):
        raise ValueError("wrong number of key values")
    out = bytes([DELETE if sets is None else UPSERT]) + table_id.to_bytes(2, "little") + b"".join(put_value(k, v) for k, v in zip(kinds, key))
    if sets is not None:
        out += put_uint(len(sets)) + b"".join(bytes([c]) + put_value(c >> 6, v) for c, v in sets)
        out += put_uint(len(nulls or ())) + bytes(nulls or ())
    return out


def decode_op(b: bytes) -> tuple[int, list, list[tuple[int, object]] | None, list[int] | None]:
    """(table_id, key, sets, nulls); sets and nulls are None for a delete. Unknown tags and trailing bytes are errors."""
    if len(b) < 3:
        raise DecodeError("ends within the head")
    if b[0] not in (UPSERT, DELETE):
        raise DecodeError(f"unknown tag {b[0]}")
    table_id, at, key = int.from_bytes(b[1:3], "little"), 3, []
    for kind in key_kinds(table_id):
        v, at = get_value(kind, b, at)
        key.append(v)
    sets = nulls = None
    if b[0] == UPSERT:
        sets = []
        n, at = get_uint(b, at)
        for _ in range(n):
            if at >= len(b):
                raise DecodeError("ends within a column")
            c = b[at]
            v, at = get_value(c >> 6, b, at + 1)
            sets.append((c, v))
        n, at = get_uint(b, at)
        if at + n > len(b):
            raise DecodeError("ends within the nulls")
        nulls, at = list(b[at : at + n]), at + n
    if at != len(b):
        raise DecodeError("trailing bytes")
    return table_id, key, sets, nulls


def _general(kind: int, v) -> dict:
    names = "btiu"
    return {n: (v if names.index(n) == kind else None) for n in names}


def _special(v: dict):
    return next((v[n] for n in "btiu" if v[n] is not None), None)


_GENERAL = pa.struct([("b", pa.binary()), ("t", pa.string()), ("i", pa.int64()), ("u", pa.binary())])
_VALUE = "struct<b:binary,t:string,i:bigint,u:binary>"


def encode_ops(ops: DataFrame, carry: list[str]) -> DataFrame:
    """(carry..., body, error) of operations in general form (table_id, kind, pk, sets, nulls)."""
    ship(ops.sparkSession)
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies, errors = [], []
            for r in b.select(list(b.schema.names[n:])).to_pylist():
                try:
                    sets = None if r["kind"] == "D" else [(s["column_id"], _special(s["value"])) for s in r["sets"] or ()]
                    bodies.append(encode_op(r["table_id"], [_special(v) for v in r["pk"]], sets, r["nulls"]))
                    errors.append(None)
                except ValueError as e:
                    bodies.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(bodies, pa.binary()), pa.array(errors, pa.string())], [*carry, "body", "error"])

    fields = "".join(f"`{c}` {ops.schema[c].dataType.simpleString()}, " for c in carry)
    return spread(ops.select(*carry, "table_id", "kind", "pk", "sets", "nulls")).mapInArrow(run, f"{fields}body binary, error string")


def decode_ops(rows: DataFrame, body: str, carry: list[str]) -> DataFrame:
    """(carry..., table_id, kind, pk, sets, nulls, error) of encoded operations; an error leaves the rest null."""
    ship(rows.sparkSession)
    n = len(carry)
    sets_type = pa.list_(pa.struct([("column_id", pa.int32()), ("value", _GENERAL)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("table_id", "kind", "pk", "sets", "nulls", "error")}
            for x in b.column(n).to_pylist():
                try:
                    if x is None:
                        raise DecodeError("no bytes")
                    table_id, key, sets, nulls = decode_op(x)
                    row = (table_id, "D" if sets is None else "U", [_general(k, v) for k, v in zip(key_kinds(table_id), key)], [{"column_id": c, "value": _general(c >> 6, v)} for c, v in sets or ()], nulls or [], None)
                except DecodeError as e:
                    row = (None, None, None, None, None, str(e))
                for c, v in zip(out, row):
                    out[c].append(v)
            types = [pa.int32(), pa.string(), pa.list_(_GENERAL), sets_type, pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(v, t) for v, t in zip(out.values(), types)]], [*carry, *out])

    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carry)
    return spread(rows.select(*carry, body)).mapInArrow(run, f"{fields}table_id int, kind string, pk array<{_VALUE}>, sets array<struct<column_id:int,value:{_VALUE}>>, nulls array<int>, error string")
