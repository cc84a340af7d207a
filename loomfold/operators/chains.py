"""Hash chains of logs: hashes of entries, chains, and the check of stored segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.functions.scalar import HASH_PREFIX, tagged_sha256
from loomfold.session import ship

LOG = ["peer_id", "container"]


def byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2, "0"))


def varint(value: Column) -> Column:
    """Bytes of an integer of at least 0: seven bits each, lowest first, the top bit saying that more follow; the ninth has eight."""
    v = value.cast("bigint")
    parts = []
    for i in range(8):
        group = F.shiftrightunsigned(v, 7 * i).bitwiseAND(0x7F)
        more = v >= F.lit(1 << 7 * (i + 1)) if i < 7 else v >= F.lit(1 << 56)
        b = byte(group.bitwiseOR(F.when(more, 0x80).otherwise(0).cast("bigint")))
        parts.append(b if i == 0 else F.when(v >= F.lit(1 << 7 * i), b).otherwise(F.lit(b"")))
    return F.concat(*parts, F.when(v >= F.lit(1 << 56), byte(F.shiftrightunsigned(v, 56))).otherwise(F.lit(b"")))


def little(value: Column) -> Column:
    """The eight bytes of a bigint, lowest first."""
    return F.concat(*[byte(F.shiftrightunsigned(value.cast("bigint"), 8 * i).bitwiseAND(0xFF)) for i in range(8)])


def _sized(data: Column) -> Column:
    data = F.coalesce(data, F.lit(b""))
    return F.concat(varint(F.octet_length(data)), data)


def entry_hash(kind: Column, peer_id: Column, container: Column, idx: Column, ts: Column, user_id: Column, body: Column, prefix: str = HASH_PREFIX) -> Column:
    """What an entry adds to its chain, by kind: op, use_key (body: suite and fingerprint), expunged (body: the hash itself). Others add nothing."""
    op = tagged_sha256("LogOp", peer_id, container, varint(idx), _sized(little(ts)), _sized(user_id), _sized(body), prefix=prefix)
    key = tagged_sha256("LogUseKey", peer_id, container, varint(idx), body, prefix=prefix)
    return F.when(kind == "op", op).when(kind == "use_key", key).when(kind == "expunged", body)


def active_cipher(kind: Column, body: Column, by: list[str], order: str) -> Column:
    """The cipher in force at an entry, that of the last use_key up to and with it; null if there is none."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(kind == "use_key", body), ignorenulls=True).over(w)


def _name(values: tuple) -> bytes:
    """Binary ids as they are, one after the other; other names as text, parted by zeros."""
    if all(isinstance(v, (bytes, bytearray)) for v in values):
        return b"".join(map(bytes, values))
    return b"\0".join(bytes(v) if isinstance(v, (bytes, bytearray)) else str(v).encode() for v in values)


def _steps(prefix: str):
    seed_tag, tag = (prefix + "ChainSeed").encode().ljust(16, b"\0"), (prefix + "ChainHash").encode().ljust(16, b"\0")
    if len(tag) > 16 or len(seed_tag) > 16:
        raise ValueError("a tag has at most 16 bytes")
    seed = lambda name: hashlib.sha256(seed_tag + _name(name)).digest()
    add = lambda chain, h, cipher: hashlib.sha256(tag + chain + (h or b"") + (b"\1" + cipher if cipher else b"\0")).digest()
    return seed, add


def chain_hashes(entries: DataFrame, by: list[str], order: str, digest: str, prefix: str = HASH_PREFIX, cipher: str | None = None, start: str | None = None) -> DataFrame:
    """(by..., order, chain_hash): the hash chain of every log after each of its entries.

    ``cipher`` names a column with the cipher in force, ``start`` one with the hash that the log
    had before; without it, or where it is null, the log begins with its seed. A chain is
    sequential, so a log stays in one partition, but it flows through sorted and is never
    gathered: a task holds one batch and one hash, however long the log. Logs of which segments
    are stored are checked in parallel by ``verify``.
    """
    ship(entries.sparkSession)
    n = len(by)
    seed, add = _steps(prefix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chain = None, b""
        for b in batches:
            out = []
            names = zip(*[b.column(i).to_pylist() for i in range(n)])
            for name, d, c, s in zip(names, *[b.column(n + i).to_pylist() for i in (1, 2, 3)]):
                if name != last:
                    last, chain = name, s or seed(name)
                chain = add(chain, d, c)
                out.append(chain)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(n + 1)], pa.array(out, pa.binary())], [*by, order, "chain_hash"])

    none = F.lit(None).cast("binary")
    rows = entries.select(*by, order, digest, (F.col(cipher) if cipher else none).alias("_cipher"), (F.col(start) if start else none).alias("_start")).repartition(*by).sortWithinPartitions(*by, order)
    fields = ", ".join(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in [*by, order])
    return rows.mapInArrow(run, f"{fields}, chain_hash binary")


def verify(entries: DataFrame, segments: DataFrame, by: list[str], prefix: str = HASH_PREFIX) -> DataFrame:
    """(by..., start_idx, end_size, intact, linked): stored segments against their entries and the ones before them.

    ``entries`` has (by..., idx, entry_hash, cipher), ``segments`` (by..., start_idx, end_size,
    prev_hash, end_hash). A segment is intact if its entries are there, each once, and lead from
    its first hash to its last; it is linked if it begins with the log's seed or where a segment ends, hash and place. So a
    log is checked by segments in parallel, however long it is. Repeated rows of segments count once, of
    entries too if they are alike.
    """
    ship(entries.sparkSession)
    n = len(by)
    seed, add = _steps(prefix)
    s = segments.select(*by, "start_idx", "end_size", "prev_hash", "end_hash").distinct()
    held = entries.select(*by, "idx", "entry_hash", "cipher").distinct()
    # Entries meet segments slice by slice, as in logs.lookup.
    from loomfold.operators.logs import slices

    pieces, asked = slices(held, s, by, "idx", "start_idx", "end_size")
    met = asked.join(pieces, [*by, "_slice"]).where("start_idx <= idx AND idx < end_size").drop("_slice")
    key = [*by, "start_idx", "end_size", "prev_hash", "end_hash"]
    out = T.StructType([*s.schema, T.StructField("_n", T.LongType()), T.StructField("_intact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, last, chain, at, sound, done = to_arrow_schema(out), None, b"", 0, True, []
        close = lambda: done.append((*last, at - last[n], sound and at == last[n + 1] and chain == last[n + 3])) if last else None
        for b in batches:
            for *name, idx, h, c in zip(*[x.to_pylist() for x in b.columns]):
                name = tuple(name)
                if name != last:
                    close()
                    last, chain, at, sound = name, name[n + 2] or b"", name[n], True
                sound = sound and idx == at
                chain, at = add(chain, h, c), at + 1
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    checked = met.select(*key, "idx", "entry_hash", "cipher").repartition(*key[: n + 2]).sortWithinPartitions(*key, "idx").mapInArrow(run, out)
    ends = s.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("end_size").alias("_at"), F.col("end_hash").alias("_hash")).distinct()
    on = (s["start_idx"] == ends["_at"]) & (s["prev_hash"] == ends["_hash"])
    for c in by:
        on = on & s[c].eqNullSafe(ends[f"_{c}"])
    binary = all(s.schema[c].dataType == T.BinaryType() for c in by)
    name = F.concat(*by) if binary else F.concat(*[x for i, c in enumerate(by) for x in ((F.lit(b"\0"),) if i else ()) + (F.col(c) if s.schema[c].dataType == T.BinaryType() else F.col(c).cast("string").cast("binary"),)])
    first = (F.col("start_idx") == 0) & (F.col("prev_hash") == tagged_sha256("ChainSeed", name, prefix=prefix))
    linked = s.join(ends.withColumn("_linked", F.lit(True)), on, "left").select(*key, (F.coalesce("_linked", F.lit(False)) | F.coalesce(first, F.lit(False))).alias("linked"))
    full = linked.join(checked.drop("_n"), key, "left")
    return full.select(*by, "start_idx", "end_size", F.coalesce("_intact", F.lit(False)).alias("intact"), "linked")
