"""Pack files: listing, names, headers, bodies, segments.

A pack is a pair of files, header ``<name>.uqp.meta`` and body ``<name>.uqp``, in a folder
``<topic>/<peer>``. The header lists the segments in the body with their places; signatures
are read past and kept, not verified, as keys are no business of the engine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomfold.functions.codec import DecodeError, get_uint, put_uint
from loomfold.functions.scalar import HASH_PREFIX, tagged_sha256
from loomfold.operators import packfiles
from loomfold.operators.references import matching
from loomfold.session import ship, work_folder
from loomfold.sources.versioned import Version, VersionedTable

#: Version of headers, bytes of a signature after its kind, most bytes of a segment's entries, kinds of entries and encodings.
VERSION, SIGNATURE, MOST_PLAIN = 0, 64, 1 << 27
OP, USE_KEY, SIGNED, EXPUNGED = 0, 1, 2, 3
OPAQUE, PLAIN = 0, 1

DESCRIPTOR = "struct<container_id:binary,idx_start:bigint,idx_end:bigint,prev_chain_hash:binary,end_chain_hash:binary,body_start:bigint,body_end:bigint>"
REF = "struct<id:bigint,end_seq:bigint>"
FILE = "struct<seq_start:bigint,seq_end:bigint,id:bigint,generation:bigint>"
HEADER = f"packed_at bigint, parents array<{REF}>, self_supersedes array<{REF}>, self_segments array<{DESCRIPTOR}>, peer_data array<struct<peer_id:binary,supersedes:array<{FILE}>,segments:array<{DESCRIPTOR}>>>, body_sha256 binary, signature binary, error string"


class _In:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise DecodeError("ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def uint(self) -> int:
        v, self.at = get_uint(self.data, self.at)
        return v

    def long(self) -> int:
        return int.from_bytes(self.take(8), "little", signed=True)

    def span(self) -> tuple[int, int]:
        a = self.uint()
        return a, a + self.uint()

    def blob(self) -> bytes:
        return self.take(self.uint())

    def many(self, read) -> list:
        return [read() for _ in range(self.uint())]

    def maybe(self, read):
        return read() if self.byte() else None

    def ref(self) -> dict:
        return {"id": self.long(), "end_seq": self.uint()}

    def file(self) -> dict:
        a, z = self.span()
        return {"seq_start": a, "seq_end": z, "id": self.long(), "generation": self.uint()}

    def descriptor(self) -> dict:
        container, (a, z) = self.take(16), self.span()
        before, after, (x, y) = self.take(32), self.take(32), self.span()
        return {"container_id": container, "idx_start": a, "idx_end": z, "prev_chain_hash": before, "end_chain_hash": after, "body_start": x, "body_end": y}

    def peer(self) -> dict:
        peer, segments = self.take(32), self.many(self.descriptor)
        return {"peer_id": peer, "supersedes": self.many(self.file), "segments": segments}

    def signature(self) -> bytes:
        return self.take(1 + SIGNATURE)

    def cipher(self) -> bytes:
        return self.take(33)


def decode_header(data: bytes) -> dict:
    r = _In(data)
    if (version := r.byte()) != VERSION:
        raise DecodeError(f"unknown version {version}")
    out = {"packed_at": r.uint(), "parents": r.many(r.ref), "self_supersedes": r.many(r.ref), "self_segments": r.many(r.descriptor), "peer_data": r.many(r.peer), "body_sha256": r.take(32), "signature": r.signature()}
    if r.at != len(data):
        raise DecodeError("trailing bytes")
    return out


def _put_span(a: int, z: int) -> bytes:
    if a > z:
        raise ValueError("a range that ends before it begins")
    return put_uint(a) + put_uint(z - a)


def _put_descriptor(d: dict) -> bytes:
    return d["container_id"] + _put_span(d["idx_start"], d["idx_end"]) + d["prev_chain_hash"] + d["end_chain_hash"] + _put_span(d["body_start"], d["body_end"])


def encode_header(h: dict) -> bytes:
    long = lambda v: v.to_bytes(8, "little", signed=True)
    many = lambda items, put: put_uint(len(items)) + b"".join(map(put, items))
    ref = lambda r: long(r["id"]) + put_uint(r["end_seq"])
    file = lambda f: _put_span(f["seq_start"], f["seq_end"]) + long(f["id"]) + put_uint(f["generation"])
    peer = lambda p: p["peer_id"] + many(p["segments"], _put_descriptor) + many(p["supersedes"], file)
    return bytes([VERSION]) + put_uint(h["packed_at"]) + many(h["parents"], ref) + many(h["self_supersedes"], ref) + many(h["self_segments"], _put_descriptor) + many(h["peer_data"], peer) + h["body_sha256"] + h["signature"]


def decode_entries(plain: bytes) -> list[dict]:
    """Entries of a segment in order: op, use_key, expunged; free signatures have no index."""
    r, out, idx = _In(plain), [], 0
    while r.at < len(plain):
        kind = r.byte()
        e = {"place": None if kind == SIGNED else idx, "entry_type": None, "ts": None, "user_id": None, "body": None}
        if kind == OP:
            e |= {"entry_type": "op", "ts": r.long(), "user_id": r.blob(), "body": r.blob()}
        elif kind == USE_KEY:
            e |= {"entry_type": "use_key", "body": r.cipher()}
        elif kind == SIGNED:
            e |= {"entry_type": "signature", "body": r.signature()}
        elif kind == EXPUNGED:
            e |= {"entry_type": "expunged", "body": r.take(32)}
        else:
            raise DecodeError(f"unknown entry {kind}")
        idx += kind != SIGNED
        out.append(e)
    return out


def encode_entries(entries: list[dict]) -> bytes:
    out = b""
    for e in entries:
        if e["entry_type"] == "op":
            out += bytes([OP]) + e["ts"].to_bytes(8, "little", signed=True) + put_uint(len(e["user_id"])) + e["user_id"] + put_uint(len(e["body"])) + e["body"]
        else:
            out += bytes([{"use_key": USE_KEY, "signature": SIGNED, "expunged": EXPUNGED}[e["entry_type"]]]) + e["body"]
    return out


def decode_segment(data: bytes) -> tuple[int, bytes, list[dict] | None]:
    """(size before it, hash before it, entries); entries are None where they are opaque or encrypted."""
    import zstandard

    r = _In(data)
    size, before = r.uint(), r.take(32)
    r.signature()
    encoding = r.byte()
    if encoding not in (OPAQUE, PLAIN):
        raise DecodeError(f"unknown encoding {encoding}")
    encrypted = None
    if encoding == PLAIN:
        encrypted = r.maybe(lambda: (r.maybe(r.cipher), r.blob()))
        if (how := r.byte()) != 0:
            raise DecodeError(f"unknown compression {how}")
    r.maybe(r.cipher)
    if encoding == OPAQUE or encrypted:
        return size, before, None
    try:
        with zstandard.ZstdDecompressor().stream_reader(data[r.at :]) as z:
            plain = z.read(MOST_PLAIN + 1)
    except zstandard.ZstdError as e:
        raise DecodeError(str(e)) from e
    if len(plain) > MOST_PLAIN:
        raise DecodeError("more than 128 MiB")
    return size, before, decode_entries(plain)


def encode_segment(size: int, before: bytes, signature: bytes, entries: list[dict], cipher: bytes | None = None) -> bytes:
    import zstandard

    start = b"\1" + cipher if cipher else b"\0"
    return put_uint(size) + before + signature + bytes([PLAIN, 0, 0]) + start + zstandard.ZstdCompressor().compress(encode_entries(entries))


@dataclass(frozen=True)
class Segment:
    """A decoded segment: the chain before it, its signature, the ciphers it begins with, and its entries (None if it can't be opened)."""

    size: int
    before: bytes
    signature: bytes
    entries: list[dict] | None
    cipher: bytes | None = None


def open_segment(data: bytes) -> Segment:
    r = _In(data)
    size, before, signature = r.uint(), r.take(32), r.signature()
    _, _, found = decode_segment(data)
    if r.byte() == PLAIN:
        r.maybe(lambda: (r.maybe(r.cipher), r.blob()))
        r.byte()
    return Segment(size, before, signature, found, r.maybe(r.cipher))


class Chain:
    """The hash chain of one log, entry by entry; signatures add nothing to it."""

    def __init__(self, peer_id: bytes, container: bytes, size: int = 0, hash_: bytes | None = None, cipher: bytes | None = None, prefix: str = HASH_PREFIX):
        self.log, self.prefix = peer_id + container, prefix
        self.size, self.cipher = size, cipher
        self.hash = hash_ or self._tagged("ChainSeed", self.log)

    def _tagged(self, domain: str, *parts: bytes) -> bytes:
        return hashlib.sha256((self.prefix + domain).encode().ljust(16, b"\0") + b"".join(parts)).digest()

    def add(self, e: dict) -> None:
        if e["entry_type"] == "signature":
            return
        sized = lambda b: put_uint(len(b)) + bytes(b)
        if e["entry_type"] == "op":
            h = self._tagged("LogOp", self.log, put_uint(self.size), sized(e["ts"].to_bytes(8, "little", signed=True)), sized(e["user_id"] or b""), sized(e["body"] or b""))
        elif e["entry_type"] == "use_key":
            self.cipher = bytes(e["body"])
            h = self._tagged("LogUseKey", self.log, put_uint(self.size), self.cipher)
        else:
            h = bytes(e["body"])
        self.hash = self._tagged("ChainHash", self.hash, h, b"\1" + self.cipher if self.cipher else b"\0")
        self.size += 1


def join_segments(peer_id: bytes, container: bytes, bodies: Iterable[bytes], start: int = 0, prefix: str = HASH_PREFIX) -> tuple[bytes, dict]:
    """One segment of several that follow one another, without entries below ``start``, and where it lies in its log.

    Each must begin with the chain that the ones before it lead to. Signatures within are left
    out; that of the last one, which covers all, stays. Raises DecodeError for none, out of order,
    what can't be opened, or a start that isn't within.
    """
    chain, kept, signature, first, cipher = None, [], b"", None, None
    for data in bodies:
        s = open_segment(bytes(data))
        if s.entries is None:
            raise DecodeError("a segment that can't be opened")
        if chain is None:
            chain = Chain(peer_id, container, s.size, s.before, s.cipher, prefix)
            first, cipher = (chain.size, chain.hash), chain.cipher
        elif (s.size, s.before) != (chain.size, chain.hash):
            raise DecodeError("segments that don't follow one another")
        for e in s.entries:
            if e["entry_type"] == "signature":
                continue
            chain.add(e)
            if chain.size <= start:
                first, cipher = (chain.size, chain.hash), chain.cipher
            else:
                kept.append(e)
        signature = s.signature
    if chain is None:
        raise DecodeError("no segments")
    if start and first[0] != start or not kept:
        raise DecodeError("nothing begins there")
    place = {"idx_start": first[0], "idx_end": chain.size, "prev_chain_hash": first[1], "end_chain_hash": chain.hash}
    return encode_segment(*first, signature, kept, cipher), place


def suffix(peer_id: bytes, container: bytes, body: bytes, start: int, prefix: str = HASH_PREFIX) -> tuple[bytes, dict]:
    """A segment without its entries below ``start``."""
    return join_segments(peer_id, container, [body], start, prefix)


def body_hash(body: bytes, prefix: str = HASH_PREFIX) -> bytes:
    return hashlib.sha256((prefix + "PackBody").encode().ljust(16, b"\0") + body).digest()


def _levels(spark: SparkSession, folder: str) -> int:
    """How many levels of folders and files lie below a folder."""
    here = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    while files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder + "/*" * (n + 1))):
        n += 1
    return n


def _files(spark: SparkSession, folder: str, end: str) -> DataFrame:
    """The files with an ending below a folder, however deep, as rows; bytes are read only if ``content`` is used.

    Topics begin with an underscore, which a recursive listing would skip; a glob doesn't.
    """
    places = ",".join("*/" * n + "*" + end for n in range(max(1, _levels(spark, folder))))
    try:
        return spark.read.format("binaryFile").load(f"{folder}/{{{places}}}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file_name, length, modified_at) of the pack headers below a folder, none if it doesn't exist. Bytes aren't read."""
    files = _files(spark, folder, ".uqp.meta")
    return files.select("path", F.regexp_extract("path", "[^/]+$", 0).alias("file_name"), "length", F.col("modificationTime").alias("modified_at"))


def canonical(files: DataFrame) -> DataFrame:
    """Listed files whose name has the one right spelling and a range that isn't empty, with the four numbers."""
    numbers = files.withColumns({c: packfiles.named(F.col("file_name"), i + 1) for i, c in enumerate(packfiles.FILE)})
    spelt = F.format_string("%04x-%04x-%016x-%02x", *packfiles.FILE)
    return numbers.where((F.col("seq_start") < F.col("seq_end")) & F.col("file_name").startswith(spelt))


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded headers of the canonical packs below a folder; those that can't be read have ``error``."""
    ship(spark)
    files = _files(spark, folder, ".uqp.meta")
    names = ["packed_at", "parents", "self_supersedes", "self_segments", "peer_data", "body_sha256", "signature"]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"path string, {HEADER}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows.append({"path": path, **decode_header(data), "error": None})
                except DecodeError as e:
                    rows.append({"path": path, **dict.fromkeys(names), "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    decoded = files.select("path", "content").mapInArrow(run, f"path string, {HEADER}")
    return canonical(decoded.withColumn("file_name", F.regexp_extract("path", "[^/]+$", 0)))


def bodies(spark: SparkSession, folder: str, wanted: DataFrame, prefix: str = HASH_PREFIX) -> DataFrame:
    """Bodies of the ``wanted`` headers (path, body_sha256), with ``intact``: whether the hash is the header's."""
    files = _files(spark, folder, ".uqp")
    key = F.regexp_replace("path", r"\.meta$", "")
    w = wanted.select(key.alias("body_path"), "body_sha256")
    both = files.select(F.col("path").alias("_path"), "content").join(w, F.col("_path") == F.col("body_path"))
    return both.select("body_path", "content", (tagged_sha256("PackBody", F.col("content"), prefix=prefix) == F.col("body_sha256")).alias("intact"))


ENTRIES = "body_path string, idx bigint, entry_type string, ts bigint, user_id binary, body binary, error string"


def entries(read: DataFrame) -> DataFrame:
    """Entries of all segments in intact bodies: ``read`` has (body_path, content, body_start, body_end, idx_start)."""
    ship(read.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ENTRIES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                base = {"body_path": r["body_path"], "idx": None, "entry_type": None, "ts": None, "user_id": None, "body": None, "error": None}
                try:
                    size, _, found = decode_segment(r["content"][r["body_start"] : r["body_end"]])
                    rows += [base | {k: e[k] for k in ("entry_type", "ts", "user_id", "body")} | {"idx": None if e["place"] is None else size + e["place"]} for e in found or ()]
                except DecodeError as e:
                    rows.append(base | {"error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return read.select("body_path", "content", "body_start", "body_end", "idx_start").mapInArrow(run, ENTRIES)


#: Bytes of segments that are joined to one, and of joined ones that a pack is planned for.
CHUNK_BYTES, PACK_BYTES = 8 << 20, 64 << 20
#: What stands for a signature where nobody signs.
UNSIGNED = bytes(1 + SIGNATURE)
BUILT = "pack_no bigint, file_name string, header binary, body binary, published array<struct<branch_id:bigint,published_size:bigint>>, errors array<string>"


def pack_id(by: list[str]) -> Column:
    """The id of a round's pack, from what it is for and its number, so that the next one can name it as its parent."""
    return F.xxhash64(*by, "first_seq", "pack_no")


def build(segments: DataFrame, by: list[str], packed_at: int, prefix: str = HASH_PREFIX, chunk_bytes: int = CHUNK_BYTES, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(by..., BUILT): the packs of a round, for each ``by`` (say, remote and topic) one, or more in a row where one would be too large.

    ``segments`` has by..., author (who packs), first_seq, parents (the tips), branch_id, peer_id,
    container, end_size, published_size and body. Segments of a branch are joined in order, from what
    is published on; a branch's bytes beyond ``chunk_bytes`` make another joined segment, joined
    ones beyond ``pack_bytes`` the next pack, whose parent is the one before. So no task holds more than a
    chunk or a pack, whatever a topic or a branch has to publish. What can't be joined stays out, and what
    follows it in its branch: a row with pack_no -1 and without a pack has the reasons in ``errors``.
    ``published`` has the new marks of a pack's branches.
    """
    ship(segments.sparkSession)
    own = Window.partitionBy(*by, "branch_id").orderBy("end_size").rowsBetween(Window.unboundedPreceding, -1)
    chunked = segments.withColumn("_chunk", F.floor(F.coalesce(F.sum(F.octet_length("body")).over(own), F.lit(0)) / chunk_bytes))
    key, n = [*by, "author", "first_seq", "branch_id", "_chunk", "peer_id", "container"], len(by)
    place = [("idx_start", T.LongType()), ("idx_end", T.LongType()), ("prev_chain_hash", T.BinaryType()), ("end_chain_hash", T.BinaryType()), ("joined", T.BinaryType()), ("error", T.StringType())]
    kinds = {**{c: segments.schema[c].dataType for c in key if c != "_chunk"}, "_chunk": T.LongType()}
    out = T.StructType([*[T.StructField(c, kinds[c]) for c in key], *[T.StructField(c, k) for c, k in place]])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        for name, group in groupby(rows, key=lambda r: r[: len(key)]):
            bodies, starts = zip(*[(r[-1], r[-2]) for r in group])
            # A later chunk goes on where the one before ended.
            start = (starts[0] or 0) if name[n + 3] == 0 else 0
            try:
                joined, at = join_segments(bytes(name[n + 4]), bytes(name[n + 5]), bodies, start, prefix)
                found = [*at.values(), joined, None]
            except DecodeError as e:
                found = [None] * 5 + [str(e)]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*name, *found], schema)], schema=schema)

    spots = chunked.select(*key, "end_size", "published_size", "body").repartition(*by, "branch_id", "_chunk").sortWithinPartitions(*key, "end_size").drop("end_size")
    joined = spots.mapInArrow(join, out)
    # What follows a part that stays out stays out as well, as marks may only go on without a gap.
    line = Window.partitionBy(*by, "branch_id").orderBy("_chunk")
    gap = (F.col("idx_start") != F.lag("idx_end").over(line)) | (F.col("prev_chain_hash") != F.lag("end_chain_hash").over(line))
    joined = joined.withColumn("error", F.coalesce("error", F.when(gap, "segments that don't follow one another")))
    broken = F.max(F.col("error").isNotNull()).over(line.rowsBetween(Window.unboundedPreceding, 0))
    joined = joined.withColumn("error", F.when(broken, F.coalesce("error", F.lit("what comes before it stays out")))).withColumn("joined", F.when(F.col("error").isNull(), F.col("joined")))
    tips = segments.groupBy(*by).agg(F.first("parents", ignorenulls=True).alias("parents"))
    # Places and packs by running sums over the joined segments, of which only the sizes matter here.
    w = Window.partitionBy(*by).orderBy("branch_id", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    slot = F.floor(F.coalesce(F.sum(F.octet_length("joined")).over(w), F.lit(0)) / pack_bytes)
    fits = joined.where("error IS NULL").withColumn("_slot", slot).withColumn("pack_no", F.dense_rank().over(Window.partitionBy(*by).orderBy("_slot")).cast("bigint") - 1).drop("_slot")
    # What stays out is listed by itself.
    numbered = fits.unionByName(joined.where("error IS NOT NULL").withColumn("pack_no", F.lit(-1).cast("bigint")))
    seq = [F.col("first_seq") + F.col("pack_no"), F.col("first_seq") + F.col("pack_no") + 1]
    known = numbered.withColumns({"_id": pack_id(by), "_seq": seq[0], "_before": F.xxhash64(*by, "first_seq", F.col("pack_no") - 1)}).join(tips, by)
    end = T.StructType.fromDDL(BUILT)
    result = T.StructType([*[T.StructField(c, kinds[c]) for c in by], *end])

    def assemble(t: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = sorted(t.to_pylist(), key=lambda r: (r["branch_id"], r["_chunk"]))
        if rows[0]["pack_no"] < 0:
            values = [*[rows[0][c] for c in by], -1, None, None, None, [], [r["error"] for r in rows]]
            return pa.table([pa.array([v], f.type) for v, f in zip(values, to_arrow_schema(result))], schema=to_arrow_schema(result))
        r0, body, own_, peers, marks, at = rows[0], [], [], {}, {}, 0
        for r in rows:
            d = {"container_id": r["container"], **{c: r[c] for c, _ in place[:4]}, "body_start": at, "body_end": at + len(r["joined"])}
            (own_ if r["peer_id"] == r["author"] else peers.setdefault(r["peer_id"], [])).append(d)
            body.append(r["joined"])
            at = d["body_end"]
            marks[r["branch_id"]] = max(marks.get(r["branch_id"], 0), r["idx_end"])
        parents = (r0["parents"] or []) if r0["pack_no"] == 0 else [{"id": r0["_before"], "end_seq": r0["_seq"]}]
        whole = b"".join(body)
        header = {"packed_at": packed_at, "parents": parents, "self_supersedes": [], "self_segments": own_, "peer_data": [{"peer_id": p, "segments": s, "supersedes": []} for p, s in sorted(peers.items())], "body_sha256": body_hash(whole, prefix), "signature": UNSIGNED}
        name = f"{r0['_seq']:04x}-{r0['_seq'] + 1:04x}-{r0['_id'] % (1 << 64):016x}-00"
        values = [*[r0[c] for c in by], r0["pack_no"], name, encode_header(header), whole, [{"branch_id": k, "published_size": v} for k, v in marks.items()], []]
        return pa.table([pa.array([v], f.type) for v, f in zip(values, to_arrow_schema(result))], schema=to_arrow_schema(result))

    return known.groupBy(*by, "pack_no").applyInArrow(assemble, result)


def unpack(built: DataFrame, carry: list[str], prefix: str = HASH_PREFIX) -> DataFrame:
    """(carry..., peer_id, container, idx, entry_type, ts, user_id, body, error) of all entries in packs with ``header`` and ``body``, as a replica reads them.

    ``peer_id`` is null for the packing peer's own logs. What can't be read has ``error`` instead, by these
    reasons, of which the first that holds is given: corrupt_header, bad_body_hash, and for a segment
    needs_upgrade, decode_error, bad_metadata (it isn't what its descriptor says), need_key (it is encrypted).
    """
    ship(built.sparkSession)
    out = T.StructType([*[built.schema[c] for c in carry], *[T.StructField(c, k) for c, k in (("peer_id", T.BinaryType()), ("container", T.BinaryType()), ("idx", T.LongType()), ("entry_type", T.StringType()), ("ts", T.LongType()), ("user_id", T.BinaryType()), ("body", T.BinaryType()), ("error", T.StringType()))]])
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                rows = [(*r[:n], *x) for x in read_pack(r[n], r[n + 1], prefix)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return built.where("header IS NOT NULL").select(*carry, "header", "body").mapInArrow(run, out)


def read_pack(header: bytes, body: bytes | None, prefix: str = HASH_PREFIX) -> Iterator[tuple]:
    """(peer_id, container, idx, entry_type, ts, user_id, body, error) of a pack's entries or of what is wrong with it."""
    none = (None,) * 7
    try:
        h = decode_header(header)
    except DecodeError:
        yield (*none, "corrupt_header")
        return
    if body is None or body_hash(body, prefix) != h["body_sha256"]:
        yield (*none, "bad_body_hash")
        return
    for peer, d in [*[(None, d) for d in h["self_segments"]], *[(p["peer_id"], d) for p in h["peer_data"] for d in p["segments"]]]:
        name = (peer, d["container_id"])
        try:
            s = open_segment(body[d["body_start"] : d["body_end"]])
        except DecodeError as e:
            yield (*name, *none[2:], "needs_upgrade" if "unknown" in str(e) else "decode_error")
            continue
        if s.entries is None:
            yield (*name, *none[2:], "need_key")
            continue
        placed = sum(e["place"] is not None for e in s.entries)
        if (s.size, s.before, s.size + placed) != (d["idx_start"], d["prev_chain_hash"], d["idx_end"]):
            yield (*name, *none[2:], "bad_metadata")
            continue
        for e in s.entries:
            yield (*name, None if e["place"] is None else s.size + e["place"], e["entry_type"], e["ts"], e["user_id"], e["body"], None)


def _file_system(folder: str):
    spark = SparkSession.active()
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return spark, jvm, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_pack(folder: str, name: str, header: dict, body: bytes) -> None:
    """Write a pair of files, whole or not at all, on any file system that Spark reaches: body first, each by rename from a hidden name."""
    spark, jvm, path, files = _file_system(folder)
    files.mkdirs(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    for end, data in ((".uqp", body), (".uqp.meta", encode_header(header))):
        hidden = jvm.org.apache.hadoop.fs.Path(path, f".{name}{end}.part")
        out = files.create(hidden, True)
        out.write(bytearray(data))
        out.hsync()
        out.close()
        context.rename(hidden, jvm.org.apache.hadoop.fs.Path(path, name + end), replace)


def delete_pack(folder: str, name: str) -> None:
    """Remove a pair of files, header first; what is gone already is fine."""
    _, jvm, path, files = _file_system(folder)
    for end in (".uqp.meta", ".uqp"):
        files.delete(jvm.org.apache.hadoop.fs.Path(path, name + end), False)


def publish(built: DataFrame, folder: str) -> list[str]:
    """Write built packs one after the other, each pair whole or not at all; the names written. The driver holds one pack at a time."""
    names = []
    for r in built.where("header IS NOT NULL").select("file_name", "header", "body").toLocalIterator():
        write_pack(folder, r["file_name"], decode_header(bytes(r["header"])), bytes(r["body"]))
        names.append(r["file_name"])
    return names


def blocked(packs: DataFrame, carry: list[str], parents: DataFrame, peers: DataFrame, prefix: str = HASH_PREFIX) -> DataFrame:
    """(carry..., flags, pending_parents, missing_peers): why packs can't be read wholly; those that can aren't listed.

    ``packs`` has ``header`` and ``body``; ``parents`` (id, end_seq) are the packs that were read,
    ``peers`` (peer_id) the known ones. ``flags`` are the reasons that ``unpack`` gives. A caller reads the
    listed packs again with the next run: what was missing may have come.
    """
    flags = unpack(packs, carry, prefix).where("error IS NOT NULL").groupBy(*carry).agg(F.sort_array(F.collect_set("error")).alias("flags"))
    refs = named(packs, carry)
    waits = matching(refs.where("ref_id IS NOT NULL").select(*carry, F.col("ref_id").alias("id"), "end_seq"), parents, ["id", "end_seq"], "left_anti").groupBy(*carry).agg(F.count_distinct("id", "end_seq").alias("pending_parents"))
    lost = matching(refs.where("peer_id IS NOT NULL").select(*carry, "peer_id"), peers, ["peer_id"], "left_anti").groupBy(*carry).agg(F.count_distinct("peer_id").alias("missing_peers"))
    parts = [flags.select(*carry, "flags", F.lit(0).cast("bigint").alias("pending_parents"), F.lit(0).cast("bigint").alias("missing_peers"))]
    none = F.array().cast("array<string>").alias("flags")
    parts += [waits.select(*carry, none, "pending_parents", F.lit(0).cast("bigint").alias("missing_peers")), lost.select(*carry, none, F.lit(0).cast("bigint").alias("pending_parents"), "missing_peers")]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy(*carry).agg(F.flatten(F.collect_list("flags")).alias("flags"), F.max("pending_parents").alias("pending_parents"), F.max("missing_peers").alias("missing_peers"))


#: What a replica has read: a row for each entry, and one without an entry for each pack.
READ = T.StructType([T.StructField(c, k) for c, k in (("path", T.StringType()), ("pack_id", T.LongType()), ("seq_end", T.LongType()), ("peer_id", T.BinaryType()), ("container", T.BinaryType()), ("idx", T.LongType()), ("entry_type", T.StringType()), ("ts", T.LongType()), ("user_id", T.BinaryType()), ("body", T.BinaryType()))])


def read_round(spark: SparkSession, folder: str, target: VersionedTable, peers: DataFrame, prefix: str = HASH_PREFIX) -> tuple[Version, DataFrame]:
    """One round of reading the packs below a folder into ``target`` (READ): (version, blocked packs with the reasons).

    The target is the only state: packs it doesn't hold are read, whole or not at all, and those
    that are blocked are tried again with the next round. A parent counts if it was read before or is read
    now; what waits for a pack that is blocked itself comes in the round after that one is read.
    """
    base = target.current()
    held = target.read(base).where("entry_type IS NULL AND idx IS NULL").select("path", "pack_id", "seq_end")
    metas = _files(spark, folder, ".uqp.meta").select("path", F.col("content").alias("header"), F.regexp_extract("path", "[^/]+$", 0).alias("file_name"))
    todo = canonical(matching(metas, held.select("path"), ["path"], "left_anti")).select("path", "pack_id", "seq_end", "header")
    bodies_ = _files(spark, folder, ".uqp").select(F.concat("path", F.lit(".meta")).alias("path"), F.col("content").alias("body"))
    todo = todo.join(bodies_, "path", "left")
    here = held.select(F.col("pack_id").alias("id"), F.col("seq_end").alias("end_seq"))
    broken = unpack(todo, ["path"], prefix).where("error IS NOT NULL").select("path").distinct()
    sound = matching(todo, broken, ["path"], "left_anti").select(F.col("pack_id").alias("id"), F.col("seq_end").alias("end_seq"))
    stuck = blocked(todo, ["path"], here.unionByName(sound).distinct(), peers, prefix)
    stuck_at = work_folder(spark, "blocked")
    stuck.write.parquet(stuck_at)
    stuck = spark.read.schema(stuck.schema).parquet(stuck_at)
    good = matching(todo, stuck.select("path"), ["path"], "left_anti")
    entries_ = unpack(good, ["path", "pack_id", "seq_end"], prefix).drop("error")
    marks = good.select("path", "pack_id", "seq_end")
    return target.append(entries_.unionByName(marks, allowMissingColumns=True).select(*READ.names), base=base), stuck


def named(packs: DataFrame, carry: list[str]) -> DataFrame:
    """(carry..., ref_id, end_seq, peer_id): the parents and the peers that headers name; headers that can't be read name none."""
    ship(packs.sparkSession)
    n = len(carry)
    out = T.StructType([*[packs.schema[c] for c in carry], T.StructField("ref_id", T.LongType()), T.StructField("end_seq", T.LongType()), T.StructField("peer_id", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for b in batches:
            rows = []
            for r in zip(*[c.to_pylist() for c in b.columns]):
                try:
                    h = decode_header(r[n])
                except DecodeError:
                    continue
                rows += [(*r[:n], p["id"], p["end_seq"], None) for p in h["parents"]] + [(*r[:n], None, None, p["peer_id"]) for p in h["peer_data"]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return packs.select(*carry, "header").mapInArrow(run, out)


_providers: dict = {}


def register_provider(name: str, make) -> None:
    """A source of packs by name: ``make(spark, config)`` gives the folder that Spark reads."""
    _providers[name] = make


def remote(spark: SparkSession, provider: str, config: str) -> str:
    if provider not in _providers:
        raise LookupError(f"no provider {provider}")
    return _providers[provider](spark, config)


register_provider("folder", lambda spark, config: config)
