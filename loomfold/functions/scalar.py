"""Clock, hash, check and retry functions, all as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A stamp is milliseconds above 16 bits of counter; clocks may run ahead so far.
COUNTER_BITS, MAX_SKEW_MS = 16, 60_000
#: What marks this engine's hashes; a parameter wherever it is used.
HASH_PREFIX = "loom1/"


def stamp(millis: Column, counter: Column | int = 0) -> Column:
    return F.shiftleft(millis.cast("bigint"), COUNTER_BITS) + counter


def stamp_millis(ts: Column) -> Column:
    return F.shiftrightunsigned(ts, COUNTER_BITS)


def stamp_counter(ts: Column) -> Column:
    return ts.bitwiseAND(0xFFFF)


def stamp_time(ts: Column) -> Column:
    return F.timestamp_millis(stamp_millis(ts))


def too_far_ahead(ts: Column, local_millis: Column, limit: int = MAX_SKEW_MS) -> Column:
    """Whether a stamp is more than the limit ahead of the local clock; exactly the limit is fine."""
    return (stamp_millis(ts) - local_millis) > limit


def tagged_sha256(domain: str, *parts: Column, prefix: str = HASH_PREFIX) -> Column:
    """SHA-256, in binary, of the domain's tag padded to 16 bytes and the parts."""
    tag = (prefix + domain).encode()
    if len(tag) > 16:
        raise ValueError("a tag has at most 16 bytes")
    return F.unhex(F.sha2(F.concat(F.lit(tag.ljust(16, b"\0")), *parts), 256))


def peer_hex(peer_id: Column) -> Column:
    return F.lower(F.hex(peer_id))


def parse_peer_hex(text: Column) -> Column:
    """A peer id from 64 lower-case hex digits; null for any other text."""
    return F.when(text.rlike("^[0-9a-f]{64}$"), F.unhex(text))


def peer_of(app_id: Column, commitment: Column, prefix: str = HASH_PREFIX) -> Column:
    """The peer id that an init record's commitment stands for, which nobody can choose; records whose id is another are forged or damaged."""
    return tagged_sha256("PeerInit", app_id, commitment, prefix=prefix)


def is_uuid(value: Column) -> Column:
    return F.octet_length(value) == 16


def is_text(value: Column) -> Column:
    """Valid UTF-8 without a NUL."""
    return F.is_valid_utf8(value) & (F.instr(value, "\0") == 0)


def zigzag(value: Column) -> Column:
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    return F.shiftrightunsigned(value, 1).bitwiseXOR(-value.bitwiseAND(1))


def backoff(retries: Column, least_ms: int, most_ms: int) -> Column:
    """The least delay doubled at each retry, up to the most."""
    return F.least(F.lit(float(least_ms)) * F.pow(F.lit(2.0), F.least(retries, F.lit(31))), F.lit(float(most_ms))).cast("bigint")


def retry_now(reason: Column, now_ms: Column, last_ms: Column, retries: Column, remote_ts: Column, startup: bool, least_ms: int = 1_000, most_ms: int = 300_000, key_came: Column | None = None, deps_done: Column | None = None) -> Column:
    """Whether a branch that lags its head should be tried again, by the reason it stalled for.

    Reasons are internal, skew, incompatible, need_key, awaiting_deps, frozen; null is none. A
    branch that needs a key or waits for other logs is tried where the caller says that they came.
    A frozen one, or one stalled for a reason that isn't known, never is.
    """
    no = F.lit(False)
    return (
        F.when(reason.isNull(), True)
        .when(reason == "internal", F.lit(startup) | (now_ms >= last_ms + backoff(retries, least_ms, most_ms)))
        .when(reason == "skew", ~too_far_ahead(remote_ts, now_ms))
        .when(reason == "incompatible", F.lit(startup))
        .when(reason == "need_key", no if key_came is None else F.coalesce(key_came, no))
        .when(reason == "awaiting_deps", no if deps_done is None else F.coalesce(deps_done, no))
        .otherwise(no)
    )
