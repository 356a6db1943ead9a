"""Signatures and ids as native expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog import fixed_values as V
from emberlog.functions.clock import seconds


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 from two literals made once from the key; no secret is sent to Python workers."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.unhex(F.sha2(F.concat(outer, first), 256))


def signature(secret: bytes, event_id: Column, signed_at: Column, body: Column) -> Column:
    signed = F.concat_ws(".", event_id, signed_at.cast("string"), body)
    return F.concat(F.lit("v1,"), F.base64(hmac_sha256(secret, signed)))


def signature_valid(
    secret: bytes, event_id: Column, signed_at: Column, given: Column, body: Column
) -> Column:
    """False for a wrong signature and for any missing header."""
    return F.coalesce(
        event_id.isNotNull()
        & signed_at.isNotNull()
        & body.isNotNull()
        & (signature(secret, event_id, signed_at, body) == given),
        F.lit(False),
    )


def fresh(signed_at: Column, received_us: Column) -> Column:
    """Signed within 300 s of arrival; arrival, not the wall clock, so a replay agrees."""
    return F.coalesce(
        F.abs(seconds(received_us) - signed_at) <= V.FRESHNESS_S, F.lit(False)
    )


def incident_id(source: Column, created_us: Column, sequence: Column) -> Column:
    """32 hex digits that a retried task computes again."""
    return F.md5(
        F.concat_ws("|", source, created_us.cast("string"), sequence.cast("string")).cast("binary")
    )
