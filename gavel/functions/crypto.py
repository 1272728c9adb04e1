"""Hashing, HMAC and canonical JSON as JVM-side expressions (JSN-1..3).

HMAC-SHA256 is built from two ``sha2`` calls over binary concatenations;
the key pads are derived on the driver once per job (they depend only on
the key parameter), so no row ever leaves the JVM.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256_hex(key, msg) -> Column:
    """Lower-case hex HMAC-SHA256 of ``msg`` (string Column, UTF-8)."""
    kb = key if isinstance(key, bytes) else str(key).encode("utf-8")
    ipad, opad = _pads(kb)
    m = msg if isinstance(msg, Column) else F.col(msg)
    inner = F.sha2(F.concat(F.lit(ipad), F.encode(m, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(opad), F.unhex(inner)), 256)


def b64url_nopad(hex_col) -> Column:
    """URL-safe base64 of the bytes in ``hex_col`` without '=' padding."""
    h = hex_col if isinstance(hex_col, Column) else F.col(hex_col)
    return F.regexp_replace(F.translate(F.base64(F.unhex(h)), "+/", "-_"), "=+$", "")


def canonical_json(fields: dict) -> Column:
    """JSN-1: compact JSON with keys sorted (recursively for nested dicts),
    null fields kept. ``fields`` maps key -> Column or nested dict."""
    def build(d):
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in sorted(d.items())])
    return F.to_json(build(fields), {"ignoreNullFields": "false"})
