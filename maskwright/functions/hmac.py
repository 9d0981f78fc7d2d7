"""Keyed fingerprints with built-in functions."""

from __future__ import annotations

import hashlib

_SIZE = 64  # block length of SHA-256


def hmac_sha256(message: str, key: bytes) -> str:
    """HMAC-SHA-256 of a string expression, as lower-case hex."""
    if len(key) > _SIZE:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(_SIZE, b"\0")
    inner = bytes(b ^ 0x36 for b in padded).hex()
    outer = bytes(b ^ 0x5C for b in padded).hex()
    digest = f"sha2(concat(unhex('{inner}'), encode({message}, 'utf-8')), 256)"
    return f"sha2(concat(unhex('{outer}'), unhex({digest})), 256)"
