"""Column builders for record keys and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The binary clock key is 9 bytes, hence 18 hex characters.
CLOCK_KEY_BYTES = 9
CLOCK_KEY_CHARS = 18


def key_origin(key: Column) -> Column:
    """Even keys were born in the legacy system, odd ones in the cloud."""
    return F.when(F.pmod(key, F.lit(2)) == 0, "LEGACY").when(key.isNotNull(), "CLOUD")


def clock_key_to_text(raw: Column) -> Column:
    return F.when(F.octet_length(raw) == CLOCK_KEY_BYTES, F.hex(raw))


def text_to_clock_key(text: Column) -> Column:
    return F.when(F.length(text) == CLOCK_KEY_CHARS,
                  F.try_to_binary(text, F.lit("hex")))


def as_uuid(digest: Column) -> Column:
    """Shape the first 32 hex digits of a digest as a version-8 UUID."""
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4),
        F.lit("-8"), F.substring(digest, 14, 3),
        F.lit("-a"), F.substring(digest, 18, 3),
        F.lit("-"), F.substring(digest, 21, 12))


def stable_uuid(value: Column, salt: str = "") -> Column:
    """Same value and salt give the same UUID, so that a replay is harmless.

    Business numbers can be enumerated: pass a secret salt for tokens.
    """
    return as_uuid(F.sha2(F.concat(F.lit(salt), value), 256))
