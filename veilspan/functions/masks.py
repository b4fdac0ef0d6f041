"""Ways to replace a value: ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASHES = ("sha256", "sha512", "md5")


def mask_chars(
    value: Column, masking_char: Column, chars_to_mask: Column, from_end: Column
) -> Column:
    """Overwrite ``chars_to_mask`` characters; a negative number means all of them."""
    length = F.length(value)
    hidden = F.when(chars_to_mask < 0, length).otherwise(F.least(chars_to_mask, length))
    stars = F.repeat(masking_char, hidden)
    return F.when(
        from_end, F.concat(F.substring(value, F.lit(1), length - hidden), stars)
    ).otherwise(F.concat(stars, F.substring(value, hidden + 1, length - hidden)))


def hash_value(value: Column, hash_type: str = "sha256", salt: Column | None = None) -> Column:
    """Lower-case hex digest, of salt and value if there is a salt."""
    salted = value if salt is None else F.concat(salt, value)
    if hash_type == "sha256":
        return F.sha2(salted, 256)
    if hash_type == "sha512":
        return F.sha2(salted, 512)
    if hash_type == "md5":
        return F.md5(salted)
    raise ValueError(f"unknown hash type {hash_type!r}; one of {HASHES}")


def encrypt_value(value: Column, key: str | bytes) -> Column:
    """AES-GCM, base64. A key of 16, 24 or 32 bytes is required."""
    raw = key.encode() if isinstance(key, str) else key
    if len(raw) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    return F.base64(F.aes_encrypt(F.encode(value, "UTF-8"), F.lit(raw)))


def decrypt_value(value: Column, key: str | bytes) -> Column:
    """The value back, or null if it was not encrypted with this key."""
    raw = key.encode() if isinstance(key, str) else key
    return F.decode(F.try_aes_decrypt(F.unbase64(value), F.lit(raw)), "UTF-8")
