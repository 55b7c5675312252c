"""Column encryption with AES-256-GCM: 12-byte nonce, ciphertext, 16-byte tag."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def encrypt(value: Column, key: Column) -> Column:
    return F.aes_encrypt(value, key, F.lit("GCM"))


def decrypt(blob: Column, key: Column) -> Column:
    """Plain bytes, NULL when the blob was changed or the key is wrong."""
    return F.try_aes_decrypt(blob, key, F.lit("GCM"))


def encrypt_text(value: Column, key: Column) -> Column:
    """URL-safe base64 of the encrypted text."""
    return F.translate(F.base64(encrypt(value.cast("binary"), key)), "+/", "-_")


def decrypt_text(text: Column, key: Column) -> Column:
    return decrypt(F.unbase64(F.translate(text, "-_", "+/")), key).cast("string")


def encrypt_json(value: Column, key: Column) -> Column:
    return encrypt_text(F.to_json(value), key)


def decrypt_json(text: Column, key: Column, schema) -> Column:
    return F.from_json(decrypt_text(text, key), schema)


def sha256_hex(value: Column) -> Column:
    return F.sha2(value, 256)
