"""Coercion of JSON, times and limits, and column encryption."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_array(text: Column) -> Column:
    """A JSON array of strings; empty for null, JSON null and text that is no array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_object(text: Column) -> Column:
    """A JSON object as it is; ``{}`` for null, JSON null and text that is no object."""
    return F.when(F.coalesce(F.try_parse_json(text).cast("string"), F.lit("")).startswith("{"), text).otherwise("{}")


def epoch_ms(value: Column, default: Column) -> Column:
    """Milliseconds from seconds, milliseconds, ISO time (UTC without zone) or such a number as text."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    ms = F.when(number < 100_000_000_000, number * 1000).otherwise(number).cast("long")
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), F.unix_millis(text.try_cast("timestamp")))
    return F.coalesce(iso, ms, default)


def clamped_int(value: int | None, default: int, low: int = 1, high: int | None = None) -> int:
    """A whole number in bounds; the default for what is none."""
    try:
        n = int(default if value is None else value)
    except (TypeError, ValueError):
        n = default
    n = max(low, n)
    return n if high is None else min(high, n)


def clamped(value: float | None, default: float, low: float = 0.0, high: float = 1.0) -> float:
    try:
        x = float(default if value is None else value)
    except (TypeError, ValueError):
        x = default
    return max(low, min(high, x))


def encrypted(text: Column, key: Column, aad: Column) -> Column:
    """AES-256-GCM as base64 of IV, ciphertext and tag; empty text and text that the key already opens stay."""
    sealed = F.regexp_replace(F.base64(F.aes_encrypt(text.cast("binary"), F.unbase64(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), aad)), "[\r\n]", "")
    return F.when(F.coalesce(text, F.lit("")) == "", text).when(_opened(text, key, aad).isNotNull(), text).otherwise(sealed)


def _opened(text: Column, key: Column, aad: Column) -> Column:
    """The plain text, or null if the text was not sealed with this key and data."""
    looks = text.rlike("^[A-Za-z0-9+/]{38,}={0,2}$") & (F.length(text) % 4 == 0)
    return F.when(looks, F.try_aes_decrypt(F.unbase64(F.when(looks, text)), F.unbase64(key), F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string"))


def decrypted(text: Column, key: Column, aad: Column) -> Column:
    """The plain text; what cannot be opened stays."""
    return F.coalesce(_opened(text, key, aad), text)
