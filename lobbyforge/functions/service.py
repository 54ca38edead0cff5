"""What a service around the engine needs, as columns: input checks, settings, texts, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIGRATIONS = ("0001_base", "0002_derived", "0003_labels")


def pending(known: Column, applied: Column) -> Column:
    """Of the known migrations (structs), in order, those that a ledger does not have."""
    return F.filter(known, lambda m: ~F.array_contains(applied, m["migration"]))


def http_status(region_known: Column, name: Column, found: Column, limited: Column, upstream_ok: Column) -> Column:
    """Status of a request: bad input, limited, upstream failure, not found, fine."""
    return F.when(~region_known | (F.trim(name) == ""), 400).when(limited, 429).when(~upstream_ok, 502).when(~found, 404).otherwise(200)


def setting_status(value: Column, needed: Column) -> Column:
    bad = value.isNull() | value.isin("changeme", "")
    return F.when(~bad, "ok").when(needed, "fatal").otherwise("warn")


def padded(secret: str, pad: int) -> bytes:
    """The key block of HMAC-SHA256 for a secret of up to 64 bytes."""
    return bytes(b ^ pad for b in secret.encode().ljust(64, b"\0"))


def signature(body: Column, secret: str) -> Column:
    """HMAC-SHA256 in hex, from the digests that Spark has."""
    outer, inner = (F.lit(bytearray(padded(secret, pad))) for pad in (0x5C, 0x36))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)


def token(subject: Column, expires: Column, secret: str) -> Column:
    body = F.translate(F.base64(F.concat(subject, F.lit(":"), expires.cast("string")).cast("binary")), "+/", "-_")
    return F.concat(body, F.lit("."), signature(body, secret))


def token_subject(shown: Column, now: int, secret: str) -> Column:
    """Subject of a token that is whole, signed with the secret and not expired; else null."""
    body = F.split_part(shown, F.lit("."), F.lit(1))
    text = F.unbase64(F.translate(body, "-_", "+/")).cast("string")
    live = F.element_at(F.split(text, ":"), -1).cast("long") > now
    return F.when((signature(body, secret) == F.split_part(shown, F.lit("."), F.lit(2))) & live, F.regexp_extract(text, "^(.*):", 1))
