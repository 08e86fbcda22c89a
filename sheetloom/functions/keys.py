"""Keys, fingerprints and the shapes they should have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import remove_invisible

# Shapes of the keys of the two kinds of vendor.
LONG_KEY, NEW_KEY, OTHER_PREFIX = "^AIza[A-Za-z0-9_-]{35}$", r"^AQ\.[A-Za-z0-9._-]{20,}$", "gsk_"
LONG_PREFIX, LONG_LENGTH = "AIza", 39


def diagnose_key(vendor: Column, raw: Column) -> Column:
    """struct(level, code, length) of what is wrong with a key, null if it is empty or the vendor ('a' or 'b') unknown.

    In order: invisible characters were removed; for 'a' a known shape, a known beginning of the wrong length, an
    unknown shape (a warning: shapes change); for 'b' its prefix.
    """
    clean = remove_invisible(raw)
    said = lambda level, code: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.length(clean).alias("length"))
    a = F.when(clean.rlike(LONG_KEY) | clean.rlike(NEW_KEY), said("ok", "well-formed")).when(clean.startswith(LONG_PREFIX) & (F.length(clean) < LONG_LENGTH), said("error", "truncated")).when(clean.startswith(LONG_PREFIX), said("error", "too-long")).otherwise(said("warn", "unknown-format"))
    b = F.when(clean.startswith(OTHER_PREFIX), said("ok", "well-formed")).otherwise(said("error", "wrong-prefix"))
    return F.when(raw.isNull() | (raw == ""), None).when(F.length(raw) > F.length(clean), said("warn", "cleaned")).when(vendor == "a", a).when(vendor == "b", b)


def fingerprint(c: Column) -> Column:
    """Eight hexadecimal digits that tell keys apart without showing them."""
    return F.substring(F.sha2(c, 256), 1, 8)


def same_secret(a: Column, b: Column) -> Column:
    """Equality by digests; null equals nothing."""
    return F.sha2(a, 256) == F.sha2(b, 256)
