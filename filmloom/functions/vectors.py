"""Vector expressions, text hashes and document fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from filmloom.functions.binding import let
from filmloom.functions.normalize import nfc
from filmloom.functions.text import document_input
from filmloom.operators.rules import is_finite

FINGERPRINT_VERSION = "multilingual-document-fingerprint-v1"


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    scale = (norm_a if norm_a is not None else l2_norm(a)) * (norm_b if norm_b is not None else l2_norm(b))
    return F.lit(1.0) - F.try_divide(dot(a, b), scale)


def is_valid_vector(v: Column, dimension: int, unit_tolerance: float | None = None) -> Column:
    """Right size, finite, not zero, and near unit length when a tolerance is given."""
    def check(x: Column) -> Column:
        entries = x.isNotNull() & (F.size(x) == dimension) & F.forall(x, lambda e: e.isNotNull() & is_finite(e))
        near = lambda n: F.abs(n - 1) <= unit_tolerance if unit_tolerance is not None else F.lit(True)
        return entries & let(l2_norm(x), lambda n: is_finite(n) & (n > 0) & near(n))
    return F.coalesce(let(v, check), F.lit(False))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def document_fingerprint(text: Column, language: Column, text_format: Column, profile: Column) -> Column:
    """Hash of the compact JSON of everything a stored vector depends on."""
    payload = F.to_json(F.struct(
        F.lit(FINGERPRINT_VERSION).alias("fingerprintVersion"), language.alias("language"),
        text_format.alias("textFormatVersion"), profile.alias("profileFingerprint"),
        document_input(nfc(text)).alias("formattedInput")), {"ignoreNullFields": "false"})
    return F.sha2(payload, 256)


def pseudo_vector(fingerprint: Column, dimension: int) -> Column:
    """Deterministic stand-in vector: byte i mod 32 of the fingerprint's hash, scaled to [-1, 1]."""
    def values(seed: Column) -> Column:
        byte = lambda i: F.conv(F.substr(seed, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
        return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: byte(i) / 127.5 - 1.0)
    return let(F.sha2(fingerprint, 256), values)


def unit(v: Column) -> Column:
    return let(v, lambda x: let(l2_norm(x), lambda n: F.transform(
        x, lambda e: F.try_divide(e.cast("double"), n).cast("float"))))


def max_abs_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def matches_canary(expected: Column, actual: Column, tolerance: float = 1e-6) -> Column:
    return F.coalesce((F.size(expected) == F.size(actual))
                      & (max_abs_difference(expected, actual) <= tolerance), F.lit(False))
