"""Masking of personal data in single columns, typed row images and map images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default salt, field lists and replacement texts.
SALT = "cdc-enterprise-salt-secure-hash-2026"
EMAIL_FIELDS = ("email", "customer_email")
CARD_FIELDS = ("credit_card", "card_number", "tax_id")
CARD_PREFIX = "XXXX-XXXX-XXXX-"
CARD_REPLACEMENT = "XXXX-XXXX-XXXX-XXXX"
EMAIL_REPLACEMENT = "REDACTED_PII"
PSEUDONYM_DOMAIN = "@masked.com"

HASH, PSEUDONYM, STATIC = "hash", "pseudonym", "static"


def email_hash(value: Column, salt: str = SALT) -> Column:
    """First 16 hex digits of the salted SHA-256 digest."""
    return F.substr(F.sha2(F.concat(value.cast("string"), F.lit(":" + salt)), 256), F.lit(1), F.lit(16))


def email_pseudonym(value: Column) -> Column:
    """Unsalted digest in the form of an address, stable across systems."""
    return F.concat(F.substr(F.sha2(value.cast("string"), 256), F.lit(1), F.lit(16)), F.lit(PSEUDONYM_DOMAIN))


def redact_card(value: Column) -> Column:
    """Keeps the last four ASCII digits; with fewer than four nothing is kept."""
    digits = F.regexp_replace(value.cast("string"), "[^0-9]", "")
    return (
        F.when(F.length(digits) >= 4, F.concat(F.lit(CARD_PREFIX), F.right(digits, F.lit(4))))
        .when(digits.isNotNull(), F.lit(CARD_REPLACEMENT))
    )


def present(value: Column) -> Column:
    """False for the values that masking leaves alone: NULL, empty, zero and false."""
    return value.isNotNull() & ~value.cast("string").isin("", "0", "false")


def _email(value: Column, mode: str, salt: str) -> Column:
    if mode == HASH:
        return email_hash(value, salt)
    if mode == PSEUDONYM:
        return email_pseudonym(value)
    if mode == STATIC:
        return F.lit(EMAIL_REPLACEMENT)
    raise ValueError(f"unknown e-mail mask {mode!r}")


def _card(value: Column, mode: str) -> Column:
    return F.lit(CARD_REPLACEMENT) if mode == STATIC else redact_card(value)


def mask_image(
    image: Column, email_fields: Sequence[str] = EMAIL_FIELDS, card_fields: Sequence[str] = CARD_FIELDS,
    mode: str = HASH, salt: str = SALT,
) -> Column:
    """Masks the listed fields of a map image, leaving the others as they are."""
    return F.transform_values(
        image,
        lambda k, v: F.when(k.isin(*email_fields) & present(v), _email(v, mode, salt))
        .when(k.isin(*card_fields) & present(v), _card(v, mode))
        .otherwise(v),
    )


def masked_fields(
    image: Column, email_fields: Sequence[str] = EMAIL_FIELDS, card_fields: Sequence[str] = CARD_FIELDS,
) -> Column:
    """Sorted names of the fields that ``mask_image`` changes, for the audit trail."""
    fields = [*email_fields, *card_fields]
    return F.array_sort(F.map_keys(F.map_filter(image, lambda k, v: k.isin(*fields) & present(v))))


def mask_columns(
    df: DataFrame, email_fields: Sequence[str] = EMAIL_FIELDS, card_fields: Sequence[str] = CARD_FIELDS,
    mode: str = HASH, salt: str = SALT,
) -> DataFrame:
    """Typed form: masks the columns of ``df`` that carry a listed name."""
    out = {}
    for c in df.columns:
        v = F.col(c)
        if c in email_fields:
            out[c] = F.when(present(v), _email(v, mode, salt)).otherwise(v)
        elif c in card_fields:
            out[c] = F.when(present(v), _card(v, mode)).otherwise(v)
    return df.withColumns(out) if out else df
