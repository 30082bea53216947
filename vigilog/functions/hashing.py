"""Stable identifiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(alert_type, key, title) -> Column:
    """16 hex digits of the SHA-256 of type, source and title."""
    return F.substring(F.sha2(F.concat_ws(":", alert_type, key, title), 256), 1, 16)


def uuid_layout(digest: Column) -> Column:
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4),
        F.substring(digest, 17, 4), F.substring(digest, 21, 12),
    )


def stix_id(kind: str, local: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(kind + ":"), local), 256)
    return F.concat(F.lit(kind + "--"), uuid_layout(digest))


def alert_id(print_: Column, event_id: Column) -> Column:
    """Same alert, same id: a rerun of a lost task does not invent new ones."""
    return uuid_layout(F.sha2(F.concat_ws("|", print_, event_id), 256))


def stable_hash(text: Column) -> Column:
    """31-multiplier character hash in 24 bits, scaled to [0, 1]."""
    codes = F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1)))
    )
    total = F.aggregate(
        codes, F.lit(0).cast("bigint"),
        lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFF).cast("bigint")),
    )
    return F.when(F.length(text) > 0, total / F.lit(float(0xFFFFFF))).otherwise(0.0)
