"""Ids of documents and chunks: names turned into version 5 UUIDs, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of all ids.
NAMESPACE = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def text_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def document_id(source_id: Column, path: Column) -> Column:
    """Stays the same whatever the content."""
    return uuid5(F.concat(source_id, F.lit("|"), path))


def point_id(document: Column, sha256: Column, chunk_index: Column) -> Column:
    """Stays the same over generations of one content."""
    return uuid5(F.concat(document, F.lit("|"), sha256, F.lit("|"), chunk_index.cast("string")))


def next_generation(newest: Column) -> Column:
    return F.coalesce(newest, F.lit(0)) + 1
