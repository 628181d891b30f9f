"""Names and keys of stored results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: characters that a stored name can't hold
UNSAFE = r"/:\.-?=&;"


def node_name(name: Column) -> Column:
    """A name for a place in the store: unsafe characters become underscores, one leading underscore goes; null stays null."""
    return F.regexp_replace(F.translate(name, UNSAFE, "_" * len(UNSAFE)), "^_", "")


def meta_key(pos: Column, t: Column | None = None) -> Column:
    """``pos_000000012_t_Collected``, or with the frame's number for a single frame."""
    if t is None:
        return F.format_string("pos_%09d_t_Collected", pos)
    return F.format_string("pos_%09d_t_%09d", pos, t)


def content_hash(content: Column) -> Column:
    """base64 of the SHA-256 of the bytes; null for null."""
    return F.base64(F.unhex(F.sha2(content.cast("binary"), 256)))
