"""Conversation turns in a table of their own: only the four columns the operators work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turn as bigint, role and text as strings, so that no other column can clash."""
    return conversations.select(
        *[F.col(f"`{c}`").cast("long").alias(c) for c in ("conv_id", "turn")],
        *[F.col(f"`{c}`").cast("string").alias(c) for c in ("role", "text")])


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes that are the same for the same role and text."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
