"""Shards by jump consistent hashing.

A key's shard follows from the key and the number of shards alone, without a table of ring points.
The key seeds the published 64-bit linear generator; each draw says at which number of shards
the key would jump next, and the last jump below the number of shards is its shard. One more
shard moves only the keys whose next jump leads there.

All steps are built-in expressions. The generator's product is put together from 16-bit and
32-bit parts, since ANSI mode refuses a product that overflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ids_and_texts
from ledgerloom.plans.numbering import running_within
from ledgerloom.plans.shared import Stored

SHARDS = 16

# Fixed value: the multiplier of the generator.
MULTIPLIER = 2862933555777941757

#: Jumps taken before asking whether a key needs more; 16 shards take 16 at most, a million 15 on average.
_STEPS = 64
_HALF = 0xFFFFFFFF
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & _HALF
_STATE = "struct<bucket:bigint,next:bigint,high:bigint,low:bigint>"


def _times(a: Column, b: int) -> Column:
    """a * b modulo 2**32, up to multiples of 2**32, for a and b below 2**32."""
    upper = (F.shiftright(a, 16) * F.lit(b & 0xFFFF)).bitwiseAND(0xFFFF)
    return a.bitwiseAND(0xFFFF) * F.lit(b) + F.shiftleft(upper, 16)


def _jump(state: Column) -> Column:
    """The generator's next number, and where the key jumps after the shard it has reached."""
    low, high = state["low"], state["high"]
    left, right = low.bitwiseAND(0xFFFF) * F.lit(_LOW), F.shiftright(low, 16) * F.lit(_LOW)
    total = left + F.shiftleft(right.bitwiseAND(0xFFFF), 16) + F.lit(1)
    carry = F.shiftright(total, 32) + F.shiftright(right, 16)
    upper = (carry + _times(high, _LOW) + _times(low, _HIGH)).bitwiseAND(_HALF)
    share = F.lit(2.0**31) / (F.shiftright(upper, 1) + F.lit(1)).cast("double")
    after = F.floor((state["next"] + F.lit(1)).cast("double") * share)
    return F.struct(
        state["next"].alias("bucket"), after.alias("next"), upper.alias("high"), total.bitwiseAND(_HALF).alias("low")
    ).cast(_STATE)


def _jumps(state: Column, shards: int, steps: int) -> Column:
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), state.cast(_STATE),
        lambda s, _: F.when(s["next"] < shards, _jump(s)).otherwise(s))


def with_shard(df: DataFrame, key: str, shards: int = SHARDS, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Add the shard of a bigint key, and its shard when there is one more shard.

    A null key has the shards of key 0.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    value = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("next"),
        F.shiftrightunsigned(value, 32).alias("high"), value.bitwiseAND(_HALF).alias("low"))
    out = df.withColumn("_jumped", _jumps(start, shards, min(shards, _STEPS)))
    if shards > _STEPS:  # each jump leads further, so there are at most as many as shards
        more = F.when(F.col("_jumped.next") < shards, _jumps(F.col("_jumped"), shards, shards))
        out = out.withColumn("_jumped", more.otherwise(F.col("_jumped")))
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in (shard, grown)], F.col("_jumped.bucket").cast("int").alias(shard),
        F.when(F.col("_jumped.next") == shards, F.lit(shards)).otherwise(F.col("_jumped.bucket")).cast("int").alias(grown))


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the text's bytes and one more. `slot` numbers the rows of a shard from 0 in the order
    of doc_id (nulls first), text_crc32 and size. Defined results: a null text has size 1 and the
    checksum of an empty one; null ids share the shard of id 0; equal ids share a shard, as the id
    alone decides, and rows repeated in full get a slot each; an empty table gives no rows; other
    columns are ignored, whatever their names. Very long texts are only measured. An id that a
    third of all rows have fills one shard, but no task: slots are counted over range partitions.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = ids_and_texts(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        # Tells apart rows that agree in all else.
        F.monotonically_increasing_id().alias("row"))
    measured = Stored(with_shard(slim, "doc_id", shards), "measured")
    placed, _ = running_within(measured.frame, ["shard"], ["doc_id", "text_crc32", "size", "row"], name="slot")
    measured.drop()
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id") -> None:
    """All columns of the documents as Parquet, one folder shard=<n> per shard, without a shuffle.

    A column of the name `shard` would clash with the folders and is refused.
    """
    if "shard" in docs.columns:
        raise ValueError("the documents have a column named shard already")
    with_shard(docs, id_col, shards, grown="_grown").drop("_grown").write.partitionBy("shard").parquet(path)


def moved_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """The documents that one more shard would take over; all others stay where they are."""
    moved = with_shard(docs, id_col, shards, "_old", "_new")
    return moved.where(F.col("_old") != F.col("_new")).drop("_old", "_new")
