"""Reproducible splits: a row's side depends on its key only, not on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as fv
from ledgerloom.functions.scalars import hash_fraction_bucket, hash_number
from ledgerloom.plans.numbering import number_rows
from ledgerloom.plans.shared import Stored


def holdout_flag(key: str, fraction: float = 0.2, seed: int = fv.SPLIT_SEED) -> Column:
    """Whether the key's 32-bit hash lies in the given share of all hashes; false for a null key."""
    inside = hash_number(F.col(f"`{key}`"), seed, digits=8) < F.lit(fraction * 2.0**32)
    return F.coalesce(inside, F.lit(False))


def split_holdout(
    df: DataFrame, key: str, fraction: float = 0.2, seed: int = fv.SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key; rows without a key are training rows."""
    test = holdout_flag(key, fraction, seed)
    return df.where(~test), df.where(test)


def three_way(key: str, seed: int = fv.SPLIT_SEED) -> Column:
    """'train' (60 %), 'val' (20 %) or 'test' (20 %)."""
    bucket = hash_fraction_bucket(F.col(f"`{key}`"), 100, seed)
    return F.when(bucket < 20, "test").when(bucket < 40, "val").otherwise("train")


def split_train_val_test(
    df: DataFrame, key: str, seed: int = fv.SPLIT_SEED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    side = three_way(key, seed)
    return df.where(side == "train"), df.where(side == "val"), df.where(side == "test")


#: Bits of a key's hash, and how many of them a round of the search settles.
_HASH_BITS, _ROUND_BITS = 40, 20


def class_cuts(hashed: DataFrame, label: str, fraction: float) -> DataFrame:
    """(label, cut): per class the hash at the rank of its share, found without ordering a class.

    Each round counts the rows of a class by the next bits of the hash, below the bits already known, and
    keeps those where the rank lies. Classes are data: there may be any number of them, and
    each brings at most 2**20 counts to a window.
    """
    rows = Stored(hashed.select(F.col(label).alias("class"), F.col("_hash")).dropna(), "strata")
    wanted = rows.frame.groupBy("class").agg(F.floor(F.lit(fraction) * F.count("*") + 0.5).alias("rank")).where("rank > 0")
    state = Stored(wanted.withColumn("prefix", F.lit(0).cast("long")), "ranks")
    known = 0
    while known < _HASH_BITS:
        known += _ROUND_BITS
        inside = rows.frame.join(state.frame, "class").where(
            F.shiftright("_hash", _HASH_BITS - known + _ROUND_BITS) == F.col("prefix"))
        counts = inside.groupBy("class", F.shiftright("_hash", _HASH_BITS - known).alias("bits")).agg(
            F.count("*").alias("n"), F.first("rank").alias("rank"))
        upto = Window.partitionBy("class").orderBy("bits").rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumn("through", F.sum("n").over(upto))
        found = placed.where("through >= rank and through - n < rank").select(
            "class", (F.col("rank") - F.col("through") + F.col("n")).alias("rank"), F.col("bits").alias("prefix"))
        newer = Stored(found, "ranks")
        state.drop()
        state = newer
    rows.drop()
    return state.frame.select(F.col("class").alias(label), F.col("prefix").alias("cut"))


def stratified_flag(
    df: DataFrame, key: str, label: str, fraction: float = 0.2, seed: int = fv.SPLIT_SEED
) -> DataFrame:
    """Add ``is_test``: in each class the share with the lowest key hashes.

    A class may hold any part of the rows, and there may be any number of classes. Rows
    without a label or key are not test rows.
    """
    hashed = df.withColumn("_hash", hash_number(F.col(f"`{key}`"), seed, digits=_HASH_BITS // 4))
    cuts = class_cuts(hashed, label, fraction).select(F.col(label).alias("_class"), F.col("cut").alias("_cut"))
    joined = hashed.join(cuts, F.col(label) == F.col("_class"), "left")
    is_test = F.coalesce(F.col("_hash") <= F.col("_cut"), F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], is_test.alias("is_test"))


def split_stratified(
    df: DataFrame, key: str, label: str, fraction: float = 0.2, seed: int = fv.SPLIT_SEED
) -> tuple[DataFrame, DataFrame]:
    flagged = stratified_flag(df, key, label, fraction, seed)
    return flagged.where("not is_test").drop("is_test"), flagged.where("is_test").drop("is_test")


def assign_batches(df: DataFrame, key: str, n: int = fv.BATCH_ROWS, name: str = "batch_id") -> DataFrame:
    """Consecutive blocks of ``n`` rows in key order (the key must be unique)."""
    numbered = number_rows(df, [key], "_row")
    return numbered.withColumn(name, F.floor((F.col("_row") - 1) / F.lit(n))).drop("_row")
