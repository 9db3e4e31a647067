"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator works on, so that no other column can clash."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )


def lower_ascii(text: Column) -> Column:
    """A-Z become a-z, every other character stays; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """The rows no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are stored.

    It does so when the driver collects the plans that are no longer used, which can take long
    on a driver with little to do.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Keys that a broadcast sieve may stand for: at most a quarter as many entries of about 40 bytes.
SIEVE_KEYS = 4_000_000
_KEYS_PER_WORD = 4
_MAYBE = "_sieve_maybe"


def _sieved(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, sieve_keys: int) -> DataFrame | None:
    """The rows with the column _MAYBE, which is false only where `wanted`, a stored table, lacks the key.

    A Bloom filter of two bits per key in one 64-bit word, broadcast: texts that cannot match then stay out of the
    shuffle of the exact join that follows. None above `sieve_keys` keys, where it would be too large to broadcast.
    """
    count = wanted.count()
    if count > sieve_keys:
        return None
    words = max(1, count // _KEYS_PER_WORD)
    word = F.expr(f"pmod(shiftrightunsigned(_sieve_hash, 12), {words}L)")
    bits = F.expr(
        "shiftleft(1L, cast(_sieve_hash & 63 as int)) | shiftleft(1L, cast(shiftrightunsigned(_sieve_hash, 6) & 63 as int))"
    )
    sieve = (
        wanted.select(F.xxhash64(wanted_key).alias("_sieve_hash"))
        .groupBy(word.alias("_sieve_word")).agg(F.bit_or(bits).alias("_sieve_bits"))
    )
    hashed = rows.withColumn("_sieve_hash", F.xxhash64(key)).withColumn("_sieve_word", word)
    found = F.coalesce(F.col("_sieve_bits").bitwiseAND(bits) == bits, F.lit(False))
    return (
        hashed.join(F.broadcast(sieve), "_sieve_word", "left").withColumn(_MAYBE, found)
        .drop("_sieve_hash", "_sieve_word", "_sieve_bits")
    )


def possible_matches(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, sieve_keys: int = SIEVE_KEYS) -> DataFrame:
    """Rows whose key `wanted`, a stored table, may have: all that it has, and few others. The exact join is the caller's.

    Null is a key like any other. With more than `sieve_keys` keys all rows come back.
    """
    sieved = _sieved(rows, key, wanted, wanted_key, sieve_keys)
    return rows if sieved is None else sieved.filter(_MAYBE).drop(_MAYBE)


def without(
    rows: DataFrame, key: Column, lost: DataFrame, lost_key: Column, same: Column, sieve_keys: int = SIEVE_KEYS
) -> DataFrame:
    """The rows, called `d`, for which `same` holds with no row of `lost` (a stored table, called `x`).

    `same` implies equal keys. Only rows that a sieve of the keys cannot rule out are shuffled; the others are read
    in a pass of their own. Null is a key like any other; repeated rows of either side change nothing else.
    """
    sieved = _sieved(rows, key, lost, lost_key, sieve_keys)
    if sieved is None:
        return rows.alias("d").join(lost.alias("x"), same, "left_anti")
    suspects = sieved.filter(_MAYBE).drop(_MAYBE).alias("d").join(lost.alias("x"), same, "left_anti")
    return sieved.filter(~F.col(_MAYBE)).drop(_MAYBE).unionByName(suspects)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str | None]:
    """The texts of a batch one by one; the batch as a whole never becomes Python objects."""
    values = batch.column(batch.schema.get_field_index(column))
    for i in range(len(values)):
        yield values[i].as_py()


def arrow_rows(rows: Iterable[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most `size` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
