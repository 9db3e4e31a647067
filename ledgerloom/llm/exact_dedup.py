"""Exact deduplication by an exchange of compressed fingerprints.

1. Every block of rows sorts the 48-bit fingerprints of its normalised texts and sends each
   owner (a range of fingerprints) one Golomb-Rice coded list of the distinct ones.
2. Owners decode the lists, find fingerprints that several blocks hold, and answer each list
   with a bitmap. A fingerprint that occurs twice inside a block is marked by the block itself.
3. Only rows that a bitmap marks are suspects. Their texts are shuffled and grouped as whole
   strings, which verifies the copies byte by byte. A broadcast sieve of the suspects' ids keeps the other
   texts out of that shuffle; with more than SIEVE_KEYS suspects the join by id does so after it.

A text that a third of all rows share is sent once per block, and the grouping of the suspects
combines copies before the shuffle, so no group of copies meets in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import golomb
from ledgerloom.llm.common import SIEVE_KEYS, ids_and_texts, lower_ascii, possible_matches, shuffle_partitions, texts_of, without
from ledgerloom.plans.shared import Stored

BLOCK_ROWS = 1 << 16

_SENT = pa.schema([
    ("block", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("bits", pa.int32()),
    ("payload", pa.binary()), ("twice", pa.binary()), ("slots", pa.list_(pa.int32())),
    ("row_ids", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())),
])
_MARKED = pa.schema([
    ("row_id", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("suspect", pa.bool_()),
])


def _ddl(schema: pa.Schema) -> str:
    names = {
        pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean",
        pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.string()): "array<string>",
    }
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _sender(owners: int, block_rows: int):
    lows = np.array([golomb.owner_low(o, owners) for o in range(owners)], np.int64)

    def close(block: int, first_row: int, ids: list, digests: list) -> pa.RecordBatch:
        prints = np.array([int.from_bytes(d[:6], "big") for d in digests], np.int64)
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        owner_of = np.searchsorted(lows, prints, side="right") - 1
        rows = []
        for owner in np.unique(owner_of):
            start, end = np.searchsorted(owner_of, [owner, owner + 1])
            distinct, slots, counts = np.unique(prints[start:end], return_inverse=True, return_counts=True)
            low = golomb.owner_low(int(owner), owners)
            bits = golomb.rice_bits(golomb.owner_low(int(owner) + 1, owners) - low, len(distinct))
            rows.append((
                block, int(owner), len(distinct), bits, golomb.encode(distinct, low, bits),
                np.packbits(counts > 1).tobytes(), slots.ravel().tolist(),
                (order[start:end] + first_row).tolist(),
                [ids[i] for i in order[start:end]], [digests[i].hex() for i in order[start:end]],
            ))
        return pa.record_batch(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        block, row = task << 32, task << 40
        ids: list = []
        digests: list[bytes] = []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            digests += [hashlib.sha256((t or "").encode().lower()).digest() for t in texts_of(batch)]
            while len(ids) >= block_rows:
                yield close(block, row, ids[:block_rows], digests[:block_rows])
                ids, digests, block, row = ids[block_rows:], digests[block_rows:], block + 1, row + block_rows
        if ids:
            yield close(block, row, ids, digests)

    return send


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document, with the answer of its owner or its own block."""
    for batch in batches:
        for row in batch.to_pylist():
            flags = np.unpackbits(np.frombuffer(row["bitmap"], np.uint8) | np.frombuffer(row["twice"], np.uint8))
            suspect = flags[np.array(row["slots"], np.int64)].astype(bool)
            yield pa.record_batch([
                pa.array(row["row_ids"], pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                pa.array(row["digests"], pa.string()), pa.array(suspect),
            ], schema=_MARKED)


def mark_suspects(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    owners: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """row_id, doc_id, text_sha256 and suspect per row: suspects share a fingerprint with another row.

    `owners` is the number of fingerprint ranges, by default the shuffle partitions; a block
    holds `block_rows` rows, of which only ids and digests stay in memory.
    """
    spark = docs.sparkSession
    owners = owners or shuffle_partitions(spark)
    sent = Stored(ids_and_texts(docs, id_col, text_col).mapInArrow(_sender(owners, block_rows), _ddl(_SENT)), "sent")
    answers = sent.frame.select("block", "owner", "n", "bits", "payload").groupBy("owner").applyInPandas(
        golomb.answer_lists(owners), "block bigint, owner int, bitmap binary"
    )
    held = sent.frame.select("block", "owner", "twice", "slots", "row_ids", "doc_ids", "digests")
    marked = Stored(held.join(answers, ["block", "owner"]).mapInArrow(_mark, _ddl(_MARKED)), "marked")
    sent.drop()
    return marked.frame


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    owners: int | None = None, block_rows: int = BLOCK_ROWS, sieve_keys: int = SIEVE_KEYS,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after A-Z became a-z; a null text is an empty one. The row with
    the largest doc_id of equal texts stays. Defined results: a null doc_id is smaller than any
    other (keep_id is null if all are); of rows repeated in full exactly one is kept; rows that share
    a doc_id but not a text are separate documents; an empty table gives no rows; other columns of
    `docs` are ignored, whatever their names.
    """
    marked = mark_suspects(docs, id_col, text_col, owners, block_rows)
    suspects = marked.filter("suspect")
    ids = Stored(suspects.select("doc_id").distinct(), "suspect-ids").frame
    possible = possible_matches(ids_and_texts(docs, id_col, text_col), F.col("doc_id"), ids, F.col("doc_id"), sieve_keys)
    texts = possible.alias("t").join(ids.alias("s"), F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")
    verified = (
        texts.select("doc_id", lower_ascii(F.col("text")).alias("normal"))
        .groupBy("normal").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select(F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    last = suspects.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row_id")).alias("last"))
    groups = Stored(
        verified.join(last, "text_sha256").select("text_sha256", "keep_id", "group_size", F.col("last.row_id").alias("keep_row")),
        "groups",
    ).frame
    joined = marked.join(groups, "text_sha256", "left")
    copied = F.col("group_size").isNotNull()
    return joined.select(
        "doc_id", F.when(copied, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row_id"), F.lit(True)).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sieve_keys: int = SIEVE_KEYS,
) -> DataFrame:
    """The rows that stay, with all their columns; of rows repeated in full one stays.

    Only the ids and digests of dropped rows travel to the documents. Rows of an id that occurs
    more than once go through one more grouping, as the id alone does not tell them apart. Defined results: a null
    text equals an empty one, of whose rows one stays; a null id loses against any other; an empty table
    stays empty; other columns may have any name.
    """
    found = Stored(exact_duplicates(docs, id_col, text_col, sieve_keys=sieve_keys), "exact").frame
    id_of, text_of = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    digest = F.sha2(lower_ascii(F.col(f"d.`{text_col}`")).cast("binary"), 256)
    same = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("x.doc_id"))
    many = found.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    lost = Stored(found.filter("not kept").select("doc_id").union(many).distinct(), "lost-ids").frame
    once = without(docs, id_of.cast("long"), lost, F.col("doc_id"), same, sieve_keys)
    stays = Stored(
        found.filter("kept").alias("k").join(many.alias("m"), F.col("k.doc_id").eqNullSafe(F.col("m.doc_id")), "left_semi")
        .select("doc_id", "text_sha256").distinct(),
        "repeated-ids",
    ).frame
    again = (
        possible_matches(docs, id_of.cast("long"), stays, F.col("doc_id"), sieve_keys).alias("d")
        .join(stays.alias("x"), same & (digest == F.col("x.text_sha256")), "left_semi")
    )
    kept_of_many = again.groupBy(id_of, lower_ascii(text_of)).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text_of).alias("row")
    )
    return once.unionByName(kept_of_many.select("row.*"))
