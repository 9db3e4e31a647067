"""Removal of repeated lines or paragraphs.

Units are normalised (A-Z to a-z, runs of ASCII white space to one space, none at the ends) and
hashed to 128 bits. All units of the corpus are grouped by hash; of each group the earliest unit,
by document id and then position, stays, and the others are removed. Units of fewer than
`min_words` words are left alone; with 1, as the registered query has it, only empty ones are, in
every script. Offsets count code points of the original text.

Grouping combines equal hashes before the shuffle, and the join that brings the earliest unit back
is one that adaptive execution splits, so a line in a third of all documents is no single task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_rows, ids_and_texts, texts_of
from ledgerloom.plans.shared import Stored

MIN_WORDS = 1
SEPARATORS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+")}

_ROW = pa.schema([
    ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_chars", pa.int64()), ("n_units", pa.int64()),
    ("units", pa.list_(pa.struct([
        ("unit", pa.int32()), ("begin", pa.int64()), ("stop", pa.int64()), ("high64", pa.int64()), ("low64", pa.int64()),
    ]))),
])
_ROW_DDL = (
    "doc_id bigint, text_hash bigint, n_chars bigint, n_units bigint,"
    " units array<struct<unit:int,begin:bigint,stop:bigint,high64:bigint,low64:bigint>>"
)


def unit_spans(text: str, unit: str = "line") -> Iterator[tuple[int, int]]:
    """(begin, stop) of the units of a text, without their separators."""
    begin = 0
    for found in SEPARATORS[unit].finditer(text):
        yield begin, found.start()
        begin = found.end()
    yield begin, len(text)


def _text_hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _hash_units(unit: str, min_words: int):
    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            text, units, count = text or "", [], 0
            for number, (begin, stop) in enumerate(unit_spans(text, unit)):
                count += 1
                words = text[begin:stop].encode().lower().split()
                if len(words) >= min_words:
                    high, low = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8").tolist()
                    units.append({"unit": number, "begin": begin, "stop": stop, "high64": high, "low64": low})
            yield doc_id, _text_hash(text.encode()), len(text), count, units

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from arrow_rows(rows(batch), _ROW, 256)

    return compute


def repeated_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS
) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_units, n_removed, removed_chars, spans (removed units
    as begin and stop, ascending).

    Defined results: null and empty texts have one unit that nothing removes; null ids rank before
    all others; of rows that share an id, the one with the smaller text_hash ranks first, and rows
    repeated in full count as one document, so all of them keep the same units; a unit repeated
    inside its document is removed too; an empty table gives no rows; other columns are ignored.
    """
    hashed = Stored(ids_and_texts(docs, id_col, text_col).mapInArrow(_hash_units(unit, min_words), _ROW_DDL), "units").frame
    units = hashed.select("doc_id", "text_hash", F.inline("units"))
    first = units.groupBy("high64", "low64").agg(
        F.min(F.struct("doc_id", "text_hash", "unit")).alias("first"), F.count("*").alias("times")
    ).filter("times > 1").select("high64", "low64", "first")
    found = units.join(first, ["high64", "low64"])
    here = F.struct("doc_id", "text_hash", "unit")
    later = found.filter(here > F.col("first")).dropDuplicates(["doc_id", "text_hash", "unit"])
    removed = Stored(
        later.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("begin", "stop"))).alias("spans")), "removed-units"
    ).frame
    joined = hashed.alias("h").join(
        removed.alias("r"), F.col("h.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("h.text_hash") == F.col("r.text_hash")), "left"
    )
    spans = F.coalesce(F.col("r.spans"), F.array().cast("array<struct<begin:bigint,stop:bigint>>"))
    return joined.select("h.doc_id", "h.text_hash", "h.n_units", spans.alias("spans")).select(
        "doc_id", "text_hash", "n_units", F.size("spans").cast("bigint").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["stop"] - s["begin"]).alias("removed_chars"), "spans",
    )


def drop_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without the removed units, and kept: the begin and stop, in the original, of each part that is left.

    A removed unit takes the separator that follows it along.
    """
    found = repeated_units(docs, id_col, text_col, unit, min_words).dropDuplicates(["doc_id", "text_hash"])
    joined = ids_and_texts(docs, id_col, text_col).alias("t").join(found.alias("f"), F.col("t.doc_id").eqNullSafe(F.col("f.doc_id")))
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text", pa.string()), ("kept", pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())])))
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def rows(batch: pa.RecordBatch = batch) -> Iterator[tuple]:
                for i, text in enumerate(texts_of(batch)):
                    if _text_hash((text or "").encode()) == batch.column("text_hash")[i].as_py():
                        lost = {(s["begin"], s["stop"]) for s in batch.column("spans")[i].as_py()}
                        yield batch.column(0)[i].as_py(), *_without(text or "", lost, unit)

            yield from arrow_rows(rows(), schema, 256)

    return joined.select("t.doc_id", "t.text", "f.text_hash", "f.spans").mapInArrow(
        cut, "doc_id bigint, text string, kept array<struct<begin:bigint,stop:bigint>>"
    )


def _without(text: str, lost: set[tuple[int, int]], unit: str) -> tuple[str, list[dict]]:
    spans = list(unit_spans(text, unit))
    kept: list[dict] = []
    for k, span in enumerate(spans):
        if span in lost:
            continue
        stop = spans[k + 1][0] if k + 1 < len(spans) else len(text)
        if kept and kept[-1]["stop"] == span[0]:
            kept[-1]["stop"] = stop
        else:
            kept.append({"begin": span[0], "stop": stop})
    return "".join(text[p["begin"] : p["stop"]] for p in kept), kept
