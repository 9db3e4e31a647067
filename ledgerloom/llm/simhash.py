"""SimHash near-deduplication with BK-trees.

Fingerprints that differ in at most `radius` bits agree on at least two of `radius + 2` blocks of
bits. Every distinct fingerprint therefore goes to one bucket per pair of blocks, and only buckets with two
or more members matter. With a radius of 2 a pair has 32 bits, so buckets are small. A bucket is cut into parts of a bounded number of fingerprints. Each part
becomes one BK-tree, whose children hang on edges labelled with their Hamming distance to the
parent; the tree of a part is sent to every part of its bucket that has to be searched against it,
and a search follows only edges within the radius.

A tree and the queries sent to it are bounded, however large a bucket is. Trees travel through a
shuffle: a broadcast from the driver would need all fingerprints there. Equal fingerprints are one
entry, so copies do not multiply. Of the links found, a task passes on a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SIEVE_KEYS, ids_and_texts, texts_of, without
from ledgerloom.llm.components import smallest_reachable
from ledgerloom.plans.shared import Stored

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
PART_SIZE = 4096
SHARD_ROWS = 50_000

_CHUNK = 1 << 15
_ROW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fingerprint", pa.int64())])


def text_fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64 majority bits of the hashes of all shingles; 0 without words.

    A-Z are lower-cased, words are separated by ASCII white space, and a text with fewer words
    than a shingle is one shingle. Shingles are hashed in chunks, so memory does not grow with them.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    total = max(1, len(words) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, total, _CHUNK):
        part = words[start : start + _CHUNK + shingle_words - 1]
        spans = zip(*(part[k:] for k in range(shingle_words)), strict=False) if total > 1 or len(words) == shingle_words else [part]
        hashes = np.fromiter((digest(b" ".join(s), HASH_SEED) for s in spans), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash (XXH64 of the text) and fingerprint (its 64 bits as a signed long) of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((text_fingerprint(t, shingle_words) for t in texts_of(batch)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], schema=_ROW)

    rows = ids_and_texts(docs, id_col, text_col).select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    return rows.mapInArrow(compute, "doc_id bigint, text_hash bigint, fingerprint bigint")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


class BKForest:
    """BK-trees over many units at once, built and searched level by level.

    `codes` and `units` describe the members. The first member of a unit is its root. Inserting one
    by one gives the same trees: a member walks down the edge of its distance to each node it meets,
    and of those that reach a missing edge together the first becomes the child.
    """

    def __init__(self, codes: np.ndarray, units: np.ndarray) -> None:
        self.codes = codes
        self.root_units, roots = np.unique(units, return_index=True)
        self.roots = roots
        at = roots[np.searchsorted(self.root_units, units)]
        waiting = np.setdiff1d(np.arange(len(codes)), roots)
        edges, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        at = at[waiting]
        while len(waiting):
            edge = at * 65 + np.bitwise_count(codes[waiting] ^ codes[at])
            order = np.argsort(edge, kind="stable")
            waiting, edge = waiting[order], edge[order]
            first = np.flatnonzero(np.diff(edge, prepend=-1))
            child = waiting[first]
            edges.append(edge[first])
            children.append(child)
            group = np.cumsum(np.diff(edge, prepend=-1) != 0) - 1
            rest = np.ones(len(waiting), bool)
            rest[first] = False
            waiting, at = waiting[rest], child[group][rest]
        all_edges, all_children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(all_edges)
        self.edges, self.children = all_edges[order], all_children[order]

    def within(self, codes: np.ndarray, units: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) index pairs of each unit at most `radius` bits apart."""
        known = np.isin(units, self.root_units)
        query = np.flatnonzero(known)
        node = self.roots[np.searchsorted(self.root_units, units[query])]
        while len(query):
            distance = np.bitwise_count(codes[query] ^ self.codes[node]).astype(np.int64)
            near = distance <= radius
            yield query[near], node[near]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), side="right")
            count = high - low
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            node = self.children[np.repeat(low, count) + offset]
            query = np.repeat(query, count)


def _forest_links(radius: int):
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        names, node = np.unique(pdf["rep"].to_numpy(), return_inverse=True)
        units = pdf.groupby(["bits", "pair", "low", "high"]).ngroup().to_numpy()
        codes = pdf["fingerprint"].to_numpy().view(np.uint64)
        member = ~pdf["query_only"].to_numpy()
        asks = (pdf["low"] == pdf["high"]).to_numpy() | ~member
        trees = BKForest(codes[member], units[member])
        member_node, asks_at = node[member], np.flatnonzero(asks)
        label = np.arange(len(names))
        for start in range(0, len(asks_at), _CHUNK):
            some = asks_at[start : start + _CHUNK]
            for q, m in trees.within(codes[some], units[some], radius):
                label = _unite(label, node[some[q]], member_node[m])
        joined = np.flatnonzero(label != np.arange(len(names)))
        return pd.DataFrame({"a": names[label[joined]], "b": names[joined]})

    return find


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: every node gets the smallest index of its set."""
    while True:
        low = np.minimum(label[a], label[b])
        if np.array_equal(label[a], label[b]):
            return label
        label = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def near_links(distinct: DataFrame, radius: int = MAX_BITS, part_size: int = PART_SIZE) -> DataFrame:
    """Links a, b between representatives (columns fingerprint, rep) that join all within `radius` bits.

    Pairs within the radius are connected by the returned links; they are a spanning forest per
    task, so there are fewer links than members however dense a group is.
    """
    blocks = radius + 2
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(blocks)]
    pairs = list(combinations(range(blocks), 2))
    # the bits of both blocks where they stand, and which pair it is
    value = F.array(*[
        F.struct(F.col("fingerprint").bitwiseAND(_signed(masks[i] | masks[j])).alias("bits"), F.lit(k).alias("pair"))
        for k, (i, j) in enumerate(pairs)
    ])
    spread = distinct.select("fingerprint", "rep", F.explode(value).alias("bucket"))
    sizes = spread.groupBy("bucket").count().filter("count > 1")
    parts = F.ceil(F.col("count") / part_size).cast("int")
    members = spread.join(sizes, "bucket").withColumn("parts", parts).withColumn(
        "part", F.pmod(F.xxhash64("fingerprint", "bucket"), F.col("parts")).cast("int")
    )
    against = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = Stored(against.select(
        "bucket.bits", "bucket.pair", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        (F.col("part") > F.col("other")).alias("query_only"), "fingerprint", "rep",
    ), "bk-units")
    shards = max(1, -(-units.frame.count() // SHARD_ROWS))
    links = Stored(
        units.frame.groupBy(F.pmod(F.xxhash64("bits", "pair", "low", "high"), F.lit(shards)).alias("shard"))
        .applyInPandas(_forest_links(radius), "a bigint, b bigint"),
        "bk-links",
    )
    units.drop()
    return links.frame


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS, radius: int = MAX_BITS, part_size: int = PART_SIZE,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lowercase hex digits), component_id, text_hash, group.

    component_id is the smallest doc_id that is reachable over fingerprints at most `radius` bits
    apart. Defined results: null, empty and blank texts have fingerprint 0 and link like any other;
    rows with a null id get the component of the rows they link with, or null if none of these has an
    id (`group`, the smallest fingerprint as a signed long, tells such groups apart); repeated rows give
    repeated results; an empty table gives no rows; other columns are ignored.
    """
    prints = Stored(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints").frame
    distinct = Stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    components = smallest_reachable(near_links(distinct.frame.select("fingerprint", F.col("fingerprint").alias("rep")), radius, part_size))
    grouped = Stored(
        distinct.frame.join(components, F.col("fingerprint") == F.col("node"), "left")
        .select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("group")),
        "groups",
    )
    distinct.drop()
    smallest = grouped.frame.groupBy("group").agg(F.min("first_id").alias("component_id"))
    named = Stored(grouped.frame.select("fingerprint", "group").join(smallest, "group"), "components")
    grouped.drop()
    return prints.join(named.frame, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", "text_hash", "group",
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = MAX_BITS,
    sieve_keys: int = SIEVE_KEYS,
) -> DataFrame:
    """The rows of `docs`, with all columns, of one document per group: the smallest id that is not null,
    then the smallest text_hash. Rows repeated in full are one document, and all of them stay. Defined results: null,
    empty and blank texts are one group; an empty table stays empty; other columns may have any name."""
    found = Stored(near_duplicates(docs, id_col, text_col, shingle_words, radius), "near").frame
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = found.groupBy("group").agg(F.min(rank).alias("first"), F.count("*").alias("size")).filter("size > 1").drop("size")
    lost = Stored(found.join(first, "group").filter(rank != F.col("first")).select("doc_id", "text_hash").distinct(), "lost-near").frame
    same = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("x.doc_id")) & (
        text_hash(F.col(f"d.`{text_col}`").cast("string")) == F.col("x.text_hash")
    )
    return without(docs, F.col(f"`{id_col}`").cast("long"), lost, F.col("doc_id"), same, sieve_keys)
