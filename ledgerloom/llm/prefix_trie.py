"""The trie of conversation prefixes, with totals of every subtree.

A prefix is named by sums of hashes: each turn's hash covers its place and content, so running
sums over a conversation name all of its prefixes, and they add up over range partitions like
any running total. No task needs a conversation as a whole. Equal names are one node; subtree totals come
from tree contraction (`contraction`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_rows
from ledgerloom.llm.contraction import subtree_sums
from ledgerloom.llm.turns import turn_digest, turns_of
from ledgerloom.plans.numbering import running_within
from ledgerloom.plans.shared import Stored

#: Conversations of one family start like the one whose id has this remainder zero.
FAMILY = 100
#: A conversation takes fewer than this many turns from its family.
SHARED_TURNS = 6

_WORDS = [f"word_{k}" for k in range(4)]


def _name(depth: Column, words: list[Column]) -> Column:
    """16 bytes from the depth and the sums."""
    parts = [c.cast("string") for c in (depth, *words)]
    return F.unhex(F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 32))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position, digest and chars of every turn, by turn (nulls first), then by digest.

    A null role or text is empty. Rows of a null conv_id are one conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = Stored(turns_of(conversations).select(
        "conv_id", "turn", turn_digest(role, text).alias("digest"), F.char_length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row")), "slim-turns")
    placed, _ = running_within(slim.frame, ["conv_id"], ["turn", "digest", "row"])
    slim.drop()
    return placed.select("conv_id", "position", "digest", "chars")


def rebuild_families(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation's start was replaced by its family's.

    Conversation c starts with the first h turns of c - c % FAMILY, where h = crc32(decimal c) %
    SHARED_TURNS (all of them if there are fewer, none if it is absent), and goes on with its own turns
    after its first h. A null conv_id keeps its own turns. The first result adds `final`, whether a
    turn is the last; the second has conv_id and length.
    """
    hashed = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED_TURNS
    wanted = F.coalesce(hashed, F.lit(0)).cast("long")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("wanted", wanted)
    family = own.select(F.col("conv_id").alias("_base"), F.least("own", F.lit(SHARED_TURNS - 1)).alias("there"))
    convs = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(
        family, F.col("base") == F.col("_base"), "left").select(
        "conv_id", "base", "wanted", F.least("wanted", F.coalesce("there", F.lit(0))).alias("taken"), "own")
    length = F.col("taken") + F.greatest(F.col("own") - F.col("wanted"), F.lit(0))
    convs = convs.withColumn("length", length)
    starts = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("position") < SHARED_TURNS - 1)).withColumnRenamed("conv_id", "_base")
    heads = convs.join(starts, (F.col("base") == F.col("_base")) & (F.col("position") < F.col("taken"))).select(
        "conv_id", "position", "digest", "chars", (F.col("position") + 1 == F.col("length")).alias("final"))
    rest = turns.where(F.col("position") >= wanted).alias("t")
    tails = rest.join(convs.alias("c"), F.col("t.conv_id").eqNullSafe(F.col("c.conv_id"))).select(
        "t.conv_id", (F.col("position") - F.col("wanted") + F.col("taken")).alias("position"), "digest", "chars",
    ).alias("t")
    tails = tails.join(convs.select("conv_id", "length").alias("c"), F.col("t.conv_id").eqNullSafe(F.col("c.conv_id"))).select(
        "t.conv_id", "position", "digest", "chars", (F.col("position") + 1 == F.col("length")).alias("final"))
    return heads.unionByName(tails), convs.select("conv_id", "length")


_ENDS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids; the ids pass one by one."""
    def digested() -> Iterator[tuple]:
        node, sha = None, None
        for batch in batches:
            for new, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if new != node:
                    if node is not None:
                        yield node, sha.hexdigest()
                    node, sha = new, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(b"" if conv_id is None else str(conv_id).encode())
        if node is not None:
            yield node, sha.hexdigest()

    yield from arrow_rows(digested(), _ENDS)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix, from the turns and conversations of `rebuild_families` (or others).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Members are the conversations that start with the prefix; the
    root has all of them, those without turns included. Defined results: a null conv_id is the smallest
    member only where it is the only one, and is written as nothing in the hashed list; conversations that are equal
    share all their nodes; no conversations give no rows. Nodes with very many members combine
    them before the shuffle; only the ids that end at one node pass through one task, for their hash.
    """
    spread = F.sha2(F.concat(F.col("position").cast("string"), F.lit(":"), F.hex("digest")).cast("binary"), 256)
    pieces = {w: F.conv(F.substring(F.col("_spread"), 8 * k + 1, 8), 16, 10).cast("long") for k, w in enumerate(_WORDS)}
    hashed = Stored(turns.withColumn("_spread", spread).select(
        "conv_id", "position", "chars", "final", *[c.alias(w) for w, c in pieces.items()]), "hashed-turns")
    sums = {f"sum_{w}": w for w in _WORDS}
    running, ranged = running_within(hashed.frame, ["conv_id"], ["position"], sums, name="_nth")
    hashed.drop()
    depth = F.col("position") + 1
    upto = [F.col(s) for s in sums]
    until = [F.col(s) - F.col(w) for s, w in sums.items()]
    start = _name(F.lit(0), [F.lit(0)] * len(_WORDS))
    members = Stored(running.select(
        "conv_id", depth.alias("depth"), _name(depth, upto).alias("node"), _name(F.col("position"), until).alias("parent"),
        "chars", "final",
    ).unionByName(convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), start.alias("node"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("chars"), (F.col("length") == 0).alias("final"))), "members")
    ranged.drop()
    nodes = Stored(members.frame.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"),
        F.count("*").alias("n_convs"), F.max("chars").alias("chars")), "nodes")
    fanout = nodes.frame.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    tree = Stored(nodes.frame.join(fanout, "node", "left").select(
        "node", "conv_id", "depth", "parent", "n_convs", F.coalesce("children", F.lit(0)).alias("children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "trie")
    nodes.drop()
    totals = subtree_sums(tree.frame.withColumn("n_leaves", (F.col("children") == 0).cast("long")), ["n_leaves", "saved_tokens"])
    ends = members.frame.where("final").select("node", "conv_id").repartition("node").sortWithinPartitions(
        "node", "conv_id").mapInArrow(_end_digests, "node binary, ends_sha256 string")
    above = tree.frame.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    joined = tree.frame.drop("saved_tokens").join(totals.frame, "node").join(above, "parent", "left").join(ends, "node", "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def family_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations of a table (conv_id, turn, role, text; other columns are ignored)."""
    turns, convs = rebuild_families(numbered_turns(conversations))
    return prefix_trie(turns, convs)
