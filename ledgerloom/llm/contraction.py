"""Sums over every subtree by parallel tree contraction.

Each round first rakes: leaves add their sums to their parents and leave. Then it compresses: nodes with
one child left are taken out, no two neighbours at once; their sums go to the parent, and their
child hangs on the parent. So a chain loses a constant share of its nodes each round, and the
number of rounds grows with the logarithm of the tree, not with its depth.

A raked node's sums are final. A node taken out has its sums so far and those of the child it had then;
these records form chains no longer than the number of rounds, which pointer doubling resolves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.shared import Stored


def _rank(node: Column, turn: int) -> Column:
    return F.xxhash64(node, F.lit(turn))


def _raked(tree: DataFrame, sums: Sequence[str]) -> DataFrame:
    """The inner nodes with the sums of their leaves added and their number of children left."""
    leaves = tree.where("children = 0").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("_gone"), *[F.sum(s).alias(f"_add_{s}") for s in sums])
    joined = tree.where("children > 0").join(leaves, "node", "left")
    return joined.select(
        "node", "parent", (F.col("children") - F.coalesce("_gone", F.lit(0))).alias("children"),
        *[(F.col(s) + F.coalesce(F.col(f"_add_{s}"), F.lit(0))).alias(s) for s in sums])


def _taken_out(inner: DataFrame, sums: Sequence[str], turn: int) -> DataFrame:
    """(node, above, child, sums) of the nodes that leave.

    They have one child and a parent, and rank before both where these have one child too, so
    no two neighbours leave at once: a third of a chain does on average.
    """
    single = F.col("children") == 1
    out = inner.where(single & F.col("parent").isNotNull()).alias("o")
    above = inner.select(F.col("node").alias("above"), single.alias("_single_above"))
    below = inner.select(F.col("parent").alias("of"), F.col("node").alias("child"), single.alias("_single_below"))
    joined = out.join(above, F.col("o.parent") == F.col("above")).join(below, F.col("o.node") == F.col("of"))
    mine = _rank(F.col("o.node"), turn)
    return joined.where(
        (~F.col("_single_above") | (mine > _rank(F.col("above"), turn)))
        & (~F.col("_single_below") | (mine > _rank(F.col("child"), turn)))
    ).select("o.node", "above", "child", *[F.col(f"o.{s}").alias(s) for s in sums])


def _compressed(inner: DataFrame, out: DataFrame, sums: Sequence[str]) -> DataFrame:
    """The tree without the nodes taken out."""
    moved = out.select(F.col("child").alias("node"), F.col("above").alias("_up"))
    added = out.groupBy(F.col("above").alias("node")).agg(*[F.sum(s).alias(f"_add_{s}") for s in sums])
    left = inner.join(out.select("node"), "node", "left_anti").join(moved, "node", "left").join(added, "node", "left")
    return left.select(
        "node", F.coalesce("_up", "parent").alias("parent"), "children",
        *[(F.col(s) + F.coalesce(F.col(f"_add_{s}"), F.lit(0))).alias(s) for s in sums])


def subtree_sums(tree: DataFrame, sums: Sequence[str]) -> Stored:
    """(node, *sums) with every column of `sums` added up over the node's subtree, itself included.

    `tree` has node, parent (null for a root) and children (their number), and bigint columns
    without nulls; nodes are unique and never null. It may hold several trees; an empty table
    gives no rows. A node may have any number of children: they combine before the shuffle.
    """
    columns = ["node", "parent", "children", *sums]
    state, turn = Stored(tree.select(*columns), "tree"), 0
    states, records = [state], []
    while True:
        inner = Stored(_raked(state.frame, sums), "inner")
        if inner.frame.isEmpty():
            inner.drop()
            break
        out = Stored(_taken_out(inner.frame, sums, turn), "taken-out")
        state, turn = Stored(_compressed(inner.frame, out.frame, sums), "tree"), turn + 1
        inner.drop()
        states.append(state)
        records.append(out)
    final = states[0].frame.where("children = 0").select("node", *sums)
    for s in states[1:]:
        final = final.unionByName(s.frame.where("children = 0").select("node", *sums))
    if not records:
        done = Stored(final, "subtree-sums")
    else:
        chains = records[0].frame.select("node", "child", *sums)
        for r in records[1:]:
            chains = chains.unionByName(r.frame.select("node", "child", *sums))
        chains, reach = Stored(chains, "records"), 1
        while reach < len(records):
            longer = Stored(_jumped(chains.frame, sums), "records")
            chains.drop()
            chains, reach = longer, 2 * reach
        ends = final.select(F.col("node").alias("child"), *[F.col(s).alias(f"_end_{s}") for s in sums])
        rest = chains.frame.join(ends, "child").select("node", *[(F.col(s) + F.col(f"_end_{s}")).alias(s) for s in sums])
        done = Stored(final.unionByName(rest), "subtree-sums")
        chains.drop()
    for s in (*states, *records):
        s.drop()
    return done


def _jumped(chains: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Every record joined to the one of its child, if the child was taken out as well."""
    nxt = chains.select(
        F.col("node").alias("_of"), F.col("child").alias("_child"), *[F.col(s).alias(f"_add_{s}") for s in sums])
    return chains.join(nxt, F.col("child") == F.col("_of"), "left").select(
        "node", F.coalesce("_child", "child").alias("child"),
        *[(F.col(s) + F.coalesce(F.col(f"_add_{s}"), F.lit(0))).alias(s) for s in sums])
