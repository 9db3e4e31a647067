"""The prefix trie and tree contraction against brute force."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import contraction, prefix_trie
from tests.llm.test_conversations import COLUMNS, SF_DIR, digest, in_order, random_turns, sha


def trie_by_hand(rows: list[tuple]) -> set:
    plain = [(c, t, r or "", x or "") for c, t, r, x in rows]
    own = {c: [(r, x) for _, r, x in g] for c, g in in_order(plain).items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if c is not None else 0
        base = own.get(c - c % 100, []) if c is not None else []
        built[c] = tuple(base[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, group in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(group) - 1) * len(node[-1][1]) if node else 0
    smallest = {n: min((c for c in g if c is not None), default=None) for n, g in members.items()}
    out = set()
    for node, group in members.items():
        ends = sorted((c for c in group if len(built[c]) == len(node)), key=lambda c: (c is not None, c))
        out.add((
            smallest[node], len(node), smallest[node[:-1]] if node else None, len(group), children[node], leaves[node],
            saved[node], sha(",".join("" if c is None else str(c) for c in ends))))
    return out


def as_rows(df) -> list[tuple]:
    return [tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


def test_order_of_turns_is_by_digest():
    assert digest("user", "a") != digest("use", "ra")


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_random_conversations(spark, seed):
    rows = random_turns(seed, 60)
    rng = random.Random(seed)
    rows += [(c, t, "user", rng.choice("ab")) for c in range(500, 560) for t in range(rng.randint(1, 7))]
    rows += [(None, 1, "user", "a"), (None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(3).selectExpr("*", "1 as node", "2 as position", "'x' as digest")
    found = as_rows(prefix_trie.family_trie(df))
    assert len(found) == len(set(found)) and set(found) == trie_by_hand(rows)


def test_trie_of_whole_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert set(as_rows(prefix_trie.family_trie(table))) == trie_by_hand(rows)


def test_trie_of_many_copies_and_a_long_one(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(1, 400) for t in range(6, 9)]
    rows += [(7000, t, "user", "long" if t % 2 else "é" * 50_000) for t in range(300)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert set(as_rows(prefix_trie.family_trie(df))) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.family_trie(spark.createDataFrame([], COLUMNS)).count() == 0


@pytest.mark.parametrize("shape", ["path", "star", "random", "broom"])
def test_contraction(spark, shape):
    rng = random.Random(shape)
    n = 300
    parent = {k: {"path": k - 1, "star": 0, "random": rng.randrange(k), "broom": k - 1 if k < 150 else 149}[shape] for k in range(1, n)}
    parent |= {0: None, 1000: None}  # a second tree of one node
    degree = defaultdict(int)
    for p in parent.values():
        degree[p] += 1
    total = {k: k + 1 for k in parent}
    for k in sorted(parent, reverse=True):
        if parent[k] is not None:
            total[parent[k]] += total[k]
    tree = spark.createDataFrame([(k, p, degree[k], k + 1) for k, p in parent.items()], "node long, parent long, children long, weight long")
    found = contraction.subtree_sums(tree.withColumn("one", F.lit(1).cast("long")), ["weight", "one"])
    rows = found.frame.collect()
    assert {r.node: r.weight for r in rows} == total and len(rows) == len(parent)
    assert {r.node: r.one for r in rows}[0] == n
