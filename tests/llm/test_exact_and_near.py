"""Exact copies and near copies against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpus_pipeline import documents
from ledgerloom.llm import golomb
from ledgerloom.llm.common import possible_matches, without
from ledgerloom.llm.components import smallest_reachable
from ledgerloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from ledgerloom.llm.simhash import (
    BKForest,
    drop_near_duplicates,
    fingerprints,
    near_duplicates,
    near_links,
    text_fingerprint,
)
from ledgerloom.plans.shared import Stored
from tests.llm import edge_cases

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(6))
def test_golomb_round_trip(seed):
    rng = np.random.default_rng(seed)
    span = int(rng.integers(2, 1 << 40))
    values = np.unique(rng.integers(0, span, rng.integers(1, 500))) + 17
    bits = golomb.rice_bits(span, len(values))
    assert np.array_equal(golomb.decode(golomb.encode(values, 17, bits), len(values), 17, bits), values)


def test_owner_lists_hold_all():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << golomb.FINGERPRINT_BITS, 1000))
    lists = golomb.owner_lists(values, 7)
    parts = [golomb.decode(p, n, golomb.owner_low(o, 7), b) for o, n, b, p in lists]
    assert np.array_equal(np.concatenate(parts), values)


def exact_by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[edge_cases.lowered(text)].append(doc_id)
    result = []
    for doc_id, text in rows:
        same = groups[edge_cases.lowered(text)]
        keep = max((i for i in same if i is not None), default=None)
        result.append((doc_id, keep, len(same), hashlib.sha256(edge_cases.lowered(text)).hexdigest()))
    return result


@pytest.mark.parametrize("block_rows", [2, 1 << 16])
def test_exact_edge_cases(spark, block_rows):
    docs = edge_cases.frame(spark)
    found = exact_duplicates(docs, owners=5, block_rows=block_rows).collect()
    mine = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found)
    assert mine == Counter(exact_by_hand([(r[0], r[1]) for r in edge_cases.rows()]))
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_exact_whole_table(spark):
    docs = documents(spark, SF_DIR)
    found = exact_duplicates(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == Counter(exact_by_hand(rows))


def test_drop_exact(spark):
    docs = edge_cases.frame(spark)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    texts = [edge_cases.lowered(r.text) for r in left.collect()]
    assert sorted(texts) == sorted({edge_cases.lowered(r[1]) for r in edge_cases.rows()})
    assert drop_exact_duplicates(docs.limit(0)).count() == 0


def fingerprint_by_hand(text, size=3):
    words = edge_cases.lowered(text).split()
    parts = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_hand():
    for text in [r[1] for r in edge_cases.rows()] + ["one", "one two", "A b C", "a b c d"]:
        if text is None or len(text) < 5000:
            assert text_fingerprint(text) == fingerprint_by_hand(text)


def test_fingerprint_hash_is_sparks(spark):
    row = spark.sql("select xxhash64('a b c') as h").first()
    assert row.h % 2**64 == text_fingerprint("A b  C")


def test_bk_tree_finds_all():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 8, dtype=np.uint64)
    codes = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 12, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 60).astype(np.uint64)) for c in centres]))
    units = rng.integers(0, 3, len(codes))
    for radius in (0, 2, 5):
        pairs = {(int(q), int(m)) for a, b in BKForest(codes, units).within(codes, units, radius) for q, m in zip(a, b, strict=True)}
        near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius) & (units[:, None] == units[None, :])
        assert pairs == set(zip(*map(list, np.nonzero(near)), strict=True))


def components_by_hand(codes: dict[int, int], radius: int) -> dict[int, int]:
    """Smallest id reachable, by id, for code -> smallest id."""
    values = np.array(list(codes), np.uint64)
    ids = [codes[int(v)] for v in values]
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = root(i), root(j)
        if a != b:
            label[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return {int(v): ids[root(i)] for i, v in enumerate(values)}


@pytest.mark.parametrize("part_size", [3, 4096])
def test_links_connect_dense_groups(spark, part_size):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    codes = {base ^ int(x): k + 1 for k, x in enumerate(np.unique(rng.integers(0, 2**11, 300)))}
    codes |= {int(x): 1000 + k for k, x in enumerate(rng.integers(0, 2**62, 50))}
    df = spark.createDataFrame([(c, i) for c, i in codes.items()], "fingerprint long, rep long")
    links = near_links(df, 2, part_size)
    assert links.count() <= 3 * len(codes)
    found = dict(smallest_reachable(links).collect())
    assert {i: found.get(i, i) for i in codes.values()} == {codes[c]: r for c, r in components_by_hand(codes, 2).items()}


def check_near(docs):
    found = near_duplicates(docs).collect()
    smallest = {}
    for r in found:
        code = int(r.fingerprint, 16)
        if r.doc_id is not None:
            smallest[code] = min(smallest.get(code, r.doc_id), r.doc_id)
    without = {int(r.fingerprint, 16) for r in found} - set(smallest)
    groups = components_by_hand(smallest | {c: 2**62 + k for k, c in enumerate(sorted(without))}, 2)
    for r in found:
        expected = groups[int(r.fingerprint, 16)]
        assert r.component_id == (expected if expected < 2**62 else None)
    return found


def test_near_edge_cases(spark):
    docs = edge_cases.frame(spark)
    found = check_near(docs)
    assert len(found) == len(edge_cases.rows())
    blank = {r.doc_id: r.fingerprint for r in found if r.doc_id in (6, 7, 8)}
    assert set(blank.values()) == {"0" * 16}
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert 1 in ids and 2 not in ids and 19 not in ids and 7 not in ids
    assert near_duplicates(docs.limit(0)).count() == 0


def test_ids_without_a_limit(spark):
    largest = 2**63 - 1
    rows = [(largest, "one two three four", "en", "s", 0), (None, "one two three four", "en", "s", 0), (2**62, "five six", "en", "s", 0),
            (-(2**63), "five  SIX", "en", "s", 0), (None, "seven eight nine", "en", "s", 0)]
    found = near_duplicates(edge_cases.frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter(
        [(largest, largest), (None, largest), (2**62, -(2**63)), (-(2**63), -(2**63)), (None, None)]
    )
    left = drop_near_duplicates(edge_cases.frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in left) == Counter([largest, -(2**63), None])


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_links_at_every_radius(spark, radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    codes = {int(c) for c in centres}
    for centre in centres:
        for _ in range(10):
            flips = rng.choice(64, rng.integers(0, radius + 3), replace=False)
            codes.add(int(centre) ^ sum(1 << int(b) for b in flips))
    numbered = {c: k for k, c in enumerate(sorted(codes))}
    signed = [(c - 2**64 if c >> 63 else c, k) for c, k in numbered.items()]
    found = dict(smallest_reachable(near_links(spark.createDataFrame(signed, "fingerprint long, rep long"), radius)).collect())
    assert {k: found.get(k, k) for k in numbered.values()} == {numbered[c]: r for c, r in components_by_hand(numbered, radius).items()}


def test_sieve_and_plain_joins_agree(spark):
    docs = edge_cases.frame(spark)
    for sieve_keys in (0, 4_000_000):
        exact = exact_duplicates(docs, sieve_keys=sieve_keys).collect()
        mine = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact)
        assert mine == Counter(exact_by_hand([(r[0], r[1]) for r in edge_cases.rows()]))
    rows = [Counter(map(str, drop(docs, sieve_keys=k).collect())) for drop in (drop_exact_duplicates, drop_near_duplicates) for k in (0, 4_000_000)]
    assert rows[0] == rows[1] and rows[2] == rows[3]


def test_sieve_keeps_every_match_and_few_others(spark):
    rows = spark.range(200_000).selectExpr("if(id = 7, null, id) as k")
    wanted = Stored(rows.filter("k is null or k % 10 = 0"), "sieve-test").frame
    kept = {r.k for r in possible_matches(rows, F.col("k"), wanted, F.col("k")).collect()}
    assert kept >= {None, *range(0, 200_000, 10)} and len(kept) < 30_000
    same = F.col("d.k").eqNullSafe(F.col("x.k"))
    left = {r.k for r in without(rows, F.col("k"), wanted, F.col("k"), same).collect()}
    assert left == {i for i in range(200_000) if i % 10 and i != 7}
    none = Stored(rows.filter("k < 0"), "sieve-none").frame
    assert possible_matches(rows, F.col("k"), none, F.col("k")).count() == 0
    assert without(rows, F.col("k"), none, F.col("k"), same).count() == 200_000


def test_near_whole_table(spark):
    docs = documents(spark, SF_DIR)
    found = check_near(docs)
    assert len({r.component_id for r in found}) < len(found)


def test_near_copies_of_thousands(spark):
    text = edge_cases.passage(9, 400).split()
    rows = []
    for k in range(1500):
        words = list(text)
        words[k % 400] = f"w{k}"
        rows.append((k, " ".join(words), "en", "s", 0))
    docs = edge_cases.frame(spark, rows, partitions=8)
    check_near(docs)
    assert fingerprints(docs).count() == 1500


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(100, k) for k in range(101, 400)]
    found = dict(smallest_reachable(spark.createDataFrame(path + star, "a long, b long")).collect())
    assert all(found[k] == 1 for k in range(1, 61)) and all(found[k] == 100 for k in range(100, 400))
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0
