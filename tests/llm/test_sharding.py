"""Jump consistent hashing against its published loop."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import sharding
from tests.llm import edge_cases


def jump(key: int, shards: int) -> int:
    key, bucket, after = key % 2**64, -1, 0
    while after < shards:
        bucket = after
        key = (key * sharding.MULTIPLIER + 1) % 2**64
        after = int((bucket + 1) * (2.0**31 / ((key >> 33) + 1)))
    return bucket


@pytest.mark.parametrize("shards", [1, 2, 16, 100, 5000])
def test_shard_of_a_key(spark, shards):
    rng = random.Random(shards)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(2, 300), *[rng.randrange(-(2**63), 2**63) for _ in range(300)]]
    found = sharding.with_shard(spark.createDataFrame([(k,) for k in keys], "k long"), "k", shards).collect()
    assert len(found) == len(keys)
    for r in found:
        assert (r.shard, r.grown_shard) == (jump(r.k, shards), jump(r.k, shards + 1))
        assert r.grown_shard in (r.shard, shards)


def check(docs, rows):
    found = sharding.shard_documents(docs).collect()
    size = lambda t: len((t or "").encode())
    expected = Counter((i, size(t) + 1, zlib.crc32((t or "").encode()), "key", jump(i or 0, 16), jump(i or 0, 17)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found) == expected
    slots = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id, r.text_crc32)):
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ids = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot)) if r.shard == found[0].shard]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_edge_cases(spark):
    check(edge_cases.frame(spark), [(r[0], r[1]) for r in edge_cases.rows()])
    assert sharding.shard_documents(edge_cases.frame(spark).limit(0)).count() == 0


def test_one_id_and_no_id_for_most_rows(spark):
    rows = [(None, "a"), (7, "same")] * 300 + [(k, f"t{k}") for k in range(300)]
    check(edge_cases.frame(spark, [(*r, "en", "s", 0) for r in rows], partitions=7), rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_files_and_moves(spark, tmp_path):
    docs = edge_cases.frame(spark)
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(map(str, back.select(*docs.columns).collect())) == Counter(map(str, docs.collect()))
    assert all(r.shard == jump(r.doc_id or 0, 4) for r in back.collect())
    moved = sharding.moved_documents(docs, 4)
    assert moved.columns == docs.columns
    assert Counter(r.doc_id for r in moved.collect()) == Counter(
        r[0] for r in edge_cases.rows() if jump(r[0] or 0, 4) != jump(r[0] or 0, 5))
    with pytest.raises(ValueError):
        sharding.write_shards(docs.selectExpr("*", "1 as shard"), str(tmp_path / "again"))
