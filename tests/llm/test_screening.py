"""Secrets and benchmark leaks against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import documents
from ledgerloom.llm import decontaminate, secret_scan
from tests.llm import edge_cases

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def spans_by_hand(text):
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    opaque = [m for m in re.finditer("[A-Za-z0-9+/_-]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 3, m.end(), m[0]) for m in opaque if all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
    return sorted(found)


def scan_by_hand(rows):
    owners = defaultdict(set)
    for _, text, repo in rows:
        for s in spans_by_hand(text or ""):
            owners[s[3]].add((repo or "").split("/")[0])
    result = []
    for doc_id, text, repo in rows:
        every = spans_by_hand(text or "")
        spans = [s for s in every if s[1] < 3 or len(owners[s[3]]) < secret_scan.WIDE_OWNERS]
        written = [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b, _ in spans]
        base = ",".join(w for w, s in zip(written, spans, strict=True) if s[1] < 3)
        live = sum(len(owners[s[3]]) < secret_scan.WIDE_OWNERS for s in every)
        counts = [sum(s[1] == k for s in spans) for k in range(3)]
        result.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(written), live, len(every) - live))
    return sorted(result, key=str)


SECRETS = [
    (30, "token=token:abcdefg secret = 'é' passwd:\"a.b=c-d", "en", "z", 0),
    (31, "ToKen:  \"Zm9vYmFyCg==\" " * 40, "en", "z", 0),
    (32, "é\U0001f600 AKIA" + "Z" * 16 + "AKIAAKIA" + "0" * 15, "en", None, 0),
    (33, "0" * 23 + "g" + "0" * 24 + "A" + "f" * 100, "en", "q/r", 0),
    (34, "Key toKen=abcdefgh paſſword=abcdefgh", "en", "q/r", 0),
    (35, "Ab1" * 9 + " " + "Cd2" * 9, "en", "q/s", 0),
    (36, "Ab1" * 9, "en", "t", 0),
]


def test_secrets_edge_cases(spark):
    data = edge_cases.rows() + SECRETS
    docs = edge_cases.frame(spark, data)
    found = secret_scan.scan_secrets(docs)
    assert sorted(map(tuple, found.collect()), key=str) == scan_by_hand([(r[0], r[1], r[3]) for r in data])
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def test_copied_example_and_live_secret(spark):
    data = [(k, "password = hunter2secret", "en", f"o{k}/r", 0) for k in range(4)] + [(9, "password = mine4567", "en", "o1/r", 0)]
    found = {r.doc_id: r for r in secret_scan.scan_secrets(edge_cases.frame(spark, data)).collect()}
    assert all(found[k].n_example == 1 and found[k].n_live == 0 for k in range(4)) and found[9].n_live == 1


def test_plan_has_no_python(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    for df in (secret_scan.find_candidates(docs), decontaminate.prepare_items(docs, "doc_id")):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def leaks_by_hand(docs, items):
    item_shingles = {i: edge_cases.shingles(edge_cases.letter_words(t)) for i, t in items if i is not None}
    result = []
    for doc_id, text in docs:
        mine, found = edge_cases.shingles(edge_cases.letter_words(text)), {}
        for i, item in item_shingles.items():
            if not item or not set(item) & set(mine):
                continue
            size = min(len(item), len(mine))
            best = max(edge_cases.weighted_jaccard(mine[s : s + size], item) for s in range(len(mine) - size + 1))
            if best >= decontaminate.MIN_SIMILARITY:
                found[i] = best
        result.append((doc_id, bool(found), len(found), sorted(found), max(found.values(), default=None)))
    return sorted(result, key=str)


def check_leaks(docs, benchmark):
    found = decontaminate.find_contaminated(docs, benchmark).collect()
    rounded = lambda rows: [(*r[:4], r[4] and round(r[4], 9)) for r in rows]
    mine = sorted(((r.doc_id, r.contaminated, r.n_items, list(r.item_ids), r.similarity) for r in found), key=str)
    by_hand = leaks_by_hand(
        [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    )
    assert rounded(mine) == rounded(by_hand)
    return found


def test_leaks_edge_cases(spark):
    shared = edge_cases.passage(1)
    swapped = edge_cases.passage(40).split()
    items = [(1, shared), (2, edge_cases.passage(2).upper()), (3, "Zwei wörter"), (4, None), (5, ""), (6, "!!"), (7, shared), (None, shared), (8, "a a a a a a a a a a"), (9, " ".join(swapped))]
    swapped[2], swapped[-3] = "inserted words", "other"
    extra = [
        (50, "so " + "a " * 9 + "it is", "en", "s", 0), (51, " ".join(shared.split()[:56]), "en", "s", 0), (52, "zwei Wörter mehr", "en", "s", 0),
        (53, f"lead {' '.join(swapped)} tail", "en", "s", 0), (54, shared.replace(" ", ",\n"), "en", "s", 0), (55, f"{shared} x {shared}", "en", "s", 0),
    ]
    docs = edge_cases.frame(spark, edge_cases.rows() + extra)
    benchmark = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("m"), F.lit("x").alias("window"))
    found = {r.doc_id: r for r in check_leaks(docs, benchmark)}
    assert found[1].contaminated and found[4].contaminated and found[9].item_ids == [3] and not found[52].contaminated
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.contaminated for r in decontaminate.find_contaminated(docs, benchmark).collect())
    assert decontaminate.find_contaminated(docs.limit(0), benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.find_contaminated(docs, benchmark.limit(0)).collect())


def test_leaks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    benchmark = spark.createDataFrame([(1, edge_cases.passage(1))], "item_id long, text string")
    check_leaks(edge_cases.frame(spark), benchmark)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_leaks_whole_table(spark, sf):
    folder = f"/root/testdata/{sf}"
    found = check_leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert any(r.contaminated for r in found)


def test_near_threshold_recall(spark):
    """Of windows at a similarity of 0.8 or a little more, the radius loses next to none."""
    rows, items = [], []
    for k in range(120):
        words = edge_cases.passage(500 + k, 44 + k % 14).split()
        items.append((k, " ".join(words)))
        words[-1 - k % 4] = "changed"  # up to four shingles differ
        rows.append((k, f"{edge_cases.passage(900 + k, 20)} {' '.join(words)} {edge_cases.passage(700 + k, 20)}", "en", "s", 0))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contaminated(edge_cases.frame(spark, rows), benchmark).collect()
    by_hand = leaks_by_hand([(r[0], r[1]) for r in rows], items)
    assert sum(r.contaminated for r in found) >= 0.98 * sum(r[1] for r in by_hand)
