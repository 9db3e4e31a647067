"""The corpus pipeline against its stages by brute force."""

import corpus_pipeline
from corpus_pipeline import STAGES, documents, run
from ledgerloom.llm.simhash import text_fingerprint
from tests.llm import edge_cases
from tests.llm.test_exact_and_near import components_by_hand
from tests.llm.test_screening import leaks_by_hand

SF_DIR = "/root/testdata/sf0.01"


def test_pipeline_by_hand(spark):
    rows = {r.doc_id: r.text for r in documents(spark, SF_DIR).select("doc_id", "text").collect()}
    language = dict(corpus_pipeline.identified_language(spark, documents(spark, SF_DIR), SF_DIR).select("doc_id", "text").collect())
    assert set(language) <= set(rows) and len(language) > 0.97 * len(rows)
    last = {}
    for i in sorted(language):
        last[edge_cases.lowered(language[i])] = i
    exact = set(last.values())
    prints = {i: text_fingerprint(rows[i]) for i in exact}
    smallest = {}
    for i in sorted(exact, reverse=True):
        smallest[prints[i]] = i
    near = set(components_by_hand(smallest, 2).values())
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {r[0] for r in leaks_by_hand([(i, rows[i]) for i in near], items) if r[1]}
    found = run(spark, SF_DIR).collect()
    assert {r.doc_id for r in found} == near - leaks and len(found) == len(near - leaks)
    assert leaks and all(r.round_trip and r.n_tokens == len(r.ids) for r in found)


def test_stages_edge_cases(spark):
    docs = edge_cases.frame(spark)
    for table in (docs, docs.limit(0)):
        for name, stage in STAGES:
            result = stage(spark, table, SF_DIR)
            result.collect()
            if name != "token ids":
                assert result.columns == docs.columns
