"""Language mixtures and quality ranking: edge cases and held-out accuracy."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import documents
from ledgerloom.llm import language, quality
from ledgerloom.llm.common import held_out
from ledgerloom.llm.queries import op2_pairwise_quality, op10_language_mixture
from tests.llm import edge_cases

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language.fit_languages(documents(spark, SF_DIR).filter(~held_out(F.col("doc_id"))))


def test_language_accuracy(spark):
    found = op10_language_mixture(spark, SF_DIR).join(documents(spark, SF_DIR).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_language_edge_cases(spark, model):
    docs = edge_cases.frame(spark)
    found = language.identify_languages(docs, model).collect()
    assert len(found) == len(edge_cases.rows())
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (6, 7, 8, 15))
    assert all(r.lang_pred in model.languages for r in found if r.doc_id not in (6, 7, 8, 15))
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {6, 7, 8, 15} & {r.doc_id for r in kept.collect()}
    assert language.keep_identified(docs.limit(0), model).count() == 0
    nothing = language.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in language.identify_languages(docs, nothing).collect()} == {"und"}


def test_fit_ignores_missing_labels(spark):
    docs = edge_cases.frame(spark)
    learned = language.fit_languages(docs)
    assert learned.languages == ("de", "en", "fr")
    assert np.allclose(learned.probabilities.sum(axis=0), 1)


def test_counts_of_a_long_text_are_those_of_its_whole(monkeypatch):
    text = edge_cases.passage(3, 900) + " É日本 " + "z" * 10
    whole = language._cell_counts(text)
    monkeypatch.setattr(language, "_CHUNK", 64)
    parts = language._cell_counts(text)
    assert abs(int(whole[1].sum()) - int(parts[1].sum())) <= 3 * len(text) // 64
    assert set(whole[0]) <= set(parts[0]) and whole[2] == parts[2]


def test_memory_of_mixtures_does_not_follow_the_languages(monkeypatch):
    rng = np.random.default_rng(5)
    weights = rng.random((language.CELLS, 64)) + 0.1
    model = language.LanguageModel(tuple(f"l{k:02d}" for k in range(64)), weights / weights.sum(axis=0))
    texts = ["".join(map(chr, rng.integers(97, 123, 600))) for _ in range(60)]
    language._letters()
    tracemalloc.start()
    named = list(language._name(model, iter(texts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    monkeypatch.setattr(language, "_TABLE", 1 << 30)
    assert named == list(language._name(model, iter(texts)))


def test_texts_that_are_no_strings_are_read_as_such(spark, model):
    docs = edge_cases.frame(spark)
    as_bytes = docs.withColumn("text", F.col("text").cast("binary"))
    kept = language.keep_identified(as_bytes, model)
    assert kept.schema == as_bytes.schema
    assert sorted(map(str, kept.select("doc_id").collect())) == sorted(
        map(str, language.keep_identified(docs, model).select("doc_id").collect()))


def likelihood_by_hand(model, cells, counts, share):
    return float((counts * np.log(model.probabilities[cells] @ share)).sum())


def test_mixture_matches_plain_em(model):
    rng = np.random.default_rng(1)
    k = len(model.languages)
    docs = []
    for parts in ([0], [1, 2], [3]):
        cells = np.concatenate([rng.choice(language.CELLS, 300, p=model.probabilities[:, p]) for p in parts])
        docs.append(np.unique(cells, return_counts=True))
    shares = language.mixtures(model, docs)
    for (cells, counts), share in zip(docs, shares, strict=True):
        n = counts.sum()
        price = language.PENALTY * np.log(n + 1)
        candidates = [np.eye(k)[i] for i in range(k)]
        full = np.full(k, 1 / k)
        for _ in range(language.ROUNDS):
            joint = model.probabilities[cells] * full
            full = (joint / joint.sum(axis=1, keepdims=True) * counts[:, None]).sum(axis=0) / n
        for size in range(2, k + 1):
            some = np.zeros(k)
            some[np.argsort(-full, kind="stable")[:size]] = 1 / size
            for _ in range(language.ROUNDS):
                joint = model.probabilities[cells] * some
                some = (joint / joint.sum(axis=1, keepdims=True) * counts[:, None]).sum(axis=0) / n
            candidates.append(some)
        best = max(candidates, key=lambda c: likelihood_by_hand(model, cells, counts, c) - price * np.count_nonzero(c))
        assert np.allclose(best, share, atol=1e-9)
    assert np.count_nonzero(shares[1] > 0.2) == 2 and shares[0].max() == 1


def test_too_many_languages_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    with pytest.raises(Exception, match="more than 2 languages"):
        language.fit_languages(edge_cases.frame(spark))


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = op2_pairwise_quality(spark, SF_DIR).join(labels, "doc_id").filter("held_out").collect()
    assert len(found) > 50 and np.mean([r.predicted == r.quality for r in found]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_held_out_labels_are_never_learned(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    docs = documents(spark, SF_DIR)
    a, b = (dict(quality.score_quality(docs, x).select("doc_id", "score").collect()) for x in (labels, turned))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_rare_labels_are_learned_from_all_rows(spark):
    rng = np.random.default_rng(5)
    labels = np.array([0] * 12 + [1] * 3988)
    features = rng.normal(0, 1, (4000, quality.WIDTH)).astype(np.float32)
    features[:, 0] += np.where(labels == 1, 2, -2)
    rows = [(i, f.tolist(), int(k)) for i, (f, k) in enumerate(zip(features, labels, strict=True))]
    ranker = quality.fit_ranker(spark.createDataFrame(rows, "doc_id long, features array<float>, label int"), sample_rows=100, pairs=500)
    assert ranker.weights[0] > 0.1
    assert np.allclose(ranker.centre, features.mean(axis=0), atol=1e-5) and np.allclose(ranker.spread, features.std(axis=0), atol=1e-4)
    margins = ((features - ranker.centre) / ranker.spread) @ ranker.weights
    assert np.isclose(ranker.threshold, np.quantile(margins, 12 / 4000), atol=1e-6)


def test_quality_edge_cases(spark):
    docs = edge_cases.frame(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 20)] + [(3, 0, 0), (None, 1, 0), (5, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_quality(docs, labels).collect()
    assert len(found) == len(edge_cases.rows()) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out for r in found if r.doc_id is None)
    for some in (labels.limit(0), labels.filter("quality = 1")):
        assert {r.score for r in quality.score_quality(docs, some).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_held_out_is_a_crc(spark):
    import zlib

    found = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in found)


def test_features_of_hard_texts():
    for _, text, *_ in edge_cases.rows():
        assert np.isfinite(quality.text_features(text)).all()
    assert not quality.text_features(None).any() and not quality.text_features("").any()


def test_ranker_against_a_plain_fit(spark):
    """Weights and threshold against Newton's method on the same pairs."""
    rng = np.random.default_rng(11)
    features = rng.normal(0, 2, (90, quality.WIDTH)).astype(np.float32)
    labels = (features[:, 0] + 0.5 * features[:, 1] + rng.normal(0, 1, 90) > -0.5).astype(int)
    rows = [(k, features[k].tolist(), int(labels[k])) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, features array<float>, label int").repartition(3)
    pairs = 400
    ranker = quality.fit_ranker(df, pairs=pairs)
    order = [r.doc_id for r in df.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).alias("h")).orderBy("h", "doc_id").collect()]
    good, bad = ([d for d in order if labels[d] == k] for k in (1, 0))
    picks = spark.range(pairs).select("id", F.pmod(F.xxhash64("id"), F.lit(len(bad))).alias("b")).collect()
    x = features.astype(float)
    x = (x - x.mean(0)) / x.std(0)
    difference = np.array([x[good[p.id % len(good)]] - x[bad[p.b]] for p in picks])  # the one preferred first
    weights = np.zeros(quality.WIDTH)
    for _ in range(30):
        p = 1 / (1 + np.exp(difference @ weights))
        slope = -(difference * p[:, None]).mean(0) + quality.REGULARISATION * weights
        curve = (difference.T * (p * (1 - p))) @ difference / pairs + quality.REGULARISATION * np.eye(quality.WIDTH)
        weights -= np.linalg.solve(curve, slope)
    margins = x @ weights
    mine = x @ ranker.weights
    assert np.corrcoef(margins, mine)[0, 1] > 0.9999
    assert np.allclose(ranker.weights, weights, atol=0.02 * np.abs(weights).max())
    assert abs(ranker.threshold - np.quantile(mine, (labels == 0).mean())) < 1e-6
