"""Quality scores from Bradley-Terry pairwise ranking.

A labelled good document is preferred to a labelled bad one. The probability of a preference is the
logistic function of the difference of two document scores, and a score is linear in the features
of the text, so fitting is a logistic regression without intercept on feature differences. The
threshold is the quantile of the training scores above which lies the share of good documents; the
reported score is the logistic function of the distance to it.

Pairs are PAIRS of at most SAMPLE_ROWS documents of each label, chosen by a hash of their id. Centre and spread of
the features, the share of bad documents and the threshold come from all labelled documents. Scoring covers all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import held_out, ids_and_texts, texts_of
from ledgerloom.plans.order_stats import exact_quantiles
from ledgerloom.plans.shared import Stored

SAMPLE_ROWS = 20_000
PAIRS = 20_000
REGULARISATION = 1e-4

_SHAPES = 64
_SCALARS = 22
WIDTH = 2 * _SCALARS + _SHAPES
_PIECE = 1 << 18
_ROW = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float32()))])
_RUNS = re.compile(r"(.)\1{2,}", re.DOTALL)
#: Classes of the characters in shape features: letters, digits and spaces share one, marks have their own.
_CLASS = np.arange(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")


def text_features(text: str | None) -> np.ndarray:
    """WIDTH numbers of a whole text: shares of characters, words and lines, their logarithms where
    sizes differ widely, and hashed pairs of character classes. Empty texts have zeros."""
    values = np.zeros(WIDTH, np.float32)
    if not text:
        return values
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    kinds, pairs = np.zeros(256, np.int64), np.zeros(_SHAPES, np.int64)
    for start in range(0, n, _PIECE):
        part = _CLASS[data[start : start + _PIECE + 1]]
        kinds += np.bincount(part[:_PIECE], minlength=256)
        if len(part) > 1:
            pairs += np.bincount((part[:-1] * 31 + part[1:] * 17) % _SHAPES, minlength=_SHAPES)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    counts, line_counts = Counter(words), Counter(lines)
    many = max(len(words), 1)
    sizes = [len(w) for w in words]
    steps = Counter(zip(words, words[1:], strict=False))
    plain = kinds[ord("a")] + kinds[ord("A")] + kinds[ord(" ")] + kinds[ord("\n")]
    marks = sum(kinds[ord(c)] for c in "#$%&*|!<>{}[]=+~^_@\\")
    scalars = [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), np.mean(sizes) if sizes else 0, np.std(sizes) if sizes else 0,
        kinds[ord("a")] / n, kinds[ord("A")] / n, kinds[ord("0")] / n, kinds[ord(" ")] / n, kinds[ord("\n")] / n,
        1 - plain / n, marks / n, kinds[ord(".")] / many, kinds[ord(",")] / many, kinds[ord("!")] / many, kinds[ord("|")] / many,
        len(counts) / many, max(counts.values(), default=0) / many, len(steps) / max(len(words) - 1, 1), max(steps.values(), default=0) / many,
        1 - len(line_counts) / max(len(lines), 1), sum(len(m[0]) for m in _RUNS.finditer(text)) / n,
    ]
    values[:_SCALARS] = scalars
    values[_SCALARS : 2 * _SCALARS] = np.sqrt(np.abs(scalars))
    values[2 * _SCALARS :] = np.sqrt(pairs / max(pairs.sum(), 1))
    return values


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(t) for t in texts_of(batch)]
        flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.float32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * WIDTH), flat)
        yield pa.record_batch([batch.column(0), lists], schema=_ROW)


@dataclass(frozen=True)
class PairwiseRanker:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def margins(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.centre) / self.spread) @ self.weights - self.threshold

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(features), -500, 500)))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def fit_ranker(
    labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, pairs: int = PAIRS, regularisation: float = REGULARISATION
) -> PairwiseRanker:
    """A ranker from doc_id, features (arrays of WIDTH) and label (0 or 1).

    If one of the labels is absent there is no preference to learn from: all weights are zero and
    every score is 0.5.
    """
    stored = Stored(labelled, "labelled")
    rows = stored.frame
    totals = dict(rows.groupBy("label").count().collect())
    if not totals.get(0) or not totals.get(1):
        stored.drop()
        return PairwiseRanker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    stats = rows.select(Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("features")).alias("s")).first()["s"]
    centre = stats["mean"].toArray()
    spread = np.sqrt(stats["variance"].toArray() * (stats["count"] - 1) / stats["count"])
    spread[spread <= 1e-9] = 1.0
    spread_out = F.xxhash64(F.col("doc_id").cast("string"), F.lit(7))
    # The hash is even over 2**32, so this leaves about sample_rows of a label; only they are put in order.
    chosen = [
        (F.col("label") == k) & (F.pmod(spread_out, F.lit(1 << 32)) < int(min(1.0, sample_rows / totals[k]) * (1 << 32))) for k in (0, 1)
    ]
    scaled = F.transform("features", lambda v, k: (v - F.element_at(F.lit(centre.tolist()), k + 1)) / F.element_at(F.lit(spread.tolist()), k + 1))
    place = F.row_number().over(Window.partitionBy("label").orderBy(spread_out, "doc_id"))
    sample = Stored(
        rows.filter(chosen[0] | chosen[1]).withColumn("place", place).filter(F.col("place") <= sample_rows)
        .select((F.col("place") - 1).alias("n"), "label", scaled.alias("x")),
        "labelled-sample",
    )
    numbered = sample.frame
    good, bad = (numbered.filter(F.col("label") == k).count() for k in (1, 0))
    drawn = labelled.sparkSession.range(pairs).select(
        F.col("id").alias("pair"), (F.col("id") % good).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(bad)).cast("int").alias("b"),
    )
    first, second = numbered.filter("label = 1").alias("p"), numbered.filter("label = 0").alias("q")
    both = drawn.join(first, F.col("g") == F.col("p.n")).join(second, F.col("b") == F.col("q.n"))
    turned = F.col("pair") % 2 == 1  # every other pair the other way round, so that both outcomes occur
    difference = F.zip_with("p.x", "q.x", lambda a, b: F.when(turned, b - a).otherwise(a - b))
    preferred = both.select(array_to_vector(difference).alias("features"), F.when(turned, 0.0).otherwise(1.0).alias("label"))
    train = Stored(preferred, "preference-pairs")
    model = LogisticRegression(fitIntercept=False, standardization=False, regParam=regularisation, maxIter=60).fit(train.frame)
    train.drop()
    weights = model.coefficients.toArray()
    sample.drop()
    ranker = PairwiseRanker(centre, spread, weights, 0.0)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(ranker.margins(_matrix(batch)))], names=["margin"])

    share_bad = totals[0] / (totals[0] + totals[1])
    with Stored(rows.select("doc_id", "features").mapInArrow(margins, "margin double"), "margins") as scored:
        threshold = exact_quantiles(scored, {"margin": [share_bad]})["margin", share_bad]
    stored.drop()
    return replace(ranker, threshold=float(threshold))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns from labelled rows that are not held out (crc32 of the id as text, mod 3, is not 1).
    Defined results: null texts are empty ones and are scored like any text; null ids are held out;
    null labels are left out, and several labels of one id count by their rounded mean; without both
    labels every score is 0.5; an empty table gives no rows; other columns are ignored.
    """
    features = Stored(ids_and_texts(docs, id_col, text_col).mapInArrow(_extract, "doc_id bigint, features array<float>"), "features").frame
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
    agreed = marked.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    labelled = features.filter(~held_out(F.col("doc_id"))).join(agreed, "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(fit_ranker(labelled))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(shared.value.scores(_matrix(batch)))], names=["doc_id", "score"])

    scored = features.mapInArrow(score, "doc_id bigint, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
