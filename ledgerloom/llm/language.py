"""Language identification as a mixture of languages.

Training counts letter trigrams per language over all labelled rows. For a document,
expectation-maximisation estimates the share of every language from the likelihoods of its
trigrams. Languages are then left out, smallest share first, and the set with the best penalised
likelihood stays. The largest share names the language.

The model has one row of 65,536 hashed trigram cells per language, whatever the size of the corpus;
MAX_LANGUAGES bounds it, and more label values than that raise an error.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import ids_and_texts, texts_of

CELLS = 1 << 16
SLICES = 64
MAX_LANGUAGES = 256
ROUNDS = 8
#: Log-likelihood that one more language must add: this for each log of the document's trigrams.
PENALTY = 4.0
UNDETERMINED = "und"

_CHUNK = 1 << 19  # characters handled at once
#: Numbers in a table of (cell, language) that the mixtures of several documents share; one document may need more.
_TABLE = 1 << 17


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    probabilities: np.ndarray  # (cells, languages)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _trigram_cells(text: str) -> tuple[np.ndarray, bool]:
    """The cells of the trigrams of a piece of text, and whether it has a letter; runs of other characters are one space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), False
    codes = np.where(letter, codes, 32)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]  # the first of each run of other characters
    codes = codes[keep].astype(np.uint32)
    if len(codes) < 3:
        return np.empty(0, np.int64), True
    mixed = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA77)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return ((mixed >> np.uint32(16)) & np.uint32(CELLS - 1)).astype(np.int64), True


def _pieces(text: str) -> Iterator[str]:
    """Whole text in pieces that overlap by two characters, so that every trigram is seen."""
    yield text[:_CHUNK]
    for start in range(_CHUNK, len(text), _CHUNK):
        yield text[start - 2 : start + _CHUNK]


def _cell_counts(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(cells, counts, has a letter) of a whole text; memory is bounded by the number of cells."""
    if len(text) <= _CHUNK:
        cells, lettered = _trigram_cells(text)
        found, counts = np.unique(cells, return_counts=True)
        return found, counts, lettered
    total, lettered = np.zeros(CELLS, np.int64), False
    for piece in _pieces(text):
        cells, some = _trigram_cells(piece)
        total += np.bincount(cells, minlength=CELLS)
        lettered |= some
    found = np.flatnonzero(total)
    return found, total[found], lettered


def _count_by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of this task, a row per language and slice of cells."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(1).to_pylist(), texts_of(batch), strict=True):
            if len(totals) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
            total = totals.setdefault(lang, np.zeros(CELLS, np.int64))
            for piece in _pieces(text or ""):
                total += np.bincount(_trigram_cells(piece)[0], minlength=CELLS)
    width = CELLS // SLICES
    for lang, total in sorted(totals.items()):
        yield pa.record_batch({
            "lang": pa.array([lang] * SLICES), "slice": pa.array(range(SLICES), pa.int32()),
            "counts": pa.array([total[k * width : (k + 1) * width].tobytes() for k in range(SLICES)], pa.binary()),
        })


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
    return pd.DataFrame({"lang": pdf["lang"][:1], "slice": pdf["slice"][:1], "counts": [total.tobytes()]})


def fit_languages(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Trigram probabilities per language from all rows whose label is not null.

    What comes to the driver is the finished model: 64 slices of counts per language.
    """
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    counted = rows.filter("lang is not null").mapInArrow(_count_by_language, "lang string, slice int, counts binary")
    slices = counted.groupBy("lang", "slice").applyInPandas(_add, "lang string, slice int, counts binary").collect()
    languages = sorted({r["lang"] for r in slices})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    counts, width = np.zeros((CELLS, len(languages))), CELLS // SLICES
    for r in slices:
        counts[r["slice"] * width : (r["slice"] + 1) * width, languages.index(r["lang"])] = np.frombuffer(r["counts"], np.int64)
    smooth = counts + 0.1
    return LanguageModel(tuple(languages), smooth / smooth.sum(axis=0, keepdims=True))


def _mixture(likelihood: np.ndarray, counts: np.ndarray, doc: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x languages) of the active languages after ROUNDS of EM, and log-likelihoods.

    `likelihood` has a row per (document, cell); `doc` names the document and ascends.
    """
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    total = np.add.reduceat(counts, first)[:, None]
    share = active / active.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        joint = likelihood * share[doc]
        joint *= (counts / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, first) / total
    return share, np.add.reduceat(counts * np.log((likelihood * share[doc]).sum(axis=1)), first)


def mixtures(model: LanguageModel, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Shares of all languages for each document given as (cells, counts); no cells: equal shares.

    The candidates are the best single language, all languages, and the sets between them that
    leave out the smallest shares. A set between can only win if all languages together, at the price
    of two, would beat the single one; the others skip those rounds.
    """
    n, languages = len(docs), len(model.languages)
    result = np.full((n, languages), 1.0 / languages)
    filled = [i for i, (cells, _) in enumerate(docs) if len(cells)]
    if not filled:
        return result
    doc = np.repeat(np.arange(len(filled)), [len(docs[i][0]) for i in filled])
    counts = np.concatenate([docs[i][1] for i in filled]).astype(float)
    likelihood = model.probabilities[np.concatenate([docs[i][0] for i in filled])]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    price = PENALTY * np.log(np.add.reduceat(counts, first) + 1)
    single = np.add.reduceat(np.log(likelihood) * counts[:, None], first)
    best = np.eye(languages)[np.argmax(single, axis=1)]
    best_value = single.max(axis=1) - price
    share, fit = _mixture(likelihood, counts, doc, np.ones((len(filled), languages)))
    open_docs = np.flatnonzero(fit - 2 * price > best_value)
    if len(open_docs):
        rows = np.flatnonzero(np.isin(doc, open_docs))
        renamed = np.searchsorted(open_docs, doc[rows])
        order = np.argsort(-share[open_docs], axis=1, kind="stable")
        for size in range(2, languages + 1):
            active = np.zeros((len(open_docs), languages))
            np.put_along_axis(active, order[:, :size], 1.0, axis=1)
            some, some_fit = _mixture(likelihood[rows], counts[rows], renamed, active)
            value = some_fit - price[open_docs] * size
            better = value > best_value[open_docs]
            best[open_docs[better]], best_value[open_docs[better]] = some[better], value[better]
    result[filled] = best
    return result


def _name(model: LanguageModel, texts: Iterator[str | None]) -> Iterator[tuple[str, float]]:
    held: list[tuple] = []
    size = 0
    for text in texts:
        held.append(_cell_counts(text or ""))
        size += len(held[-1][0])
        if size * len(model.languages) > _TABLE:
            yield from _named(model, held)
            held, size = [], 0
    yield from _named(model, held)


def _named(model: LanguageModel, held: list[tuple]) -> Iterator[tuple[str, float]]:
    if not held:
        return
    shares = mixtures(model, [(cells, counts) for cells, counts, _ in held]) if model.languages else None
    for i, (_, _, lettered) in enumerate(held):
        if not lettered or shares is None:
            yield UNDETERMINED, 0.0
        else:
            top = int(np.argmax(shares[i]))
            yield model.languages[top], float(min(1.0, shares[i, top]))


def _predicted(docs: DataFrame, model: LanguageModel, text_col: str) -> DataFrame:
    """_row (all columns of a row), lang_pred, score. A text travels to Python once, unless it is no string there."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col) if docs.schema[text_col].dataType == T.StringType() else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0)
            texts = batch if place is None else pa.record_batch([whole.field(place)], names=["_text"])
            found = list(_name(shared.value, texts_of(texts, "_text")))
            yield pa.record_batch(
                [whole, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["_row", "lang_pred", "score"],
            )

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, *[F.col(f"`{text_col}`").cast("string").alias("_text")] * (place is None))
    schema = T.StructType([rows.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predict, schema)


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (the largest share).

    Defined results: `und` with score 0 for a null text or one without a letter, or if nothing was
    learned; a text with letters but no trigram gets the first language at its equal share; equal
    shares go to the alphabetically first language; an empty table gives no rows; other columns are
    ignored.
    """
    return _predicted(ids_and_texts(docs, id_col, text_col), model, "text").select(F.col("_row.doc_id").alias("doc_id"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, that have a language with a share of `min_share` or more."""
    kept = _predicted(docs, model, text_col).filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_share))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
