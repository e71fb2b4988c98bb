"""Operator 7, quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards its diagonal and a multiple of the identity; a document's score is
the logistic function of the difference of the two log densities (half Mahalanobis distances and log determinants, from
Cholesky factors computed once) plus the log prior odds.

Means and covariances are fitted on a bounded sample of labelled rows: at most `sample` rows of each class, those of least
hash of the id. The prior odds are those of all labelled ids that are not held out, however many there are.
Null and empty texts count as texts without a character; they get the score of those statistics. Repeated rows are scored
alike. With a class unseen, every score is the share of label 1 (0.5 without any labels). Null ids are scored but never
sampled. Other columns of the input are kept where a filter is asked for, and are never inputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinward.llm.common import bounded_batches, keep, raw

FEATURES = ("word_length", "upper", "digits", "marks", "other_marks", "stops", "commonest_word", "capital_words", "marked_ends", "high_bytes", "word_spread", "short_words")

#: Every share is taken after so many words, and their characters, of the proportions below: few words say little.
PRIOR_WORDS = 40.0
#: Fixed proportions of ordinary prose: a word or a character of ten is of the kind, and so on.
PRIOR = {"length": 5.0, "upper": 0.03, "digits": 0.003, "marks": 0.03, "other_marks": 0.001, "stops": 0.08, "commonest": 0.06, "capitals": 0.01, "ends": 0.002, "high": 0.05, "spread": 3.0, "short": 0.35}

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sentence marks, 5 other marks, 6 space, 7 high byte
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 5
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[[32, 9, 10, 11, 12, 13]] = 6
_CLASS[128:] = 7
_ENDS = frozenset(b"!#$%&*+=<>@^_`{|}~/\\")


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of one text: shares by square root, drawn towards those of ordinary prose in short texts."""
    by = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=8)
    words = text.split()
    k, n = len(words), len(text)
    sizes = np.fromiter(map(len, words), np.int64, k)
    chars = PRIOR_WORDS * (PRIOR["length"] + 1)

    def of_words(count: float, prior: str) -> float:
        return (count + PRIOR_WORDS * PRIOR[prior]) / (k + PRIOR_WORDS)

    def of_chars(count: float, prior: str) -> float:
        return float(np.sqrt((count + chars * PRIOR[prior]) / (n + chars)))

    return [
        of_words(int(sizes.sum()), "length"),
        of_chars(by[2], "upper"),
        of_chars(by[3], "digits"),
        of_chars(by[4], "marks"),
        of_chars(by[5], "other_marks"),
        np.sqrt(of_words(sum(w[-1:] == b"." for w in words), "stops")),
        np.sqrt(of_words(max(Counter(words).values(), default=0), "commonest")),
        np.sqrt(of_words(sum(w.isupper() and len(w) > 1 for w in words), "capitals")),
        np.sqrt(of_words(sum(w[-1] in _ENDS for w in words), "ends")),
        of_chars(by[7], "high"),
        of_words(k * float(sizes.std()) if k else 0.0, "spread"),
        np.sqrt(of_words(int((sizes <= 3).sum()), "short")),
    ]


def features(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes; None where a class was not seen."""

    mean: np.ndarray | None
    whiten: np.ndarray | None
    log_det: np.ndarray | None
    log_odds: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, labelled: tuple[int, int], shrink: float = 0.1, ridge: float = 1e-3) -> Discriminant:
        """From a sample of each class; `labelled` has the numbers of all labels 0 and 1, which give the prior odds."""
        ones = int((y == 1).sum())
        odds = float(np.log((labelled[1] + 1) / (labelled[0] + 1)))
        if ones == 0 or ones == len(y):
            return cls(None, None, None, odds)
        scale = x.std(0) + 1e-6
        mean, whiten, log_det = [], [], []
        for k in (0, 1):
            own = x[y == k]
            centre = own - own.mean(0)
            cov = centre.T @ centre / max(1, len(own) - 1)
            cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.diag(scale**2)
            factor = np.linalg.cholesky(cov)
            mean.append(own.mean(0))
            whiten.append(np.linalg.inv(factor))
            log_det.append(2 * np.log(np.diag(factor)).sum())
        return cls(np.array(mean), np.array(whiten), np.array(log_det), odds)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.log_odds)
        if self.mean is not None:
            density = [-0.5 * ((((x - self.mean[k]) @ self.whiten[k].T) ** 2).sum(1) + self.log_det[k]) for k in (0, 1)]
            z = z + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(id_col: str = "doc_id"):
    """Rows never learnt from: crc32 of the id as text leaves 1 on division by 3 (null ids: not held out)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4000) -> Discriminant:
    """Fits on at most `sample` labelled rows of each class that are not held out, with the prior odds of all of them."""
    bounded_batches(docs.sparkSession)
    known = keep(labels, id_col, label_col).where(~held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    labelled = {r["_label"]: r["n"] for r in known.where("_label IN (0, 1)").groupBy("_label").agg(F.countDistinct("_id").alias("n")).collect()}
    chosen = [known.where(F.col("_label") == k).orderBy(F.xxhash64("_id"), "_id").limit(sample) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).dropDuplicates(["_id"])
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(ids), "_id").select("_label", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(raw(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(run, "y int, x array<double>").toArrow()  # 2 * sample rows of a few numbers, unless ids repeat
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column("y").to_pylist(), int)
    order = np.lexsort((*x.T, y))
    return Discriminant.fit(x[order], y[order], (labelled.get(0, 0), labelled.get(1, 0)))


def score_quality(docs: DataFrame, model: Discriminant, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each row of docs."""
    bounded_batches(docs.sparkSession)
    docs = keep(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(features(raw(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=[id_col, "score", "predicted"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.dtypes[0][1]}, score double, predicted int")


def keep_good(docs: DataFrame, model: Discriminant, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model accepts."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(features(raw(batch.column(at)))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
