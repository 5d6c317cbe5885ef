"""Quality scores by regularised quadratic discriminant analysis over document statistics.

Each text becomes a vector of statistics (counts by kind of character, word and line figures), transformed to be close
to normal. Per class the count, mean and covariance follow from sums that are added up in a distributed aggregate, so
all labelled rows take part. Covariances shrink towards the pooled covariance and get a share of its diagonal; their Cholesky factors are computed once on the driver (a few KB) and the score of a row is the logistic of the
difference of the two log densities plus the log prior odds.

Defined cases: a null text counts as empty; an empty text has the statistics of no words and gets a score like any
other; null doc_id is never a training row; several labels of one document each count; labels other than 0 and 1 are
ignored; where all training rows are of one class every score is that class (0 or 1), and without training rows 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches, stored

THRESHOLD = 0.7
NAMES = ("words", "word_chars", "upper", "digits", "stops", "commas", "pipes", "marks", "loud", "lines", "distinct", "top_word", "repeated_lines", "capital_words", "short_words", "other")
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".", "commas": b",;:", "pipes": b"|<>{}[]\\/=_", "marks": b"#$%&*@^~+", "loud": b"!?", "lines": b"\n"}
_TABLE = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars), _k] = 1
_CAPITAL = re.compile(rb"\b[A-Z]{2,}\b")


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), len(raw)
    by_class = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TABLE
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    per_word = np.log1p(10.0 * (by_class + 0.2) / (n + 4))
    return np.array([
        np.log1p(n), np.log((size + 20.0) / (n + 4.0)), *per_word[:8],
        np.log((len(counts) + 1.0) / (n + 1.0) ** 0.8),
        np.sqrt((max(counts.values(), default=0) + 1) / (n + 12)),
        np.sqrt((len(lines) - len(set(lines)) + 0.5) / (len(lines) + 6)),
        np.sqrt((len(_CAPITAL.findall(raw)) + 0.2) / (n + 4)),
        np.sqrt((sum(c for w, c in counts.items() if len(w) <= 3) + 2) / (n + 5)),
        np.sqrt(np.count_nonzero(np.frombuffer(raw, np.uint8) >= 128) / max(size, 1)),
    ])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t).tolist() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_features), "doc_id long, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log constants of the two classes; index 1 is good."""

    means: np.ndarray
    inverse_factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverse_factors[c].T
            logs.append(self.constants[c] - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


@dataclass(frozen=True)
class Constant:
    """What is left to say where there are no two classes."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fit(rows: DataFrame, shrink: float = 0.2, ridge: float = 0.02) -> Discriminant | Constant:
    """From rows (label, x): all of them, through one distributed sum."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + len(pairs)))
        a, b = np.array(pairs).T
        for batch in batches:
            if batch.num_rows:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                for c in (0, 1):
                    own = x[y == c]
                    sums[c] += np.concatenate([[len(own)], own.sum(0), (own[:, a] * own[:, b]).sum(0)])
        c, k = np.nonzero(sums)
        yield pa.record_batch([pa.array(c, pa.int32()), pa.array(k, pa.int32()), pa.array(sums[c, k])], names=["c", "k", "v"])

    total = rows.select(F.col("label").cast("int"), "x").mapInArrow(lean(moments), "c int, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, 1 + d + len(pairs)))
    for r in total:
        sums[r["c"], r["k"]] = r["v"]
    n = sums[:, 0]
    if (n == 0).any():
        return Constant(0.0 if n[0] else 1.0)
    means = sums[:, 1 : d + 1] / n[:, None]
    own = np.zeros((2, d, d))
    for k, (i, j) in enumerate(pairs):
        own[:, i, j] = own[:, j, i] = sums[:, 1 + d + k]
    own = own / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.tensordot(n, own, 1) / n.sum()
    scale = np.maximum(np.diag(pooled), 1e-6)
    factors, constants = [], []
    for c in (0, 1):
        covariance = (1 - shrink) * own[c] + shrink * pooled + ridge * np.diag(scale)
        factor = np.linalg.cholesky(covariance)
        factors.append(np.linalg.inv(factor))
        constants.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(factors), np.array(constants))


def scored(table: DataFrame, model: Discriminant | Constant) -> DataFrame:
    """(doc_id, score) of a table of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.record_batch([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(lean(run), "doc_id long, score double")


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def trained(table: DataFrame, labels: DataFrame) -> Discriminant | Constant:
    """From a table of features and the labels of rows that are not held out."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    return fit(table.where(~held_out()).join(marks, "doc_id"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold: scored where they are, without a join. Null and
    empty texts are scored as texts without words; repeated rows stay or go together."""
    small_batches(docs.sparkSession)
    model, at = trained(features(docs), labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([statistics(t) for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    table = stored(features(docs), "features")
    out = scored(table, trained(table, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
