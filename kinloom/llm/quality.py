"""Quality scores: kernel ridge regression on document statistics with random Fourier features.

1. Each text becomes a row of statistics (``STATISTICS``).
2. Standardised with the training rows' mean and spread, they go through random
   cosines, whose inner products approximate a Gaussian kernel.
3. Each partition adds up its part of the normal equations, for each of
   ``FOLDS`` folds; the sums solve the ridge regression.
4. Scores of training rows by the model that has not seen their fold, counted
   on a fixed grid, give the isotonic calibration (pool adjacent violators).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import fold, fresh, with_fields
from kinloom.operators.lineage import cut

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "end_marks", "exclaims", "bars", "signs",
    "other_punctuation", "spaces", "distinct_words", "top_word", "distinct_lines", "line_words", "ended_lines", "letters",
    "entropy", "long_words", "short_words", "punctuated_words", "all_upper_words",
)
FEATURES = 256
FOLDS = 4
GRID = 2048
SEED = 20


def _class(chars: str) -> np.ndarray:
    mask = np.zeros(256)
    mask[[ord(c) for c in chars]] = 1
    return mask


UPPER, DIGITS, SPACES = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(" \t\n\r\f\v")
SIGNS, OTHER = _class("#$%&*@^_~<>=+{}[]\\/"), _class("\"'():;-`")
LETTERS = UPPER + _class("abcdefghijklmnopqrstuvwxyz") + np.r_[np.zeros(128), np.ones(128)]
END_MARK = re.compile(rb"[.!?:;\"')]$")


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; null counts as empty, and an empty text has a row of zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(STATISTICS) - 1)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, w = len(raw), len(words)
    size = np.fromiter(map(len, words), dtype=np.float64, count=w)
    share = hist[hist > 0] / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    return [
        np.log1p(n), np.log1p(w), min(size.mean(), 100.0), min(size.std(), 100.0), hist @ UPPER / n, hist @ DIGITS / n,
        (hist[46] + hist[44] + hist[63]) / n, hist[33] / w, hist[124] / w, hist @ SIGNS / w, hist @ OTHER / n, hist @ SPACES / n,
        len(counts) / w, max(counts.values()) / w, len(set(lines)) / len(lines), np.log1p(w / len(lines)),
        sum(1 for x in lines if END_MARK.search(x.rstrip())) / len(lines), hist @ LETTERS / n, -(share * np.log2(share)).sum(),
        (size > 15).mean(), (size <= 2).mean(), sum(1 for x in words if x[-1:] in b"#$%&*!|+=~") / w,
        sum(1 for x in words if len(x) > 1 and x.isupper()) / w,
    ]


def with_statistics(docs: DataFrame, text: str, into: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: np.array(statistics(t), dtype=np.float64))

    return docs.withColumn(into, measure(F.col(text)))


@dataclass
class Model:
    """Bounded by FEATURES, the number of statistics and GRID, whatever the input."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    borders: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated scores at the borders
    features: int = FEATURES

    def cosines(self, rows: np.ndarray) -> np.ndarray:
        return cosines((rows - self.mean) / self.spread, self.features)

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.cosines(rows) @ self.weights, self.borders, self.levels), 0, 1)


def cosines(rows: np.ndarray, features: int) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    rng = np.random.default_rng(SEED)
    scale = np.sqrt(rows.shape[1])
    w, b = rng.normal(size=(rows.shape[1], features)) / scale, rng.uniform(0, 2 * np.pi, features)
    return np.c_[np.sqrt(2 / features) * np.cos(np.clip(rows, -8, 8) @ w + b), np.ones(len(rows))]


def _rows(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), len(STATISTICS))


def pool(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic means of consecutive groups."""
    blocks: list[list[float]] = []
    for s, n in zip(sums, counts, strict=True):
        blocks.append([s, n, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, s / n) for s, n, k in blocks]) if blocks else np.zeros(0)


def fit(train: DataFrame, stats: str, label: str, part: str, ridge: float = 1e-4, features: int = FEATURES) -> Model | None:
    """Model of ``label`` (0 or 1) from rows with statistics; ``part`` numbers the folds from 0. None without rows.

    ``train`` is read three times and should be a written table.
    """
    k = len(STATISTICS)
    moments = train.select(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col(stats)[i]) for i in range(k)]).alias("s"),
        F.array(*[F.sum(F.col(stats)[i] * F.col(stats)[i]) for i in range(k)]).alias("q"),
    ).first()
    if not moments["n"]:
        return None
    mean = np.array(moments["s"]) / moments["n"]
    spread = np.sqrt(np.maximum(np.array(moments["q"]) / moments["n"] - mean**2, 0))
    spread[spread < 1e-9] = 1.0
    width = features + 1
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, hits = np.zeros((FOLDS, width, width)), np.zeros((FOLDS, width + 1))
        for batch in batches:
            x = cosines((_rows(batch.column(0)) - mean) / spread, features)
            y, f = np.array(batch.column(1).to_pylist(), dtype=float), np.array(batch.column(2).to_pylist())
            for i in range(FOLDS):
                gram[i] += x[f == i].T @ x[f == i]
                hits[i] += np.r_[x[f == i].T @ y[f == i], (f == i).sum()]
        for i in range(FOLDS):
            if hits[i, -1]:
                cells = np.r_[gram[i][upper], hits[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cells), i), pa.int32()), pa.array(np.arange(len(cells)), pa.int32()), pa.array(cells)],
                    names=["fold", "cell", "value"])

    rows = train.select(stats, F.col(label).cast("double"), F.col(part).cast("int"))
    cells = rows.mapInArrow(partial, "fold int, cell int, value double").groupBy("fold", "cell").agg(F.sum("value").alias("value"))
    packed = cells.groupBy("fold").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell", "value"))), lambda x: x["value"]).alias("v"))
    parts = {r["fold"]: np.array(r["v"]) for r in packed.collect()}  # FOLDS rows of a fixed length
    total = sum(parts.values())

    def solve(cells: np.ndarray) -> np.ndarray:
        gram = np.zeros((width, width))
        gram[upper] = cells[:len(upper[0])]
        gram = gram + np.triu(gram, 1).T
        n = max(cells[-1], 1.0)
        pull = np.full(width, ridge)
        pull[-1] = 1e-9
        return np.linalg.solve(gram / n + np.diag(pull), cells[len(upper[0]):-1] / n)

    weights = solve(total)
    apart = {i: solve(total - cells) if total[-1] > cells[-1] else weights for i, cells in parts.items()}

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, f = cosines((_rows(batch.column(0)) - mean) / spread, features), batch.column(2).to_pylist()
            raw = np.array([x[i] @ apart[f[i]] for i in range(len(f))])
            grid = np.floor((np.clip(raw, -1, 2) + 1) / 3 * GRID).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(grid), batch.column(1)], names=["grid", "label"])

    steps = (rows.mapInArrow(graded, "grid long, label double").groupBy("grid")
             .agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("n")).orderBy("grid").collect())  # at most GRID + 1 rows
    borders = (np.array([s["grid"] for s in steps]) + 0.5) / GRID * 3 - 1
    levels = pool(np.array([s["hits"] for s in steps]), np.array([float(s["n"]) for s in steps]))
    return Model(mean, spread, weights, borders, levels, features)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
                  held: int = 5) -> DataFrame:
    """``docs`` without the text, plus held_out, score and predicted (score at least 0.3).

    Labels are learned from rows whose crc32(id) mod ``held`` is not 0; only
    labels 0 and 1 count, a document with several labels counts once for each.
    Null and empty texts are scored from their statistics like any other; a
    null id is not held out and never joins a label. Without any label every
    score is 0. Rows stay as they are; columns named like the new ones give way.
    """
    stats, part, key = fresh(docs, "__stats", "__fold", "__key")
    measured, _ = cut(with_statistics(docs, text, stats).drop(text))
    taught = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias(key), F.col(label).alias("__label"))
    known = measured.select(doc_id, stats).where(fold(F.col(doc_id), held) != 0)
    train, _ = cut(
        known.join(taught, F.col(doc_id) == F.col(key))
        .select(stats, "__label", F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).alias(part)))
    model = fit(train, stats, "__label", part)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = np.array(batch.tolist(), dtype=np.float64).reshape(len(batch), len(STATISTICS))
            yield pd.Series(model.score(rows) if model else np.zeros(len(batch)))

    (got,) = fresh(measured, "__score")
    out = measured.withColumn(got, score(F.col(stats)))
    found = F.struct(
        F.coalesce(fold(F.col(doc_id), held) == 0, F.lit(False)).alias("held_out"), F.col(got).alias("score"),
        F.when(F.col(got) >= 0.3, 1).otherwise(0).alias("predicted"))
    return with_fields(out, found, {"held_out": "boolean", "score": "double", "predicted": "int"}).drop(got, stats)
