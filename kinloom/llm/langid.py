"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. Three
letters in a row are bound to one vector: the first rotated twice, the second
once, multiplied cell by cell. A text's profile is the bundle (sum) of its
trigram vectors, a language's prototype the bundle of all its training texts.
A document gets the language whose prototype has the highest cosine.

What all languages share is taken out of the prototypes before they are
compared: their mean direction is subtracted. Words are runs of letters in
lower case; all else is one space.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import fresh, with_fields

CELLS = 1024
UNKNOWN = "und"
DOCS = 256  # documents profiled at a time
GRAMS = 4096  # trigram vectors held at a time


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: is it a letter or a mark on one."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=20_000)
def letter_vector(point: int, cells: int) -> np.ndarray:
    return (np.random.default_rng(point).integers(0, 2, cells) * 2 - 1).astype(np.int8)


def trigrams(texts: list[str | None], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of the texts: (distinct ones as code points, index of each occurrence's trigram, its text's group)."""
    texts = [f" {(t or '').lower()} " for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    text = np.repeat(np.arange(len(texts)), size)
    letter = _letters()[points]
    first = np.zeros(len(points), dtype=bool)
    first[np.cumsum(size) - size] = True
    stays = letter | first | np.r_[False, letter[:-1]]
    points, text = np.where(letter, points, 32)[stays], text[stays]
    whole = text[2:] == text[:-2]
    alphabet = np.flatnonzero(np.bincount(points))
    number = np.zeros(0x110000, dtype=np.int64)
    number[alphabet] = np.arange(len(alphabet))
    at, base = number[points], len(alphabet)
    code = ((at[:-2] * base + at[1:-1]) * base + at[2:])[whole]
    if base**3 <= 1 << 22:  # a table is faster than a sort, with the same outcome
        distinct = np.flatnonzero(np.bincount(code))
        place = np.zeros(base**3, dtype=np.int64)
        place[distinct] = np.arange(len(distinct))
        index = place[code]
    else:
        distinct, index = np.unique(code, return_inverse=True)
    parts = np.stack([distinct // (base * base), distinct // base % base, distinct % base])
    return alphabet[parts] if len(distinct) else parts, index, group[text[2:][whole]]


def bundle(grams: np.ndarray, index: np.ndarray, group: np.ndarray, groups: int, cells: int, kind=np.float32) -> np.ndarray:
    """Sum of the bound trigram vectors in each group."""
    out = np.zeros((groups, cells), dtype=kind)
    count = grams.shape[1]
    if count > GRAMS:
        order = np.argsort(index, kind="stable")
        index, group = index[order], group[order]
    for low in range(0, count, GRAMS):
        high = min(low + GRAMS, count)
        a, b = (np.searchsorted(index, (low, high)) if count > GRAMS else (0, len(index)))
        times = np.bincount(group[a:b] * (high - low) + index[a:b] - low, minlength=groups * (high - low))
        used, spot = np.unique(grams[:, low:high], return_inverse=True)
        table = np.stack([letter_vector(int(p), cells) for p in used])
        x, y, z = spot.reshape(3, -1)
        bound = np.roll(table, 2, axis=1)[x] * np.roll(table, 1, axis=1)[y] * table[z]
        out += times.reshape(groups, -1).astype(kind) @ bound.astype(kind)
    return out


def learn_prototypes(docs: DataFrame, text: str, lang: str, cells: int = CELLS) -> dict[str, np.ndarray]:
    """Language -> integer prototype. Each task bundles its rows; the sums per language and cell are added by Spark.

    The result is one vector per language value. Null languages and texts
    without letters teach nothing.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, DOCS):
                batch = whole.slice(low, DOCS)
                names = batch.column(1).to_pylist()
                order = sorted(set(names))
                group = np.array([order.index(n) for n in names])
                found = bundle(*trigrams(batch.column(0).to_pylist(), group), len(order), cells, np.float64)
                for name, vector in zip(order, found, strict=True):
                    sums[name] = sums.get(name, 0) + vector
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * cells), pa.array(range(cells), pa.int32()), pa.array(vector.astype(np.int64))],
                names=["lang", "cell", "total"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang))
    sums = rows.mapInArrow(partial, "lang string, cell int, total long").groupBy("lang", "cell").agg(F.sum("total").alias("total"))
    packed = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "total"))), lambda x: x["total"]).alias("v"))
    return {r["lang"]: np.array(r["v"], dtype=np.int64) for r in packed.where(F.exists("v", lambda x: x != 0)).collect()}


def directions(prototypes: dict[str, np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Names in code-point order and unit vectors, without the part all languages share."""
    names = sorted(prototypes)
    if not names:
        return names, np.zeros((0, CELLS))
    unit = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names])
    if len(names) > 1:
        unit = unit - unit.mean(axis=0)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    return names, unit


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score, the cosine with the chosen prototype, at least 0.

    ``und`` with score 0: null and empty texts, texts without a letter, and every
    text if no language was learned. Ties go to the name first in code-point
    order. Rows stay as they are; columns named like the new ones give way.
    """
    names, unit = directions(prototypes)
    unit = unit.astype(np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score = np.full(len(batch), UNKNOWN, dtype=object), np.zeros(len(batch))
            for low in range(0, len(batch) if names else 0, DOCS):
                texts = batch.iloc[low:low + DOCS].tolist()
                profile = bundle(*trigrams(texts, np.arange(len(texts))), len(texts), unit.shape[1])
                norm = np.linalg.norm(profile, axis=1)
                cosine = (profile @ unit.T) / np.maximum(norm, 1e-12)[:, None]
                best = cosine.argmax(axis=1)
                lettered = np.fromiter((any(map(str.isalpha, t or "")) for t in texts), dtype=bool, count=len(texts))
                known = np.flatnonzero((norm > 0) & lettered)
                lang[low + known] = np.array(names, dtype=object)[best[known]]
                score[low + known] = np.clip(cosine[known, best[known]], 0, 1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    (held,) = fresh(docs, "__guess")
    out = docs.withColumn(held, guess(F.col(text)))
    return with_fields(out, F.col(held), {"lang_pred": "string", "score": "double"}).drop(held)
