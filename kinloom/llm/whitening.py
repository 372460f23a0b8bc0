"""PCA whitening of vectors; the components come from QDWH spectral divide and conquer.

Entries become whole numbers, so counts, sums and products are added up exactly,
in any order. The covariance of a fit is small (one number per pair of
dimensions); it is split on the driver: the polar factor of ``C - shift * I`` has
eigenvalues +1 and -1, so it gives the projectors on the spaces of the eigenvalues
above and below the shift. Each of the two spaces gets an orthonormal basis, the
covariance restricted to it is split again, until single components are left. The
polar factor is found by dynamically weighted Halley steps (QDWH), which use only
QR factorisations.

Vectors of different length are fitted and whitened apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
LARGEST = 2**61  # whole entries beyond this are set to it
EXACT = 2**53  # whole numbers that doubles hold
ROWS = 1024  # vectors of a batch
OUT = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH; no eigenvalue may be 0.

    The lower bound of the singular values is taken as small as doubles allow; a
    wrong bound costs steps, not correctness, since the loop goes on until it stands still.
    """
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low, one = 1e-15, np.eye(len(a))
    for _ in range(40):
        d = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        both, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, one]))
        upper, lower = both[:len(a)], both[len(a):]
        new = (q / r) * x + (p - q / r) / np.sqrt(r) * (upper @ lower.T)
        new = (new + new.T) / 2
        low = min(low * (p + q * low**2) / (1 + r * low**2), 1.0)
        moved, x = np.linalg.norm(new - x), new
        if moved < 1e-14 * len(a) and low > 1 - 1e-10:
            break
    return x


def basis(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of the range of a projector: its columns of largest rest first, then one step of subspace iteration."""
    rest, chosen = projector.copy(), []
    for _ in range(rank):
        at = int((rest**2).sum(axis=0).argmax())
        unit = rest[:, at] / np.linalg.norm(rest[:, at])
        chosen.append(at)
        rest -= np.outer(unit, unit @ rest)
    q, _ = np.linalg.qr(projector[:, chosen])
    q, _ = np.linalg.qr(projector @ q)
    return q


def components(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    n = len(c)
    spread = np.linalg.norm(c - np.eye(n) * np.trace(c) / max(n, 1))
    if n == 1 or spread <= 1e-15 * np.linalg.norm(c) or not np.any(c):
        return np.diag(c).copy(), np.eye(n)
    # candidates for the shift lie inside the spectrum; the first that leaves something on both sides is taken
    mean, middle = np.trace(c) / n, float(np.median(np.diag(c)))
    for shift in (middle, mean, mean + spread * 1e-3 / n, mean - spread * 1e-3 / n):
        sign = polar(c - shift * np.eye(n))
        rank = round((np.trace(sign) + n) / 2)
        if 0 < rank < n and np.linalg.norm(sign @ sign - np.eye(n)) < 1e-9:
            break
    else:
        return _pairwise(c)
    above = basis((np.eye(n) + sign) / 2, rank)
    below = basis((np.eye(n) - sign) / 2, n - rank)
    below, _ = np.linalg.qr(below - above @ (above.T @ below))
    values, vectors = [], []
    for space in (above, below):
        inner = space.T @ c @ space
        some, within = components((inner + inner.T) / 2)
        values.append(some)
        vectors.append(space @ within)
    values, vectors = np.concatenate(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _pairwise(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jacobi rotations, for a matrix that no shift splits: its eigenvalues agree to rounding."""
    c, v = c.copy(), np.eye(len(c))
    for _ in range(30):
        for i in range(len(c) - 1):
            for j in range(i + 1, len(c)):
                if c[i, j]:
                    angle = 0.5 * np.arctan2(2 * c[i, j], c[i, i] - c[j, j])
                    turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
                    c[:, [i, j]] = c[:, [i, j]] @ turn
                    c[[i, j]] = turn.T @ c[[i, j]]
                    v[:, [i, j]] = v[:, [i, j]] @ turn
        if np.linalg.norm(c - np.diag(np.diag(c))) <= 1e-16 * np.linalg.norm(c):
            break
    order = np.argsort(-np.diag(c), kind="stable")
    return np.diag(c)[order], v[:, order]


@dataclass
class Fit:
    """What whitening needs of the vectors of one length; its size depends on that length only."""

    n: int
    sums: list[int]
    widest: int  # largest distance of an entry from its dimension's centre
    scale: float = 1.0
    trace: float = 0.0
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        """The whole numbers next to the means."""
        return np.array([round(Fraction(s, self.n)) for s in self.sums], dtype=np.int64)

    @property
    def off(self) -> np.ndarray:
        """Means less ``centre``."""
        return np.array([float(Fraction(s, self.n) - int(c)) for s, c in zip(self.sums, self.centre, strict=True)])

    @property
    def exact(self) -> bool:
        """Do sums of products fit into 64 bits, and those of a batch into doubles?"""
        return self.n * self.widest**2 < 2**63 and ROWS * self.widest**2 < EXACT

    def whiten(self, whole: np.ndarray) -> np.ndarray:
        centred = ((whole - self.centre).astype(np.float64) - self.off) / self.scale
        return centred @ self.vectors / np.sqrt(self.values)

    def deviations(self, whole: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S)^2."""
        centre = self.centre
        off = [s - self.n * int(c) for s, c in zip(self.sums, centre, strict=True)]
        if len(off) * (self.n * (self.widest + 1)) ** 2 < 2**63:
            return (((whole - centre) * self.n - np.array(off, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * y - o) ** 2 for y, o in zip(row, off, strict=True)) for row in (whole - centre).tolist()]


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, x): floor(1024 * c) + 100000 of every entry c, as double; without vectors that are null or hold nulls or non-finite entries."""
    c = F.col(vector).cast("array<double>")
    sound = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    far = float(LARGEST)

    def whole(v):
        cell = F.greatest(F.lit(-far), F.least(F.lit(far), v * F.lit(float(SCALE))))
        return F.floor(cell).cast("long") + F.lit(OFFSET)

    return vectors.where(sound).select(F.col(vec_id).cast("long").alias("id"), F.transform(c, whole).alias("x"))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for each length of vectors among up to ROWS rows of a batch."""
    for low in range(0, batch.num_rows, ROWS):
        lists = batch.column("x").slice(low, ROWS)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        size = np.diff(np.r_[0, ends])
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            yield rows + low, flat[(ends - size)[rows][:, None] + np.arange(d)]


def fit(whole: DataFrame) -> dict[int, Fit]:
    """Length of the vectors -> its fit. Two passes: sums, then products of centred entries."""
    each = whole.select(F.size("x").alias("dim"), F.posexplode("x").alias("i", "x")).groupBy("dim", "i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.min("x").alias("least"), F.max("x").alias("most"))
    found: dict[int, Fit] = {}
    for r in each.orderBy("dim", "i").collect():
        one = found.setdefault(r["dim"], Fit(r["n"], [], 0))
        one.sums.append(int(r["s"]))
        middle = round(Fraction(int(r["s"]), r["n"]))
        one.widest = max(one.widest, r["most"] - middle, middle - r["least"])
    products = {dim: [[0] * dim for _ in range(dim)] for dim in found}
    for one in found.values():
        one.scale = 1.0 if one.exact else 2.0 ** max(0, one.widest.bit_length() - 20)
    centres = {dim: one.centre for dim, one in found.items()}

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                one = found[x.shape[1]]
                y = (x - centres[x.shape[1]]).astype(np.float64) / one.scale
                part = y.T @ y  # exact: whole numbers below 2^53
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + (part.astype(np.int64) if one.exact else part)
        for dim, total in sums.items():
            i, j = np.triu_indices(dim)
            exact = found[dim].exact
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array(total[i, j] if exact else [0] * len(i), pa.int64()), pa.array([0.0] * len(i) if exact else total[i, j], pa.float64())],
                names=["dim", "i", "j", "whole", "part"])

    added = whole.select("x").mapInArrow(multiply, "dim int, i int, j int, whole long, part double").groupBy("dim", "i", "j").agg(
        F.sum("whole").alias("whole"), F.sum("part").alias("part"))
    for r in added.collect():
        one, i, j = found[r["dim"]], r["i"], r["j"]
        c = one.centre
        left, right = (one.sums[k] - one.n * int(c[k]) for k in (i, j))
        if one.exact:
            value = float(Fraction(one.n * r["whole"] - left * right, one.n**2))
        else:
            value = r["part"] / one.n - (left / one.n / one.scale) * (right / one.n / one.scale)
        products[r["dim"]][i][j] = products[r["dim"]][j][i] = value
    for dim, one in found.items():
        v = np.array(products[dim], dtype=np.float64)
        one.trace = float(np.trace(v))
        values, vectors = components(v)
        solid = values > dim * np.finfo(float).eps * max(values[0], 0)
        one.values, one.vectors = values[solid], vectors[:, solid]
    return found


def keep_first(found: dict[int, Fit], count: int) -> dict[int, Fit]:
    """The fits, cut to their first components."""
    for one in found.values():
        one.values, one.vectors = one.values[:count], np.ascontiguousarray(one.vectors[:, :count])
    return found


def measure(whole: DataFrame, found: dict[int, Fit]) -> None:
    """Set ``identity_error``: how far the covariance of the whitened vectors is from the identity, as measured on all rows."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                w = np.c_[np.ones(len(x)), found[x.shape[1]].whiten(x)]
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + w.T @ w
        for dim, total in sums.items():
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, dim), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                 pa.array(total.ravel(), pa.float64())], names=["dim", "i", "j", "total"])

    added = whole.select("x").mapInArrow(multiply, "dim int, i int, j int, total double").groupBy("dim", "i", "j").agg(F.sum("total").alias("total"))
    totals = {dim: np.zeros((len(one.values) + 1,) * 2) for dim, one in found.items()}
    for r in added.collect():
        totals[r["dim"]][r["i"], r["j"]] = r["total"]
    for dim, one in found.items():
        mean = totals[dim][0, 1:] / one.n
        covariance = totals[dim][1:, 1:] / one.n - np.outer(mean, mean)
        one.identity_error = float(np.abs(covariance - np.eye(len(mean))).max(initial=0))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries take no part;
    all others are fitted and answered, repeated ones and those with a null id
    too. Entries beyond 2^61 / 1024 are set to that bound. Components are numbered from
    1 by falling eigenvalue. Directions without variance, to rounding, are no
    components: equal vectors, or a single one, have none and give no rows.
    ``deviation`` is exact, and null if it does not fit into 64 bits. Sums are
    exact as long as they fit into 64 bits, and doubles beyond. The fit is held by
    the driver and sent with the tasks: at most a square of the length of the vectors.
    """
    whole = whole_vectors(vectors, vec_id, vector)
    found = keep_first(fit(whole), count)
    measure(whole, found)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for rows, x in matrices(batch):
                one = found[x.shape[1]]
                k = len(one.values)
                if not k:
                    continue
                w, own = one.whiten(x), [str(v) for v in one.deviations(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[r] for r in rows for _ in range(k)], pa.int64()), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                     pa.array(np.full(k * len(rows), one.n), pa.int64()), pa.array([v for v in own for _ in range(k)], pa.string()),
                     pa.array(w.ravel(), pa.float64()), pa.array(np.tile(one.values / one.trace, len(rows)), pa.float64()),
                     pa.array(np.full(k * len(rows), one.identity_error), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(project, OUT).withColumn("deviation", F.expr("try_cast(deviation AS long)")).withColumnRenamed("vec_id", vec_id)
