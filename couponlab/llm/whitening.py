"""Whitening of embeddings by incremental eigendecomposition.

Each partition keeps the spectrum of its scatter matrix: eigenvalues, eigenvectors,
mean and number of rows.  BLOCK rows at a time are centred and turned to as many rows as
there are dimensions, which have the same scatter.  Each of them, and the difference of
means, is a rank-one update: deflation sets aside what the update does not touch, the
other eigenvalues are the roots of the secular equation, and their vectors follow from
it.  Spectra are merged in groups of FAN, level by level, by a rank-one update for each
eigenvector of the other one and one for the difference of means.  In the merged basis a
further pass over all rows gives the Rayleigh quotients, whose small eigenproblem refines
the components to double precision.

Entries are integers, floor(64 c) + 1000000, so sums and deviations are exact.  The
driver receives matrices of dimension times dimension, nothing that grows with the
rows.  An update takes time of the order of the dimension cubed.

Rows: a vector that is null, has null or non-finite entries, or entries beyond 2^52 takes
no part; nor does one whose length is not the most common (of equally common lengths the
greater counts).  Repeated rows and ids count each; other columns are ignored; an empty
table gives an empty table.  A direction without variance has a null ``whitened``;
a ``deviation`` beyond 64 bits is null.  Where eigenvalues are equal any basis of their
space may come out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponlab.llm.tables import written

SCALE, SHIFT = 64, 1_000_000
#: Rows of a block, and spectra or matrices that one task merges.
BLOCK, FAN = 1024, 16
COMPONENTS = 32

_EPS = float(np.finfo(np.float64).eps)
_LONG = np.iinfo(np.int64).max
_PART = "part bigint, n bigint, mean binary, spectrum binary, vectors binary, sums array<string>"
_MATRIX = "part bigint, matrix binary"


# --- spectra ------------------------------------------------------------------


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z^2 / (d - x)) = 0 for ascending, distinct ``d``, ``z`` without zeros and rho > 0.

    Gives the pole nearest to each root and the root's distance from it, which keeps digits when they nearly meet.
    All roots are iterated together: two-pole rational steps, bisection where a step leaves its bracket.
    """
    k, weights = len(d), rho * z * z
    upper = np.append(d[1:], d[-1] + weights.sum())
    width = upper - d
    middle = 1 + (weights / ((d - d[:, None]) - width[:, None] / 2)).sum(1)
    # The last root has no pole above it; its origin is always below.
    low_side = middle >= 0
    low_side[-1] = True
    origin = np.where(low_side, d, upper)
    apart = d - origin[:, None]
    next_apart = upper - origin
    low = np.where(low_side, 0.0, -width / 2)
    high = np.where(low_side, np.where(np.arange(k) == k - 1, width * (1 + 4 * _EPS), width / 2), 0.0)
    below = np.tri(k, dtype=bool)
    at = (low + high) / 2
    for _ in range(80):
        gaps = apart - at[:, None]
        terms = weights / gaps
        f = 1 + terms.sum(1)
        slopes = terms / gaps
        slope_low = np.where(below, slopes, 0.0).sum(1)
        slope_high = slopes.sum(1) - slope_low
        low, high = np.where(f < 0, at, low), np.where(f > 0, at, high)
        mine, other = np.diagonal(gaps), next_apart - at
        a = (mine + other) * f - mine * other * (slope_low + slope_high)
        b = mine * other * f
        c = f - mine * slope_low - other * slope_high
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        # A step that is no number leaves the bracket too.
        with np.errstate(divide="ignore", invalid="ignore"):
            new = at + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        # As close to zero as the sum can be told from zero.
        settled = np.abs(f) <= 4 * _EPS * (1 + np.abs(terms).sum(1))
        if settled.all():
            break
        at = np.where(settled, at, new)
    return origin, at


class Spectrum:
    """Eigenvalues (ascending) and eigenvectors (columns) of the scatter of ``n`` rows about their mean."""

    def __init__(self, size: int):
        self.n, self.mean = 0, np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def update(self, v: np.ndarray, rho: float) -> None:
        """Add ``rho`` times the outer product of ``v`` with itself."""
        z = v @ self.vectors
        norm = float(np.sqrt(z @ z))
        if rho <= 0 or norm == 0:
            return
        z, rho = z / norm, rho * norm * norm
        d, q = self.values, self.vectors
        slack = 8 * _EPS * max(abs(d[0]), abs(d[-1]), rho)
        self._join_equal(d, q, z, slack)
        active = np.flatnonzero(rho * np.abs(z) > slack)
        if not len(active):
            return
        da, za = d[active], z[active]
        origin, off = secular_roots(da, za, rho)
        # Distances of roots (rows) from poles, and weights for which these roots are exact.
        gaps = (origin[:, None] - da) + off[:, None]
        k = len(active)
        poles = np.subtract.outer(np.append(da[1:], 0.0), da)
        poles = np.where(np.tri(k, dtype=bool), poles, np.subtract.outer(da, da))
        poles[-1] = rho
        exact = np.sqrt(np.abs(np.prod(gaps / poles, axis=0))) * np.sign(za)
        columns = exact[:, None] / -gaps.T
        columns /= np.sqrt((columns * columns).sum(0))
        d[active], q[:, active] = origin + off, q[:, active] @ columns
        order = np.argsort(d, kind="stable")
        self.values, self.vectors = d[order], q[:, order]

    @staticmethod
    def _join_equal(d: np.ndarray, q: np.ndarray, z: np.ndarray, slack: float) -> None:
        """Turn the vectors of equal eigenvalues so that the update touches one of them."""
        if not (np.diff(d) <= slack).any():
            return
        first = 0
        for last in range(1, len(d) + 1):
            if last < len(d) and d[last] - d[first] <= slack:
                continue
            part = z[first:last]
            length = float(np.sqrt(part @ part))
            if last - first > 1 and length > 0:
                mirror = part.copy()
                mirror[-1] += np.copysign(length, part[-1])
                mirror /= np.sqrt(mirror @ mirror)
                block = q[:, first:last]
                q[:, first:last] = block - 2 * np.outer(block @ mirror, mirror)
                z[first : last - 1] = 0.0
                z[last - 1] = -np.copysign(length, part[-1])
            first = last

    def add(self, rows: np.ndarray) -> None:
        """Take in a block of rows.  A turn of the centred block (QR) leaves as many rows as there are dimensions."""
        mean = rows.mean(0)
        for row in np.linalg.qr(rows - mean, mode="r"):
            self.update(row, 1.0)
        self._shift(mean, len(rows))

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            self.update(vector, float(value))
        self._shift(other.mean, other.n)

    def _shift(self, mean: np.ndarray, n: int) -> None:
        """Count ``n`` more rows about another mean: a rank-one update by the difference."""
        apart, total = mean - self.mean, self.n + n
        if self.n and n:
            self.update(apart, self.n * n / total)
        self.mean = self.mean + apart * (n / total) if total else self.mean
        self.n = total

    def row(self, part: int, sums: list[int]) -> dict:
        packed = {"mean": self.mean, "spectrum": self.values, "vectors": self.vectors}
        return {"part": part, "n": self.n, **{k: v.tobytes() for k, v in packed.items()}, "sums": [str(s) for s in sums]}

    @classmethod
    def read(cls, row: dict) -> Spectrum:
        mean, values, vectors = (np.frombuffer(row[k], np.float64).copy() for k in ("mean", "spectrum", "vectors"))
        made = cls(len(mean))
        made.n, made.mean, made.values, made.vectors = row["n"], mean, values, vectors.reshape(len(mean), -1)
        return made


# --- passes over the rows -----------------------------------------------------


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and ``x``, the integer entries, of the rows that take part; a written table."""
    value = F.col(vector).cast("array<double>")

    def fits(c):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(float(1 << 52)))

    sound = rows.select(key, value.alias("v")).where(F.col("v").isNotNull() & F.forall("v", fits) & (F.size("v") > 0))
    x = F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("bigint"))
    sizes = sound.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    common = sizes[0]["length"] if sizes else 0
    return written(sound.where(F.size("v") == common).select(key, x.alias("x")), "integer-vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _spectra(vectors: DataFrame) -> DataFrame:
    """The spectrum and the exact sums of each partition's rows."""

    def run(batches):
        held, sums = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            if held is None:
                held, sums = Spectrum(x.shape[1]), [0] * x.shape[1]
            sums = [a + b for a, b in zip(sums, _exact_sums(x))]
            for start in range(0, len(x), BLOCK):
                held.add((x[start : start + BLOCK] - SHIFT).astype(np.float64))
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.row(TaskContext.get().partitionId(), sums)])

    return vectors.select("x").mapInArrow(run, _PART)


def _exact_sums(x: np.ndarray) -> list[int]:
    # Halves of 32 bits cannot overflow in a batch.
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(a << 32) + b for a, b in zip(high.sum(0).tolist(), low.sum(0).tolist())]


def _merged_spectra(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    held, sums = Spectrum.read(rows[0]), [int(s) for s in rows[0]["sums"]]
    for row in rows[1:]:
        held.merge(Spectrum.read(row))
        sums = [a + int(b) for a, b in zip(sums, row["sums"])]
    return pa.Table.from_pylist([held.row(rows[0]["part"] // FAN, sums)])


def _merged_matrices(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    total = np.sum([np.frombuffer(r["matrix"], np.float64) for r in rows], axis=0)
    return pa.Table.from_pylist([{"part": rows[0]["part"] // FAN, "matrix": total.tobytes()}])


def _reduced(parts: DataFrame, merge, schema: str, name: str) -> dict | None:
    """The one row to which ``merge`` brings all parts, FAN of them at a time."""
    rows = written(parts, name)
    last = rows.agg(F.max("part")).head()[0]
    if last is None:
        return None
    while last >= 0:
        rows = rows.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(merge, schema)
        last = last // FAN if last >= FAN else -1
    return rows.head().asDict()


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, exact sums, and components (columns) by falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """One over each standard deviation; 0 where there is none."""
        real = self.variances > len(self.sums) * _EPS * self.trace
        return np.where(real, 1 / np.sqrt(np.where(real, self.variances, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the whole part goes before anything is rounded."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        return (x - np.array(whole, np.int64)).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """sum((n x - sums)^2) of each row, exactly; None where it needs more than 64 bits."""
        limit = int(np.sqrt(_LONG // x.shape[1]))
        most = max(self.n * int(x.max()) - min(self.sums), max(self.sums) - self.n * int(x.min())) if x.size else 0
        if most < limit and self.n * int(np.abs(x).max(initial=0)) < _LONG and max(map(abs, self.sums)) < _LONG:
            apart = self.n * x - np.array(self.sums, np.int64)
            return (apart * apart).sum(1).tolist()
        found = [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]
        return [f if f <= _LONG else None for f in found]


def _products(vectors: DataFrame, fitted: Whitening, basis: np.ndarray) -> np.ndarray:
    """Mean outer product of the centred rows' coordinates in ``basis``, over all rows."""

    def run(batches):
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            if batch.num_rows:
                y = fitted.centred(_matrix(batch.column("x"))) @ basis
                total += y.T @ y
        yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "matrix": total.tobytes()}])

    row = _reduced(vectors.select("x").mapInArrow(run, _MATRIX), _merged_matrices, _MATRIX, "products")
    return np.frombuffer(row["matrix"], np.float64).reshape(basis.shape[1], -1) / fitted.n


def fit(vectors: DataFrame) -> Whitening | None:
    """Components of all rows of ``integer_vectors``; None where there are none."""
    row = _reduced(_spectra(vectors), _merged_spectra, _PART, "spectra")
    if row is None:
        return None
    held, sums = Spectrum.read(row), [int(s) for s in row["sums"]]
    basis = np.linalg.qr(held.vectors)[0]
    start = Whitening(held.n, sums, basis, np.zeros(len(sums)), 0.0)
    quotients = _products(vectors, start, basis)
    values, turned = np.linalg.eigh((quotients + quotients.T) / 2)
    order = np.argsort(-values, kind="stable")
    components = np.linalg.qr(basis @ turned[:, order])[0]
    return Whitening(held.n, sums, components, np.maximum(values[order], 0.0), float(np.trace(quotients)))


def transform(vectors: DataFrame, fitted: Whitening, components: int = COMPONENTS) -> DataFrame:
    """The rows with ``deviation`` and ``whitened``, an array with an entry for each component."""
    scales = fitted.scales[:components]
    axes = fitted.components[:, : len(scales)] * scales
    schema = T.StructType(
        [
            *vectors.drop("x", "deviation", "whitened").schema.fields,
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.ArrayType(T.DoubleType())),
        ]
    )
    kept = schema.names[:-2]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            y = fitted.centred(x) @ axes
            values = pa.array(y.ravel(), mask=np.tile(scales == 0, len(x)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(scales), pa.int32()), values)
            columns = [*(batch.column(c) for c in kept), pa.array(fitted.deviations(x), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return vectors.mapInArrow(run, schema)


def identity_error(vectors: DataFrame, fitted: Whitening, components: int = COMPONENTS) -> float:
    """Largest entry of the whitened rows' covariance less the identity, over components with variance, measured on all rows."""
    scales = fitted.scales[:components]
    real = np.flatnonzero(scales > 0)
    if not len(real):
        return 0.0
    covariance = _products(vectors, fitted, fitted.components[:, real] * scales[real])
    return float(np.abs(covariance - np.eye(len(real))).max())


def op12_whitening(spark, folder: str) -> DataFrame:
    """The first components of every row of ``embeddings``, whitened over all of them."""
    vectors = integer_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fitted = fit(vectors)
    if fitted is None:
        return spark.createDataFrame([], schema)
    shares = fitted.variances[:COMPONENTS] / fitted.trace if fitted.trace > 0 else np.zeros(min(COMPONENTS, len(fitted.sums)))
    error = identity_error(vectors, fitted)
    rows = transform(vectors, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(fitted.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
