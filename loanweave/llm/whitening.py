"""Whitening by the polarisation covariance.

Components become whole numbers, ``floor(1024 c) + 100000``. The variance of every dimension and of the sum of every pair
of dimensions is summed exactly, from squares of centred values; a cross-covariance is half of what the variance of the sum
has beyond the two variances. The covariance so assembled is decomposed by ``eigh``, and each vector is projected on the
leading unit eigenvectors and divided by the root of their eigenvalues.

Three passes over the vectors, none of which moves them: counts and sums, squares, projection. Values are centred by the
whole number below their mean; what is left of the mean is a whole multiple of 1/n, and corrected in exact arithmetic. A
partition sends one row of sums per vector length; these rows are added up in a tree, so that neither a task nor the
driver holds more than a few. The model has d x d entries and is as large at any number of rows.

Edge cases: a vector that is null or has a null or non-finite component is left out; vectors of different lengths are
fitted and whitened apart, each length with its own ``n``; an empty vector has no components and thus no rows; repeated
rows count and come each; a null ``vec_id`` stays null; a component whose eigenvalue is 0 to double precision has a null
``whitened``; components beyond 2**62 are held there; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .balltree import takes_part
from .common import saved

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAN = 32  # rows of sums that are added up by one task
WIDTH = 24  # bytes of one exact sum
BLOCK = 1024

_FAR = 2.0**62
_LONGEST_DECIMAL = 10**38 - 1


def whole(flat: np.ndarray, d: int) -> np.ndarray:
    """Rows of d whole numbers."""
    return np.floor(np.clip(flat * SCALE, -_FAR, _FAR)).astype(np.int64).reshape(-1, d) + SHIFT


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions in the batch, whole-number rows), a bounded number of rows each."""
    vectors = batch.column(column)
    sizes = np.asarray(vectors.value_lengths())
    starts = np.asarray(vectors.offsets)[:-1]
    values = np.asarray(vectors.values, np.float64)
    for d in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == d)
        for at in np.array_split(places, -(-len(places) // BLOCK)):
            yield d, at, whole(values[(starts[at][:, None] + np.arange(d)).ravel()], d)


def exact(values: np.ndarray, bound: int) -> np.ndarray:
    """The values in a type in which results up to ``bound`` are exact."""
    return values if bound < 2**63 else values.astype(object)


def largest(values: np.ndarray) -> int:
    return max(abs(int(values.min(initial=0))), abs(int(values.max(initial=0))))


def counted(x: np.ndarray) -> np.ndarray:
    """Rows, and the sum of each dimension."""
    return np.array([len(x), *exact(x, largest(x) * len(x)).sum(axis=0)], object)


def squared(z: np.ndarray) -> np.ndarray:
    """Of centred rows: the sum of squares of each dimension, and then of each sum of two dimensions."""
    z = exact(z, 4 * largest(z) ** 2 * len(z))
    sums = [(z * z).sum(axis=0)]
    for i in range(z.shape[1] - 1):
        both = z[:, i : i + 1] + z[:, i + 1 :]
        sums.append((both * both).sum(axis=0))
    return np.concatenate(sums).astype(object)


def packed(sums: np.ndarray) -> bytes:
    return b"".join(int(v).to_bytes(WIDTH, "little", signed=True) for v in sums)


def unpacked(data: bytes) -> np.ndarray:
    return np.array([int.from_bytes(data[i : i + WIDTH], "little", signed=True) for i in range(0, len(data), WIDTH)], object)


def summed(vectors: DataFrame, sums_of: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Length -> exact sums of ``sums_of(length, rows)`` over all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in blocks(batch, 0):
                new = sums_of(d, x)
                held[d] = held[d] + new if d in held else new
        data = [packed(v) for v in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(data, pa.binary())], ["d", "sums"])

    def merge(rows: pd.DataFrame, part: int) -> pd.DataFrame:
        total = sum(map(unpacked, rows["sums"]))
        return pd.DataFrame({"d": [int(rows["d"].iloc[0])], "part": [part], "sums": [packed(total)]})

    def tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return merge(rows, int(key[1]))

    parts = vectors.select("vector").mapInArrow(add, "d int, sums binary")
    parts = saved(parts.withColumn("part", F.spark_partition_id()), "sums")
    last = parts.agg(F.max("part")).first()[0] or 0
    while last >= FAN:
        last = last // FAN
        grouped = parts.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("d", "part")
        parts = grouped.applyInPandas(tree, "d int, part int, sums binary")
    out: dict[int, np.ndarray] = {}
    for row in parts.toLocalIterator():
        new = unpacked(bytes(row["sums"]))
        out[row["d"]] = out[row["d"]] + new if row["d"] in out else new
    return out


@dataclass(frozen=True)
class Centre:
    """The mean of n whole-number rows: ``below`` plus ``rest`` / n, both whole."""

    n: int
    below: np.ndarray
    rest: np.ndarray

    def shifted(self, x: np.ndarray) -> np.ndarray:
        return exact(x, largest(x) + largest(self.below)) - self.below


def centre(sums: np.ndarray) -> Centre:
    n = int(sums[0])
    below = [int(s) // n for s in sums[1:]]
    rest = [int(s) - n * b for s, b in zip(sums[1:], below)]
    fits = max(map(abs, below)) < 2**62
    return Centre(n, np.array(below, np.int64 if fits else object), np.array(rest, object))


def covariance(c: Centre, squares: np.ndarray) -> np.ndarray:
    """By polarisation, from n times the sum of squares about the mean; each entry is rounded once."""
    d = len(c.below)
    rest = c.rest
    apart = [c.n * int(squares[i]) - int(rest[i]) ** 2 for i in range(d)]
    out = np.empty((d, d))
    at = d
    for i in range(d):
        out[i, i] = apart[i] / c.n**2
        for j in range(i + 1, d):
            both = c.n * int(squares[at]) - (int(rest[i]) + int(rest[j])) ** 2
            out[i, j] = out[j, i] = (both - apart[i] - apart[j]) / (2 * c.n**2)
            at += 1
    return out


@dataclass(frozen=True)
class Whitener:
    """``axes``: unit eigenvectors as columns, ``values``: their eigenvalues, falling; ``trace`` of the covariance."""

    centre: Centre
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, z: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)**2, from rows centred by the whole number below."""
        n, rest = self.centre.n, self.centre.rest
        reach = n * largest(z) + n
        z = exact(z, reach**2 * max(z.shape[1], 1))
        apart = n * z - (rest if z.dtype == object else rest.astype(np.int64))
        return [int(v) for v in (apart * apart).sum(axis=1)]

    def whitened(self, z: np.ndarray) -> np.ndarray:
        """NaN for an eigenvalue of 0."""
        from_mean = z.astype(np.float64) - self.centre.rest.astype(np.float64) / self.centre.n
        floor = len(self.axes) * np.finfo(float).eps * max(float(self.values[0]), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return from_mean @ self.axes / np.where(self.values > floor, np.sqrt(np.maximum(self.values, 0)), np.nan)


def whitener(c: Centre, squares: np.ndarray, components: int = COMPONENTS) -> Whitener:
    v = covariance(c, squares)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    # Either sign is right; the largest entry is made positive, so that reruns agree.
    sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return Whitener(c, axes * sign, values, float(np.trace(v)))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """Vector length -> whitener, from all rows; ``vectors`` has one column ``vector`` of finite doubles."""
    centres = {d: centre(s) for d, s in summed(vectors, lambda d, x: counted(x)).items()}
    squares = summed(vectors, partial(_centred_squares, centres))
    return {d: whitener(c, squares[d], components) for d, c in centres.items()}


def _centred_squares(centres: dict[int, Centre], d: int, x: np.ndarray) -> np.ndarray:
    return squared(centres[d].shifted(x))


def identity_errors(projected: DataFrame, models: dict[int, Whitener]) -> dict[int, float | None]:
    """Vector length -> largest absolute entry of the covariance of the whitened rows minus the identity, as measured."""
    most = max((len(m.values) for m in models.values()), default=0)
    if not most:
        return {}
    w = [F.get("w", F.lit(i)) for i in range(most)]
    pairs = [(i, j) for i in range(most) for j in range(i, most)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(w)] + [F.sum(w[i] * w[j]).alias(f"q{i}_{j}") for i, j in pairs]
    out: dict[int, float | None] = {}
    for row in projected.groupBy("d").agg(F.count("*").alias("n"), *sums).collect():
        n = row["n"]
        entries = [
            abs(row[f"q{i}_{j}"] / n - row[f"s{i}"] / n * row[f"s{j}"] / n - (i == j)) for i, j in pairs if row[f"q{i}_{j}"] is not None
        ]
        out[row["d"]] = max(entries, default=None)
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and leading component."""
    usable = vectors.filter(takes_part(F.col("embedding"))).select(
        F.col("embedding").cast("array<double>").alias("vector"), F.col("vec_id").cast("bigint")
    )
    models = fit(usable, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.decimal128(38, 0), pa.list_(pa.float64())]
        for batch in batches:
            for d, at, x in blocks(batch, 0):
                model = models[d]
                z = model.centre.shifted(x)
                apart = [Decimal(min(v, _LONGEST_DECIMAL)) for v in model.deviations(z)]
                w = [[None if v != v else v for v in row] for row in model.whitened(z).tolist()]
                ids = batch.column(1).take(pa.array(at))
                columns = [ids, pa.array([d] * len(at), kinds[1]), pa.array(apart, kinds[2]), pa.array(w, kinds[3])]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "d", "deviation", "w"])

    rows = usable.mapInArrow(project, "vec_id bigint, d int, deviation decimal(38,0), w array<double>")
    projected = saved(rows, "whitened")
    errors = identity_errors(projected, models)

    def lookup(values: dict[int, object], kind: str):
        """One value per vector length; as small as the models."""
        found = [F.when(F.col("d") == d, F.lit(v).cast(kind)) for d, v in values.items()]
        return F.coalesce(F.lit(None).cast(kind), *found)

    shares = {d: [float(v) / m.trace if m.trace > 0 else 0.0 for v in m.values] for d, m in models.items()}
    explained = [F.when(F.col("d") == d, F.array(*[F.lit(v) for v in s])) for d, s in shares.items()]
    return projected.select(
        "vec_id", "deviation",
        lookup({d: m.centre.n for d, m in models.items()}, "bigint").alias("n"),
        lookup(errors, "double").alias("identity_error"),
        F.coalesce(F.lit(None).cast("array<double>"), *explained).alias("_explained"),
        F.posexplode("w").alias("_at", "whitened"),
    ).select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("_explained", "_at").alias("explained"), "identity_error",
    )
