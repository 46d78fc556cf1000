"""Whitening of embeddings by eigenvectors in mixed precision.

The covariance comes from exact integer sums that Spark adds up. Its eigenvectors are first
found in single precision and then corrected by the iteration of Ogita and Aishima: each
round is a few matrix products in higher precision and squares the error. Eigenvalues too
close for that are told apart by a small eigenproblem inside their own space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm.common import barriers, ship, stored, table

STEPS = 256  # whole steps in a unit of the embedding
LARGEST = 1 << 40  # entries of more steps than this count as not finite
COMPONENTS = 4
ROUNDS = 12
LONG = np.iinfo(np.int64).max


# --- whole vectors ---------------------------------------------------------------------------


def _steps(lists: pa.ListArray) -> tuple[np.ndarray, list[bytes]]:
    """(rows kept, their entries as little-endian longs) of a batch of embeddings."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    entries = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(entries * STEPS)
        bad = ~(np.abs(whole) <= LARGEST)
    owner = np.repeat(np.arange(len(lists)), lengths)
    broken = np.bincount(owner[bad], minlength=len(lists)) > 0
    kept = np.flatnonzero(~broken & lists.is_valid().to_numpy(zero_copy_only=False))
    raw = np.where(bad, 0, whole).astype("<i8").tobytes()
    ends = np.cumsum(lengths) * 8
    return kept, [raw[ends[i] - lengths[i] * 8 : ends[i]] for i in kept]


def whole_vectors(rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(256 c) of every entry c, as little-endian longs in one binary.

    Rows with a null vector, or a null, non-finite or absurdly large entry (2^32 or more), are
    left out. A vector without entries stays; where widths differ, missing entries count as 0.
    """
    ship(rows.sparkSession)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = _steps(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), pa.array(x, pa.binary())], names=["vec_id", "x"])

    wanted = rows.select(F.col("vec_id").cast("long"), F.col(embedding).cast("array<double>"))
    return wanted.mapInArrow(convert, "vec_id long, x binary")


def _stacked(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of a matrix, shorter ones filled up with 0."""
    if any(len(v) != 8 * width for v in vectors):
        vectors = [v.ljust(8 * width, b"\0") for v in vectors]
    return np.frombuffer(b"".join(vectors), "<i8").reshape(-1, width)


# --- sums of the fit list --------------------------------------------------------------------

_SUM = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))])
_SUM_DDL = "i int, j int, total decimal(38,0)"


def _sum_rows(i, j, totals) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(t)) for t in totals], _SUM.field("total").type)], schema=_SUM
    )


def _added(partial: DataFrame) -> dict[tuple[int, int], int]:
    """Sums over all tasks. What reaches the driver has the size of the matrix, whatever the number of rows."""
    return {(r["i"], r["j"]): int(r["total"]) for r in partial.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}


def vector_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(rows, exact sum of each entry) of a column ``x``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, object)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            width = max(len(v) for v in rows) // 8 if rows else 0
            if width > len(sums):
                sums = np.concatenate([sums, np.zeros(width - len(sums), object)])
            # 2^40 times the rows of an Arrow batch stays far below 2^63.
            sums[:width] += _stacked(rows, width).sum(axis=0).astype(object) if width else 0
            n += len(rows)
        yield _sum_rows([-1, *range(len(sums))], [-1] * (len(sums) + 1), [n, *sums])

    found = _added(vectors.select("x").mapInArrow(add, _SUM_DDL))
    width = max((i for i, _ in found), default=-1) + 1
    return found.get((-1, -1), 0), [found[i, -1] for i in range(width)]


def _products(y: np.ndarray) -> np.ndarray:
    """Exact sum of the outer products of the rows, as Python integers."""
    largest = int(np.abs(y).max(initial=0))
    if largest > 1 << 26:
        whole = y.astype(object)
        return whole.T @ whole
    rows = max(1, (1 << 53) // max(largest * largest, 1))  # so many add up exactly in doubles
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def scatter(vectors: DataFrame, centre: list[int], tasks: int) -> dict[tuple[int, int], int]:
    """Exact sums of (x - centre)_i (x - centre)_j for i <= j. A task sends the sums of its rows only."""
    width = len(centre)
    upper = np.triu_indices(width)
    shift = np.array(centre, np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            total += _products(_stacked(batch.column(0).to_pylist(), width) - shift)
        yield _sum_rows(*upper, total[upper])

    return _added(vectors.select("x").coalesce(tasks).mapInArrow(add, _SUM_DDL))


# --- eigenvectors in mixed precision ----------------------------------------------------------


def _quotient(numerator: int, denominator: int) -> np.longdouble:
    """The quotient of whole numbers, to the last bit but one of a long double."""
    if numerator == 0:
        return np.longdouble(0)
    shift = 80 - numerator.bit_length() + denominator.bit_length()
    top, bottom = abs(numerator) << max(shift, 0), denominator << max(-shift, 0)
    high, low = divmod(top // bottom, 1 << 40)
    return np.ldexp(np.longdouble(high) * 2**40 + np.longdouble(low), -shift) * (1 if numerator > 0 else -1)


def _slices(a: np.ndarray, bits: int, pieces: int) -> list[np.ndarray]:
    """Doubles of ``bits`` bits each, on one grid for a row, that add up to ``a`` but for what lies below the last grid."""
    _, exponent = np.frexp(np.abs(a).max(axis=1, keepdims=True))
    found, rest = [], a
    for p in range(pieces):
        unit = np.ldexp(np.longdouble(1), exponent - bits * (p + 1))
        part = np.rint(rest / unit) * unit
        found.append(part.astype(float))
        rest = rest - part
    return found


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product in long double out of ordinary products that make no rounding error."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    bits = (53 - int(np.ceil(np.log2(max(a.shape[1], 2))))) // 2
    pieces = -(-66 // bits)
    left, right = _slices(a, bits, pieces), [s.T for s in _slices(b.T, bits, pieces)]
    total = np.zeros((a.shape[0], b.shape[1]), np.longdouble)
    for order in range(pieces - 1, -1, -1):
        for p in range(order + 1):
            total += (left[p] @ right[order - p]).astype(np.longdouble)
    return total


def _norm(a: np.ndarray) -> float:
    return float(np.linalg.norm(a.astype(float), 2))


def _clusters(values: np.ndarray, closeness: float) -> list[np.ndarray]:
    """Indices of eigenvalues that lie in chains with steps of at most ``closeness``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > closeness) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigenpairs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns), in long double, of a symmetric long double matrix.

    Single precision first; then each round corrects vectors whose eigenvalues differ by more
    than the round's error bound, and turns those of a closer cluster by the eigenvectors of
    the matrix in their space, shifted to the cluster's middle so that the differences count.
    """
    n = len(v)
    scale = np.trace(v)
    if n == 0 or scale <= 0:
        return np.zeros(n, np.longdouble), np.eye(n, dtype=np.longdouble)
    a = v / scale
    eye = np.eye(n, dtype=np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    length, before = _norm(a), np.inf
    for _ in range(ROUNDS):
        r = eye - product(x.T, x)
        s = product(x.T, product(a, x))
        values = np.diag(s) / (1 - np.diag(r))
        bound = max(2 * (_norm(s - np.diag(values)) + length * _norm(r)), n * length * 2.0**-60)
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= bound
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + product(x, e)
        for members in _clusters(values, bound):
            space = x[:, members]
            inside = product(space.T, product(a - values[members].mean() * eye, space))
            largest = np.abs(inside).max()
            if largest > 2.0**-58:
                turn = np.linalg.eigh(((inside + inside.T) / (2 * largest)).astype(float))[1]
                x[:, members] = product(space, turn)
        error = float(np.abs(e).max())
        if error < 2.0**-60 or (error >= before and before < 2.0**-30):
            break
        before = error
    for _ in range(2):  # vectors of eigenvalues that rounding can't tell apart stay orthogonal too
        x = x + product(x, eye - product(x.T, x)) / 2
    values = np.diag(product(x.T, product(a, x)))
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))


# --- the model ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """n vectors with the entry sums ``sums``; ``centre`` is their floored mean and ``offset`` what the mean
    lies above it. ``projection`` has one column for each component, scaled to variance 1."""

    n: int
    sums: list[int]
    centre: list[int]
    offset: np.ndarray
    projection: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float | None

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.centre, np.int64)).astype(float) - self.offset) @ self.projection


def covariance(n: int, sums: list[int], centre: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """Centred covariance with divisor n, each entry rounded once from exact whole numbers."""
    width = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre)]
    v = np.zeros((width, width), np.longdouble)
    for (i, j), total in products.items():
        v[i, j] = v[j, i] = _quotient(n * total - rest[i] * rest[j], n * n)
    return v


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on each distinct vector of a column ``x`` (as ``whole_vectors`` gives it) once.

    Copies are dropped before anything is counted: each task drops its own first, so a vector
    that a third of all rows share travels once for each task. Tables are read by all tasks;
    the driver holds a few matrices of the embedding's width.
    """
    with barriers(vectors.sparkSession):
        return _fit(stored(vectors.select("x").distinct()), components)


def _fit(distinct: DataFrame, components: int) -> Whitening:
    n, sums = vector_sums(distinct)
    width = len(sums)
    if n == 0 or width == 0:
        empty = np.zeros(0)
        return Whitening(n, sums, [0] * width, np.zeros(width), np.zeros((width, 0)), empty, empty, None)
    centre = [s // n for s in sums]
    # No more tasks than leave each with as many rows as the matrix, which every task sends.
    products = scatter(distinct, centre, max(1, n // width))
    v = covariance(n, sums, centre, products)
    values, x = eigenpairs(v)
    trace = np.trace(v)
    # Directions without variance can't be scaled to 1; what rounding leaves of them is far below this.
    used = min(components, int((values > trace * width * 2.0**-56).sum())) if trace > 0 else 0
    values, x = values[:used], x[:, :used]
    offset = np.array([float(_quotient(s - n * c, n)) for s, c in zip(sums, centre)])
    model = Whitening(
        n, sums, centre, offset, (x / np.sqrt(values)).astype(float), values.astype(float),
        (values / trace).astype(float) if used else np.zeros(0), None,
    )
    return Whitening(**{**model.__dict__, "identity_error": identity_error(distinct, model)}) if used else model


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened ``vectors``, measured on them, minus the identity."""
    used = model.projection.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(used), np.zeros((used, used))
        for batch in batches:
            w = model.project(_stacked(batch.column(0).to_pylist(), len(model.sums)))
            sums += w.sum(axis=0)
            products += w.T @ w
        i, j = np.indices((used, used)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.full(used, -1), i]), pa.int32()), pa.array(np.concatenate([np.arange(used), j]), pa.int32()),
            pa.array(np.concatenate([sums, products.ravel()])),
        ], names=["i", "j", "total"])

    added = vectors.select("x").mapInArrow(add, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    found = {(r["i"], r["j"]): r["total"] / model.n for r in added.collect()}
    # The vectors are centred before they are multiplied; their whitened mean is 0 but for rounding.
    mean = np.array([found[-1, j] for j in range(used)])
    cov = np.array([[found[i, j] for j in range(used)] for i in range(used)]) - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(used)).max())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``vectors`` are those of ``whole_vectors``. A fit list with fewer directions of variance
    than components has fewer components; without any (no vector, or one only) there is no
    row. ``deviation``, the exact sum of (n x - S)^2, is null where it exceeds a long. Rows
    with equal vec_id are each whitened; columns of the input other than vec_id and the
    embedding are not read, so their names can't clash.
    """
    used, width, n = model.projection.shape[1], len(model.sums), model.n
    rest = [s - n * c for s, c in zip(model.sums, model.centre)]
    constant = sum(t * t for t in rest)

    def deviations(x: np.ndarray) -> list[int | None]:
        y = x - np.array(model.centre, np.int64)
        largest = max(int(np.abs(y).max(initial=0)), 1)
        if width * largest * max(largest, *map(abs, rest)) <= LONG:
            squares, mixed = (y * y).sum(axis=1), (y * np.array(rest, np.int64)).sum(axis=1)
        else:
            y = y.astype(object)
            squares, mixed = (y * y).sum(axis=1), (y * np.array(rest, object)).sum(axis=1)
        found = [n * n * q - 2 * n * m + constant for q, m in zip(squares.tolist(), mixed.tolist())]
        return [d if d <= LONG else None for d in found]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stacked(batch.column(1).to_pylist(), width)
            rows = len(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), used))),
                pa.array(np.tile(np.arange(1, used + 1), rows), pa.int32()),
                pa.array(np.full(rows * used, n, np.int64)),
                pa.array([d for d in deviations(x) for _ in range(used)], pa.int64()),
                pa.array(model.project(x).ravel()),
                pa.array(np.tile(model.explained, rows)),
                pa.array(np.full(rows * used, model.identity_error or 0.0)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = vectors.select("vec_id", "x")
    return (found if used else found.limit(0)).mapInArrow(project, ddl)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return whiten(vectors, fit_whitening(vectors))
