"""Whitening of embeddings by TSQR.

Entries are put on a grid of 1/256 as whole numbers, so sums, means and
deviations are exact. The distinct vectors are the fit list. Each task
centres its rows by the exact sums and reduces them to the triangular factor
R of their QR; factors meet in a tree of bounded fan-in, so no task holds
more than a few of them, and the singular values and right vectors of the
last one are those of all centred rows. The covariance matrix is never
formed, so its squared condition number does no harm.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored

COMPONENTS = 4
#: Steps of the grid in one unit.
GRID = 256
#: Factors that one merging task takes.
FAN_IN = 16
#: Rows that are reduced at once.
BLOCK = 4096
LARGEST = (1 << 63) - 1


def finite(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the rows that are vectors of finite numbers, by length:
    [(places, matrix of doubles)] as two lists, in ascending length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    places, blocks = [], []
    for d in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == d)
        matrix = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        good = np.isfinite(matrix).all(axis=1)
        places.append(at[good])
        blocks.append(matrix[good])
    return places, blocks


def on_grid(matrix: np.ndarray) -> np.ndarray:
    """floor(256 c) as a long; what does not fit is the nearest long."""
    with np.errstate(over="ignore"):
        x = np.floor(GRID * matrix)
    fits = np.abs(x) < 2.0**63
    out = np.where(fits, x, 0).astype(np.int64)
    out[~fits & (x > 0)] = LARGEST
    out[~fits & (x < 0)] = -LARGEST - 1
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of three widths, which its first byte tells,
    so equal rows are equal bytes whatever stands beside them."""
    out: list[bytes] = [b""] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    left = np.ones(len(x), bool)
    for width in (2, 4, 8):
        kind = np.iinfo(f"<i{width}")
        some = np.flatnonzero(left & (low >= kind.min) & (high <= kind.max))
        rows = x[some].astype(f"<i{width}")
        for i, row in zip(some.tolist(), rows, strict=True):
            out[i] = bytes([width]) + row.tobytes()
        left[some] = False
    return out


def unpacked(values: list[bytes], d: int) -> np.ndarray:
    x = np.empty((len(values), d), np.int64)
    for i, v in enumerate(values):
        x[i] = np.frombuffer(v, f"<i{v[0]}", offset=1)
    return x


def _packing(batches):
    for batch in batches:
        for at, block in zip(*finite(batch.column("v")), strict=True):
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([block.shape[1]] * len(at), pa.int32()), pa.array(packed(on_grid(block)), pa.binary())], names=["d", "x"])


def _sums(d: int):
    def run(batches):
        n, totals = 0, [0] * d
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = unpacked(batch.column("x").slice(at, BLOCK).to_pylist(), d)
                # halves of the numbers, so that no sum of a block overflows
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                totals = [t + (int(h) << 32) + int(s) for t, h, s in zip(totals, high, low, strict=True)]
                n += len(x)
        if n:
            sums = pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), sums, pa.array([n] * d, pa.int64())], names=["dim", "s", "n"])

    return run


class Centre:
    """The exact mean S / n of a fit list, as whole parts and rests."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)
        self.share = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once more than the exact value."""
        wide = (x.min(initial=0) < -(1 << 61)) or (x.max(initial=0) > (1 << 61))
        return (x.astype(np.float64) - self.whole if wide else (x - self.whole).astype(np.float64)) - self.share

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 of each row, exact."""
        if not len(x):
            return []
        most = max(abs(int(x.min())), abs(int(x.max()))) + max(abs(int(w)) for w in self.whole) + 1
        if most < 1 << 61 and (most * self.n) ** 2 * x.shape[1] <= LARGEST:
            y = (x - self.whole) * self.n - self.rest
            return (y * y).sum(axis=1).tolist()
        y = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return (y * y).sum(axis=1).tolist()


def _factors(centre: Centre):
    d = len(centre.sums)

    def run(batches):
        r = np.zeros((0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = unpacked(batch.column("x").slice(at, BLOCK).to_pylist(), d)
                r = np.linalg.qr(np.vstack([r, centre.centred(x)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["place", "r"])

    return run


def _merge(d: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        r = np.zeros((0, d))
        for data in group["r"]:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(data).reshape(-1, d)]), mode="r")
        return pd.DataFrame({"place": [int(group["place"].iloc[0]) // FAN_IN], "r": [r.tobytes()]})

    return run


def factor(fit_list: DataFrame, centre: Centre) -> np.ndarray:
    """The triangular factor of all centred rows of ``fit_list`` (x)."""
    d = len(centre.sums)
    tree = stored(fit_list.mapInArrow(_factors(centre), "place long, r binary"), "factors")
    last = tree.agg(F.max("place")).first()[0]
    while last:
        tree = tree.groupBy(F.floor(F.col("place") / FAN_IN).alias("group")).applyInPandas(_merge(d), "place long, r binary")
        last //= FAN_IN
    return np.frombuffer(tree.first()["r"]).reshape(-1, d)


class Whitening:
    """Means, components and eigenvalues of a fit list, for any vectors."""

    def __init__(self, centre: Centre, components: np.ndarray, eigenvalues: np.ndarray, trace: float):
        self.centre, self.components, self.eigenvalues, self.trace = centre, components, eigenvalues, trace
        self.identity_error: float | None = None

    @property
    def known(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        top = self.eigenvalues.max(initial=0.0)
        tiny = (max(self.centre.n, len(self.centre.sums)) * np.finfo(float).eps) ** 2 * top
        return self.eigenvalues > tiny

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            w = self.centre.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)
        w[:, ~self.known] = np.nan
        return w


def _whitened_fit(model: Whitening, kept: list[int]):
    d = len(model.centre.sums)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                w = model.whitened(unpacked(batch.column("x").slice(at, BLOCK).to_pylist(), d))
                yield pa.RecordBatch.from_arrays([pa.array(w[:, c]) for c in kept], names=[f"w{c}" for c in kept])

    return run


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors on the grid of ``rows``
    (vec_id, v); None where there is no vector."""
    fit_list = stored(rows.select("v").mapInArrow(_packing, "d int, x binary").distinct(), "fit_list")
    size = fit_list.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return None
    d = size["d"]
    fit_list = fit_list.where(F.col("d") == d).select("x")
    totals = fit_list.mapInArrow(_sums(d), "dim int, s decimal(38,0), n long").groupBy("dim").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()
    centre = Centre(totals[0]["n"], [int(t["s"]) for t in totals])
    _, values, right = np.linalg.svd(factor(fit_list, centre))
    eigenvalues = np.zeros(d)
    eigenvalues[: len(values)] = values**2 / centre.n
    top = right[: min(components, d)]
    signs = np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])
    model = Whitening(centre, top * np.where(signs == 0, 1, signs)[:, None], eigenvalues[: len(top)], float(eigenvalues.sum()))
    kept = np.flatnonzero(model.known).tolist()
    if kept:
        white = fit_list.mapInArrow(_whitened_fit(model, kept), ", ".join(f"w{c} double" for c in kept))
        pairs = [(a, b) for a in kept for b in kept if a <= b]
        found = white.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
        model.identity_error = max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    return model


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, exact_deviation decimal(38,0)"


def _applied(model: Whitening):
    d, k = len(model.centre.sums), len(model.eigenvalues)
    share = [float(e / model.trace) if model.trace else None for e in model.eigenvalues]

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for at, block in zip(*finite(batch.column("v")), strict=True):
                if block.shape[1] != d or not len(at):
                    continue
                x = on_grid(block)
                exact, white = model.centre.deviations(x), model.whitened(x)
                n = len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array([model.centre.n] * n, pa.int64()),
                        pa.array([v if v <= LARGEST else None for v in exact for _ in range(k)], pa.int64()),
                        pa.array(white.reshape(-1), from_pandas=True),
                        pa.array(share * len(x), pa.float64()),
                        pa.array([model.identity_error] * n, pa.float64()),
                        pa.array([Decimal(v) if v < 10**38 else None for v in exact for _ in range(k)], pa.decimal128(38, 0)),
                    ],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return run


def whitened(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining row of ``table`` and component: vec_id,
    component, n, deviation, whitened, explained, identity_error, and
    exact_deviation, the deviation as a decimal.

    Rows whose vector is null, empty or holds a null, NaN or infinite entry
    are dropped, and so are vectors of another length than most distinct ones
    have (the shorter length on a tie). An entry beyond a long's range counts
    as the nearest long; a deviation beyond it is null in ``deviation`` (and,
    from 10^38 on, in ``exact_deviation``). Rows of a null or repeated vec_id
    are rows like others; repeated vectors count once in the fit list. A
    component without variance (a single distinct vector, say) has a null in
    ``whitened`` and takes no part in ``identity_error``. Of fewer dimensions
    than components there are as many components as dimensions. An empty
    table gives none. Columns not named here are not read."""
    rows = vectors(table, id_col, vector_col)
    model = fit(rows, components)
    if model is None:
        return table.sparkSession.createDataFrame([], RESULT)
    return rows.mapInArrow(_applied(model), RESULT)
