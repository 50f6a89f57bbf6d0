"""ARIMA and seasonal ARIMA by conditional sums of squares, on whole series of any length.

A series is packed into one array per chunk.  Differences, lagged products and residuals are
vectors over a chunk and the few values before it; no lag ever becomes a column.  The start
follows Hannan and Rissanen (1982), from lagged products alone; Gauss-Newton steps over the exact
innovations and their derivatives then minimise the conditional sum of squares, as a seasonal
model with the product of its two polynomials.

Innovations obey a linear recursion, so a chunk maps the state before it to the state after it by
a matrix and a vector.  Chunks of a longer series report these maps, one pass over them gives each
chunk its exact state, and the next pass adds up what the step needs.  A series of one chunk needs
no such pass and is fitted where it is packed; both ways do the same arithmetic.

Coefficients and the last values of a series are one row, which can be stored, loaded and used
for any horizon.  A null key forms a series of its own; NaN counts as missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.operators.series import SeriesKey, chunked, matched, newest
from driftloom.session import cut_lineage

Order = tuple[int, int, int]
Seasonal = tuple[int, int, int, int]
#: Order of the long autoregression of a series that has the rows for it, at least.
LONG = 16
#: Values that a step of the recursion takes together.
BLOCK = 256
#: Most evaluations of a fit, and the relative step that ends it.
TRIALS, ENOUGH = 60, 1e-10


def fit_groups(
    df: DataFrame, key: SeriesKey, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, max_rows: int, cut: bool = True
) -> DataFrame:
    """Run a per-series pandas function on the last ``max_rows`` rows of every series.

    The hook for custom models: any ``(rows of one series) -> rows`` function.  The caller names
    the number of rows that fit a task; without ``cut`` a longer series fails the query.
    """
    order = key.order

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_rows:
            raise ValueError(f"a series of more than max_rows = {max_rows} rows")
        return fn(pdf.sort_values(order, ignore_index=True))

    # one row more than allowed is enough to fail, so no task ever holds a longer series
    return newest(df, key, max_rows if cut else max_rows + 1).groupBy(*key.keys).applyInPandas(run, schema)


def _differencing(d: int, seasonal: Seasonal) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^s)^D by lag."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(seasonal[1]):
        poly = np.convolve(poly, np.r_[1.0, np.zeros(seasonal[3] - 1), -1.0])
    return poly


def _lag_set(n: int, seasonal_n: int, s: int) -> list[int]:
    return sorted({i + s * j for i in range(n + 1) for j in range(seasonal_n + 1)} - {0})


def _long_order(n: int, reach: int, s: int) -> int:
    """Order of the long autoregression for ``n`` values: a few of short series, several seasons of long ones."""
    wanted = max(reach + 2, LONG, int(10 * np.log10(max(n, 1))), s * (int(np.log2(max(n, 1))) // 2))
    return max(1, reach, min(wanted, n // 4))


def _stable(coefficients: np.ndarray, at: Sequence[int], sign: float) -> bool:
    if not len(at):
        return True
    poly = np.zeros(max(at) + 1)
    poly[0] = 1.0
    poly[list(at)] = sign * coefficients
    poly = np.trim_zeros(poly, "b")
    return len(poly) < 2 or bool(np.all(np.abs(np.roots(poly[::-1])) > 1.001))


@dataclass(frozen=True)
class Shape:
    """Lags of a model, and how its parameters give the coefficient of every lag."""

    order: Order
    seasonal: Seasonal

    @property
    def ar(self) -> list[int]:
        return _lag_set(self.order[0], self.seasonal[0], self.seasonal[3])

    @property
    def ma(self) -> list[int]:
        return _lag_set(self.order[2], self.seasonal[2], self.seasonal[3])

    @property
    def poly(self) -> np.ndarray:
        return _differencing(self.order[1], self.seasonal)

    @property
    def lost(self) -> int:
        """Values that differencing takes."""
        return len(self.poly) - 1

    @property
    def reach(self) -> int:
        return max([0, *self.ar, *self.ma])

    @property
    def needed(self) -> int:
        """Observations that a fit needs."""
        return max(self.lost + 3 * (self.reach + 2), 8)

    @property
    def kept(self) -> int:
        """Last values of a series that a forecast may ask for."""
        return max(self.reach, self.lost + 1)

    def _side(self, plain: np.ndarray, season: np.ndarray, lags: list[int], sign: float) -> tuple[np.ndarray, np.ndarray]:
        s, top = self.seasonal[3], max(lags, default=0) + 1
        one, two = np.zeros(top), np.zeros(top)
        one[0] = two[0] = 1.0
        for i, c in enumerate(plain, 1):
            one[i] += sign * c
        for j, c in enumerate(season, 1):
            two[s * j] += sign * c
        slopes = []
        for i in range(1, len(plain) + 1):
            slopes.append(np.r_[np.zeros(i), two][:top])
        for j in range(1, len(season) + 1):
            slopes.append(np.r_[np.zeros(s * j), one][:top])
        product = np.convolve(one, two)[:top]
        return sign * product[lags], np.array(slopes).reshape(-1, top)[:, lags].T

    def coefficients(self, parameters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coefficients of the AR lags and of the MA lags, and their slopes by parameter."""
        (p, _, q), (sp, _, sq, _) = self.order, self.seasonal
        cuts = np.cumsum([p, sp, q, sq])
        phi, sphi, theta, stheta = np.split(parameters, cuts[:-1])
        ar, d_ar = self._side(phi, sphi, self.ar, -1.0)
        ma, d_ma = self._side(theta, stheta, self.ma, 1.0)
        slopes = np.zeros((len(ar) + len(ma), cuts[-1]))
        slopes[: len(ar), : cuts[1]], slopes[len(ar) :, cuts[1] :] = d_ar, d_ma
        return ar, ma, slopes

    def parameters(self, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
        """Parameters whose own lags have these coefficients."""
        (p, _, q), (sp, _, sq, s) = self.order, self.seasonal
        by_ar, by_ma = dict(zip(self.ar, ar, strict=True)), dict(zip(self.ma, ma, strict=True))
        return np.array([*[by_ar[i] for i in range(1, p + 1)], *[by_ar[s * j] for j in range(1, sp + 1)],
                         *[by_ma[i] for i in range(1, q + 1)], *[by_ma[s * j] for j in range(1, sq + 1)]])

    def stable(self, parameters: np.ndarray) -> bool:
        ar, ma, _ = self.coefficients(parameters)
        return _stable(ar, self.ar, -1.0) and _stable(ma, self.ma, 1.0)

    def products(self, w: np.ndarray, past: np.ndarray, most: int) -> np.ndarray:
        """Sums of ``w[t] * w[t - k]`` for k up to ``most``; ``past`` holds values before ``w``."""
        full, n = np.r_[past, w], len(w)
        before = len(past)
        return np.array([np.dot(w[max(0, k - before) :], full[max(before - k, 0) : before + n - k]) if k < before + n else 0.0 for k in range(most + 1)])

    def start(self, gamma: np.ndarray, n: int) -> np.ndarray:
        """First parameters: a long autoregression gives innovations, whose products follow from ``gamma`` too."""
        ar, ma = self.ar, self.ma
        m = _long_order(n, self.reach, self.seasonal[3]) if ma else 0
        if not (ar or ma) or not gamma[0] > 0:
            return np.zeros(sum(self.order[::2]) + sum(self.seasonal[:3:2]))
        g = lambda h: gamma[np.abs(h)]
        at = np.arange(1, m + 1)
        alpha = np.r_[1.0, -np.linalg.lstsq(g(at[:, None] - at), g(at), rcond=None)[0]] if m else np.ones(1)
        steps = np.arange(m + 1)
        ew = lambda h: float(alpha @ g(h - steps))
        ee = lambda h: float(sum(a * ew(h + i) for i, a in enumerate(alpha)))
        k = len(ar)
        sums, rhs = np.zeros((k + len(ma),) * 2), np.zeros(k + len(ma))
        for a, i in enumerate(ar):
            rhs[a] = g(i)
            sums[a, :k] = g(i - np.array(ar))
            for b, j in enumerate(ma):
                sums[a, k + b] = sums[k + b, a] = ew(i - j)
        for b, j in enumerate(ma):
            rhs[k + b] = ew(-j)
            sums[k + b, k:] = [ee(i - j) for i in ma]
        beta = np.linalg.lstsq(sums, rhs, rcond=None)[0]
        found = self.parameters(beta[:k], beta[k:])
        for _ in range(60):
            if self.stable(found):
                return found
            found = found * 0.8
        return np.zeros_like(found)

    def longest(self, n: int) -> int:
        """The largest lag of the products a start needs."""
        return self.reach + (_long_order(n, self.reach, self.seasonal[3]) if self.ma else 0)

    def differenced(self, v: np.ndarray, past: np.ndarray, before: int, mean: float, most: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Differences that belong to ``v``, at most ``most`` before them, and how many there are in all before.

        ``past`` holds the last of the ``before`` values ahead of ``v``.
        """
        every = np.convolve(np.r_[past, v], self.poly, "valid") if len(past) + len(v) > self.lost else np.zeros(0)
        own = min(len(v), len(every))
        w, ahead = every[len(every) - own :], every[: len(every) - own]
        return w - mean, ahead[max(0, len(ahead) - most) :] - mean, max(0, before - self.lost)


class Recursion:
    """``e[t] = u[t] - sum(theta[l] * e[t - l])`` for many columns, a block of values at a time."""

    def __init__(self, lags: list[int], theta: np.ndarray) -> None:
        self.depth = max(lags, default=0)
        if not self.depth:
            return
        size = self.size = max(BLOCK, self.depth)
        free = np.zeros((self.depth + size, self.depth))
        free[: self.depth] = np.eye(self.depth)
        kick = np.zeros(size)
        kick[0] = 1.0
        for t in range(size):
            for lag, c in zip(lags, theta, strict=True):
                free[self.depth + t] -= c * free[self.depth + t - lag]
                if t >= lag:
                    kick[t] -= c * kick[t - lag]
        at = np.arange(size)[:, None] - np.arange(size)
        self.free, self.forced = free[self.depth :], np.where(at >= 0, kick[np.maximum(at, 0)], 0.0)

    def run(self, u: np.ndarray, past: np.ndarray) -> np.ndarray:
        """Columns ``u`` after the state ``past`` (the last values before them, oldest first)."""
        if not self.depth or not len(u):
            return u
        n, m = u.shape
        blocks = -(-n // self.size)
        padded = np.zeros((blocks * self.size, m))
        padded[:n] = u
        out = np.matmul(self.forced, padded.reshape(blocks, self.size, m))
        for b in range(blocks):
            out[b] += self.free @ past
            past = np.vstack([past, out[b]])[-self.depth :] if self.size < 2 * self.depth else out[b][-self.depth :]
        return out.reshape(-1, m)[:n]

    def after(self, past: np.ndarray, out: np.ndarray) -> np.ndarray:
        """State behind the columns ``out``."""
        return np.vstack([past, out])[len(out) : len(out) + self.depth] if self.depth else past


def _lagged(x: np.ndarray, past: np.ndarray, lag: int) -> np.ndarray:
    """``x`` shifted by ``lag``, with the end of ``past`` in front and zeros before that."""
    full = np.r_[np.zeros(max(0, lag - len(past))), past, x]
    at = len(full) - len(x) - lag
    return full[at : at + len(x)]


class Residuals:
    """Innovations of a chunk and their derivatives by coefficient, for given parameters."""

    def __init__(self, shape: Shape, parameters: np.ndarray) -> None:
        self.shape = shape
        self.ar, self.ma, self.slopes = shape.coefficients(parameters)
        self.recursion = Recursion(shape.ma, self.ma)
        self.columns = 1 + len(self.ar) + len(self.ma)
        self.zero = np.zeros((self.recursion.depth, self.columns))

    def of(self, w: np.ndarray, past: np.ndarray, before: int, state: np.ndarray) -> np.ndarray:
        """Innovations (first column) and derivatives; those before the largest AR lag count as zero."""
        ar, ma, k = self.shape.ar, self.shape.ma, len(self.ar)
        known = before + np.arange(len(w)) >= max(ar, default=0)
        back = [np.where(known, _lagged(w, past, i), 0.0) for i in ar]
        u = np.where(known, w, 0.0) - sum((c * x for c, x in zip(self.ar, back, strict=True)), np.zeros(len(w)))
        first = self.recursion.run(np.stack([u, *[-x for x in back]], 1), state[:, : k + 1])
        if not ma:
            return first
        moved = np.stack([-_lagged(first[:, 0], state[:, 0], j) for j in ma], 1)
        return np.hstack([first, self.recursion.run(moved, state[:, k + 1 :])])

    def sums(self, found: np.ndarray) -> np.ndarray:
        """What a step needs: all products of the columns."""
        return (found.T @ found).ravel()

    def map(self, found: np.ndarray) -> np.ndarray:
        """How the state before a chunk becomes that after it; ``found`` started from no state."""
        depth, n, ma = self.recursion.depth, len(found), self.shape.ma
        eye = np.eye(depth)
        free = self.recursion.run(np.zeros((n, depth)), eye)
        parts = [self.recursion.after(eye, free)]
        for j in ma:
            moved = np.stack([-_lagged(free[:, c], eye[:, c], j) for c in range(depth)], 1)
            parts.append(self.recursion.after(np.zeros((depth, depth)), self.recursion.run(moved, np.zeros((depth, depth)))))
        return np.concatenate([x.ravel() for x in [*parts, self.recursion.after(self.zero, found)]])

    def moved(self, state: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The state after a chunk with the map ``by``."""
        depth, ma, k = self.recursion.depth, self.shape.ma, len(self.ar)
        square = depth * depth
        out = by[square * (1 + len(ma)) :].reshape(depth, self.columns) + by[:square].reshape(depth, depth) @ state
        for j in range(len(ma)):
            out[:, 1 + k + j] += by[square * (1 + j) : square * (2 + j)].reshape(depth, depth) @ state[:, 0]
        return out


class Search:
    """Gauss-Newton with halved steps; its state is a flat array, so that it can wait in a table between passes."""

    def __init__(self, shape: Shape, start: np.ndarray | None = None, state: np.ndarray | None = None) -> None:
        self.shape, k = shape, len(start) if start is not None else (len(state) - 3) // 3
        if state is None:
            state = np.r_[0.0, 0.0, np.inf, start, start, np.zeros(k)]
        self.done, self.trials, self.least = state[:3]
        self.trial, self.best, self.step = state[3 : 3 + k], state[3 + k : 3 + 2 * k], state[3 + 2 * k :]

    def state(self) -> np.ndarray:
        return np.r_[self.done, self.trials, self.least, self.trial, self.best, self.step]

    def tell(self, sums: np.ndarray) -> None:
        """Take the products at ``trial`` and choose the next one, or be done."""
        if self.done:
            return
        size = int(np.sqrt(len(sums)))
        sums = sums.reshape(size, size)
        self.trials += 1
        if sums[0, 0] <= self.least:
            slopes = self.shape.coefficients(self.trial)[2]
            self.best, self.least = self.trial, sums[0, 0]
            self.step = -np.linalg.lstsq(slopes.T @ sums[1:, 1:] @ slopes, slopes.T @ sums[1:, 0], rcond=1e-12)[0]
        else:
            self.step = self.step / 2
        for _ in range(60):
            if self.shape.stable(self.best + self.step):
                break
            self.step = self.step / 2
        self.trial = self.best + self.step
        small = not len(self.step) or np.abs(self.step).max() <= ENOUGH * (1 + np.abs(self.best).max())
        self.done = float(small or self.trials >= TRIALS or not np.isfinite(self.step).all())


# --- packed series -------------------------------------------------------------


def _melted(df: DataFrame, key: SeriesKey, values: Sequence[str]) -> tuple[DataFrame, SeriesKey]:
    """One row per target: every series and target is a series of its own."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("target"), F.col(v).cast("double").alias("y")) for v in values]))
    rest = [c for c in key.order if c not in key.keys]
    rows = df.select(*key.keys, *rest, pairs.alias("_t")).select(*key.keys, *rest, "_t.target", F.nanvl("_t.y", F.lit(None)).alias("y"))
    return rows, SeriesKey((*key.keys, "target"), key.ts, key.tie, key.chunk_rows, key.chunk_seconds)


def _packed(rows: DataFrame, key: SeriesKey) -> DataFrame:
    """One row per chunk: ``last_ts`` and ``y``, its values in order with NaN for missing ones."""
    names = [*key.keys, "_chunk"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    item = F.struct(*[c for c in key.order if c not in key.keys], F.coalesce("y", F.lit(float("nan"))).alias("_y"))
    packed = rows.repartition(parts, *names).groupBy(*names).agg(F.max(key.ts).alias("last_ts"), F.sort_array(F.collect_list(item)).alias("_items"))
    return packed.select(*names, "last_ts", F.transform("_items", lambda x: x["_y"]).alias("y"))


def _fields(df: DataFrame, key: SeriesKey) -> list[T.StructField]:
    many = T.ArrayType(T.DoubleType())
    fields = [df.schema[k] for k in key.keys] + [T.StructField("n_obs", T.LongType()), df.schema["last_ts"]]
    fields += [T.StructField(f"last_{f}", many) for f in ("v", "w", "e")]
    return fields + [T.StructField("coefficients", many), T.StructField("sigma", T.DoubleType()), T.StructField("status", T.StringType())]


def _filled(y: np.ndarray) -> np.ndarray:
    """Values from the first known one on, gaps interpolated by position, the last one carried."""
    known = np.flatnonzero(~np.isnan(y))
    return np.interp(np.arange(known[0], len(y)), known, y[known]) if len(known) else np.zeros(0)


def _last(x: np.ndarray, n: int) -> np.ndarray:
    return np.r_[np.zeros(max(0, n - len(x))), x[max(0, len(x) - n) :]]


def _outcome(shape: Shape, n_obs: int, n_w: int, square: float, mean: float, search: Search | None, v: np.ndarray, w: np.ndarray, e: np.ndarray) -> tuple:
    """The result columns of a series; ``square`` is the sum of its squared differences."""
    status = "empty" if not n_obs else "short" if n_obs < shape.needed else "constant" if square < 1e-20 * max(n_w, 1) else "ok"
    k = len(shape.ar) + len(shape.ma)
    best = np.r_[shape.coefficients(search.best)[:2]] if status == "ok" and search is not None and k else np.zeros(k)
    rows = n_w - max(shape.ar, default=0)
    least = search.least if search is not None and k else square
    sigma = float(np.sqrt(max(least, 0.0) / rows)) if status == "ok" and rows > 0 else 0.0
    held = min(shape.kept, len(v))
    last = [x[len(x) - held :].tolist() for x in (_last(v, shape.kept), _last(w, shape.kept), _last(e, shape.kept))]
    return (n_obs, *last, [float(b) for b in np.concatenate([best])] + ([] if shape.lost else [float(mean)]), sigma, status)


def _fit_whole(shape: Shape, y: np.ndarray) -> tuple:
    """The result columns of a series that is one chunk."""
    v = _filled(y)
    n_obs, none = int((~np.isnan(y)).sum()), np.zeros(0)
    mean = float(v.mean()) if not shape.lost and len(v) else 0.0
    w, _, _ = shape.differenced(v, none, 0, mean, 0)
    square, search, e = float(w @ w), None, np.zeros(len(w))
    if n_obs >= shape.needed and square >= 1e-20 * len(w) and (shape.ar or shape.ma):
        search = Search(shape, shape.start(shape.products(w, none, shape.longest(len(w))), len(w)))
        while not search.done:
            at = Residuals(shape, search.trial)
            search.tell(at.sums(at.of(w, none, 0, at.zero)))
        at = Residuals(shape, search.best)
        e = at.of(w, none, 0, at.zero)[:, 0]
    return _outcome(shape, n_obs, len(w), square, mean, search, v, w, e)


def _result(columns: list[pa.Array], found: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Key columns and last time of series, with their outcomes."""
    each = list(zip(*found, strict=True)) if found else [[]] * 7
    keys, last_ts = columns[:-1], columns[-1]
    arrays = [*keys, pa.array(each[0], pa.int64()), last_ts, *[pa.array(x, pa.list_(pa.float64())) for x in each[1:5]]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(each[5], pa.float64()), pa.array(each[6], pa.string())], names)


def fit_arima(
    df: DataFrame, key: SeriesKey, values: Sequence[str], order: Order = (1, 1, 1), seasonal: Seasonal = (0, 0, 0, 0)
) -> DataFrame:
    """One row per series and target: ``n_obs, last_ts, coefficients, sigma, status`` and its last values.

    Gaps are interpolated by position.  ``status`` is ``ok``, ``constant``, ``short`` or ``empty``;
    every series and target is there.  Coefficients: those of the AR lags, then of the MA lags, then
    the mean where nothing is differenced.
    """
    shape = Shape(order, seasonal)
    rows, tk = _melted(df, key, values)
    rows = cut_lineage(rows)
    total = rows.count()
    if tk.chunk_seconds is None and total <= tk.chunk_rows:
        return _whole(_packed(rows.withColumn("_chunk", F.lit(0).cast("long")), tk), tk, shape)
    packed = cut_lineage(_packed(chunked(rows, tk), tk))
    several = packed.groupBy(*tk.keys).agg((F.count("*") > 1).alias("_several"))
    marked = matched(packed, cut_lineage(several), tk.keys)
    short = _whole(marked.where("NOT _several").drop("_several"), tk, shape)
    return short.unionByName(_fit_chunks(marked.where("_several").drop("_several"), tk, shape, total))


def _whole(packed: DataFrame, key: SeriesKey, shape: Shape) -> DataFrame:
    """Series of one chunk each, fitted where they are."""
    names, fields = [*key.keys, "last_ts"], _fields(packed, key)
    results = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_fit_whole(shape, np.array(y.values.to_numpy(zero_copy_only=False))) for y in batch.column(len(names))]
            yield _result(batch.columns[: len(names)], found, results)

    return packed.select(*names, "y").mapInArrow(run, T.StructType(fields))


# --- series of several chunks ---------------------------------------------------


class Chunks:
    """Chunks of long series, and passes over them: every chunk reports an array, a series' arrays give each chunk its context."""

    def __init__(self, rows: DataFrame, key: SeriesKey) -> None:
        self.rows, self.key, self.names = rows, key, [*key.keys, "_chunk"]

    def swept(self, context: DataFrame | None, columns: Sequence[str], report: Callable, combine: Callable) -> DataFrame:
        """Context rows ``c`` (array of doubles) per chunk: ``combine`` of what ``report(*arrays)`` gives, in the order of the chunks."""
        frame = self.rows if context is None else matched(self.rows, context, self.names)
        n, fields = len(self.names), [self.rows.schema[c] for c in self.names]
        schema = T.StructType([*fields, T.StructField("c", T.ArrayType(T.DoubleType()))])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                arrays = [[np.array(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(n + i)] for i in range(len(columns))]
                found = pa.array([report(*row).tolist() for row in zip(*arrays, strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], found], [*batch.schema.names[:n], "c"])

        def series(table: pa.Table) -> pa.Table:
            table = table.take(pa.array(np.argsort(table.column("_chunk").to_numpy(), kind="stable")))
            found = combine([np.array(c, float) for c in table.column("c").to_pylist()])
            return table.set_column(table.num_columns - 1, "c", pa.array([c.tolist() for c in found], pa.list_(pa.float64())))

        reports = frame.select(*self.names, *columns).mapInArrow(each, schema)
        return cut_lineage(reports.groupBy(*self.key.keys).applyInArrow(series, schema))


def _known(y: np.ndarray) -> np.ndarray:
    """Length, known values, place and value of the first and of the last known one."""
    at = np.flatnonzero(~np.isnan(y))
    return np.array([len(y), len(at), *((at[0], y[at[0]], at[-1], y[at[-1]]) if len(at) else (-1.0, 0.0, -1.0, 0.0))])


def _neighbours(reports: list[np.ndarray]) -> list[np.ndarray]:
    """For every chunk: rows before, nearest known places and values outside it, known values in all, first known place."""
    offsets = np.cumsum([0.0, *[r[0] for r in reports[:-1]]])
    seen, ahead = [np.nan, np.nan], [np.nan, np.nan]
    before, after = [], []
    for at, r in zip(offsets, reports, strict=True):
        before.append(seen)
        seen = [at + r[4], r[5]] if r[1] else seen
    for at, r in zip(offsets[::-1], reports[::-1], strict=True):
        after.append(ahead)
        ahead = [at + r[2], r[3]] if r[1] else ahead
    known = sum(r[1] for r in reports)
    return [np.array([at, *b, *a, known, ahead[0]]) for at, b, a in zip(offsets, before, after[::-1], strict=True)]


def _filled_chunk(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """As ``_filled``, with the known values around the chunk."""
    place = c[0] + np.arange(len(y))
    place = place[place >= c[6]] if not np.isnan(c[6]) else place[:0]
    known = ~np.isnan(y)
    knots = [(c[1], c[2]), *zip(c[0] + np.flatnonzero(known), y[known], strict=True), (c[3], c[4])]
    knots = [k for k in knots if not np.isnan(k[0])]
    return np.interp(place, [k[0] for k in knots], [k[1] for k in knots]) if len(place) else np.zeros(0)


def _fit_chunks(packed: DataFrame, key: SeriesKey, shape: Shape, total: int) -> DataFrame:
    """Series of several chunks, by passes over all chunks at once."""
    names = [*key.keys, "_chunk"]
    raw = Chunks(packed, key)
    around = raw.swept(None, ["y"], _known, _neighbours)
    fields = [packed.schema[c] for c in (*names, "last_ts")]
    n = len(fields)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, cs = ([np.array(x.values.to_numpy(zero_copy_only=False)) for x in batch.column(n + i)] for i in range(2))
            filled = [_filled_chunk(y, c).tolist() for y, c in zip(ys, cs, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(filled, pa.list_(pa.float64())), pa.array([[c[5]] for c in cs], pa.list_(pa.float64()))], [*batch.schema.names[:n], "v", "obs"])

    many = T.ArrayType(T.DoubleType())
    flat = cut_lineage(matched(packed, around, names).select(*names, "last_ts", "y", "c").mapInArrow(
        fill, T.StructType([*fields, T.StructField("v", many), T.StructField("obs", many)])))
    far = shape.longest(total)
    held = shape.lost + far  # values before a chunk that it needs

    def ends(v: np.ndarray) -> np.ndarray:
        return np.r_[len(v), v.sum(), v[max(0, len(v) - held) :]]

    def placed(reports: list[np.ndarray]) -> list[np.ndarray]:
        out, tail, before = [], np.zeros(0), 0.0
        count, value = sum(r[0] for r in reports), sum(r[1] for r in reports)
        for r in reports:
            out.append(np.r_[before, count, value / count if count and not shape.lost else 0.0, tail])
            tail = np.r_[tail, r[2:]]
            tail, before = tail[max(0, len(tail) - held) :], before + r[0]
        return out

    places = Chunks(flat, key).swept(None, ["v"], ends, placed)
    data = Chunks(cut_lineage(matched(flat, places, names).withColumnRenamed("c", "place")), key)

    def differences(v: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        return shape.differenced(v, place[3:], int(place[0]), place[2], far)

    def lagged(v: np.ndarray, place: np.ndarray) -> np.ndarray:
        w, past, _ = differences(v, place)
        return np.r_[place[1], shape.products(w, past, far)]

    def started(reports: list[np.ndarray]) -> list[np.ndarray]:
        gamma, n_w = sum(r[1:] for r in reports), int(reports[0][0]) - shape.lost
        parameters = shape.start(gamma[: shape.longest(n_w) + 1], n_w) if n_w > 0 else np.zeros(sum(shape.order[::2]) + sum(shape.seasonal[:3:2]))
        search = Search(shape, parameters)
        search.done = float(not gamma[0] > 0 or not len(parameters))
        return [np.r_[gamma[0], search.state()]] * len(reports)

    fitting = data.swept(None, ["v", "place"], lagged, started)
    depth = max(shape.ma, default=0)

    def searching(c: np.ndarray) -> Search:
        k = sum(shape.order[::2]) + sum(shape.seasonal[:3:2])
        return Search(shape, state=c[1 : 4 + 3 * k])

    def maps(v: np.ndarray, place: np.ndarray, c: np.ndarray) -> np.ndarray:
        at = Residuals(shape, searching(c).trial)
        return np.r_[len(c), c, at.map(at.of(*differences(v, place), at.zero))]

    def states(reports: list[np.ndarray]) -> list[np.ndarray]:
        out, at = [], None
        for r in reports:
            c, by = r[1 : 1 + int(r[0])], r[1 + int(r[0]) :]
            if at is None:
                at = Residuals(shape, searching(c).trial)
                state = at.zero
            out.append(np.r_[c, state.ravel()])
            state = at.moved(state, by)
        return out

    def residuals(v: np.ndarray, place: np.ndarray, c: np.ndarray) -> tuple[Residuals, np.ndarray, np.ndarray]:
        search = searching(c)
        at = Residuals(shape, search.trial)
        state = c[1 + len(search.state()) :].reshape(at.zero.shape)
        return at, at.of(*differences(v, place), state), c[: 1 + len(search.state())]

    def summed(v: np.ndarray, place: np.ndarray, c: np.ndarray) -> np.ndarray:
        at, found, rest = residuals(v, place, c)
        return np.r_[len(rest), rest, at.sums(found)]

    def told(reports: list[np.ndarray]) -> list[np.ndarray]:
        size = int(reports[0][0])
        rest = reports[0][1 : 1 + size]
        search = searching(rest)
        search.tell(sum(r[1 + size :] for r in reports))
        return [np.r_[rest[0], search.state()]] * len(reports)

    inputs = ["v", "place", "c"]
    while not fitting.where(F.col("c")[1] == 0).isEmpty():
        at_states = data.swept(fitting, inputs, maps, states) if depth else fitting
        fitting = data.swept(at_states, inputs, summed, told)

    def settled(c: np.ndarray) -> np.ndarray:
        search = searching(c)
        search.trial = search.best
        return np.r_[c[0], search.state()]

    fitting = data.swept(fitting, ["c"], settled, lambda reports: reports)
    fitting = data.swept(fitting, inputs, maps, states) if depth else fitting
    kept, fields = shape.kept, _fields(packed, key)
    results = [f.name for f in fields]

    def tails(v: np.ndarray, place: np.ndarray, c: np.ndarray, obs: np.ndarray) -> np.ndarray:
        _, found, rest = residuals(v, place, c)
        w, past, _ = differences(v, place)
        state = c[len(rest) :].reshape(depth, -1)[:, 0] if depth else np.zeros(0)
        ends_ = [_last(np.r_[a, b], kept) for a, b in ((place[3:], v), (past, w), (state, found[:, 0]))]
        return np.r_[obs[0], place[1], place[2], len(rest), rest, *ends_]

    last = data.swept(fitting, [*inputs, "obs"], tails, lambda reports: reports)
    ended = matched(data.rows.select(*names, "last_ts"), last, names)
    # values are in the order of time, so the last chunk holds the end of its series
    ended = ended.groupBy(*key.keys).agg(F.max("last_ts").alias("last_ts"), F.max_by("c", "_chunk").alias("c"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column(len(key.keys) + 1):
                c = np.array(x.values.to_numpy(zero_copy_only=False))
                rest, ends_ = c[4 : 4 + int(c[3])], c[4 + int(c[3]) :].reshape(3, kept)
                v = ends_[0][kept - min(kept, int(c[1])) :]
                found.append(_outcome(shape, int(c[0]), max(0, int(c[1]) - shape.lost), rest[0], c[2], searching(rest), v, ends_[1], ends_[2]))
            yield _result(batch.columns[: len(key.keys) + 1], found, results)

    return ended.select(*key.keys, "last_ts", "c").mapInArrow(finish, T.StructType(fields))


# --- forecasts -------------------------------------------------------------------


def forecast_arima(
    coefficients: DataFrame, steps: int, step_seconds: float, order: Order = (1, 1, 1), seasonal: Seasonal = (0, 0, 0, 0)
) -> DataFrame:
    """Forecast rows from a table of :func:`fit_arima` (``step``, ``ts``, ``forecast``); no status but ``ok`` gives a flat one."""
    shape = Shape(order, seasonal)
    ar, ma, poly = shape.ar, shape.ma, shape.poly

    def one(status: str, beta: list[float], v: list[float] | None, w: list[float], e: list[float]) -> list[float]:
        if not v:
            return [float("nan")] * steps
        if status != "ok":
            return [float(v[-1])] * steps
        mean = 0.0 if len(poly) > 1 else beta[-1]
        level, past_w, past_e = list(v), list(w), list(e)
        for _ in range(steps):
            new = sum(b * past_w[-i] for b, i in zip(beta, ar)) + sum(b * past_e[-i] for b, i in zip(beta[len(ar) :], ma))  # noqa: B905
            past_w.append(new)
            past_e.append(0.0)
            level.append(new + mean - sum(poly[j] * level[-j] for j in range(1, len(poly))))
        return [float(x) for x in level[-steps:]]

    inputs = ["status", "coefficients", "last_v", "last_w", "last_e"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - len(inputs)
            paths = [one(*row) for row in zip(*[c.to_pylist() for c in batch.columns[n:]], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(paths, pa.list_(pa.float64()))], [*batch.schema.names[:n], "path"])

    kept = [f for f in coefficients.schema.fields if f.name not in ("last_v", "last_w", "last_e")]
    sent = coefficients.select(*[f.name for f in kept], *[F.col(c).alias(f"_in_{c}") for c in inputs])
    paths = sent.mapInArrow(run, T.StructType([*kept, T.StructField("path", T.ArrayType(T.DoubleType()))]))
    each = paths.select("*", F.posexplode("path").alias("_at", "forecast"))
    micros = (F.col("_at") + 1).cast("long") * F.lit(int(step_seconds * 1_000_000)).cast("long")
    return each.withColumns({"step": F.col("_at") + 1, "ts": F.timestamp_add("MICROSECOND", micros, F.col("last_ts"))}).drop("path", "_at")


def arima_forecast(
    df: DataFrame, key: SeriesKey, value: str, steps: int, step_seconds: float, order: Order = (1, 1, 1), seasonal: Seasonal = (0, 0, 0, 0)
) -> DataFrame:
    """Fit and forecast one value: ``(keys, step, ts, forecast, sigma, coefficients, status)``."""
    out = forecast_arima(fit_arima(df, key, [value], order, seasonal), steps, step_seconds, order, seasonal)
    return out.select(*key.keys, "step", "ts", "forecast", "sigma", "coefficients", "status")
