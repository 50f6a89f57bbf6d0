"""Centroid clustering of integer vectors over a VA-file.

Every vector is approximated by one cell of a few bits per dimension.  For the centroids of a
round, lookup tables say how near and how far a cell's values can be from each centroid's
component; their sums are an interval of the squared distance to every centroid.  Where the intervals leave one centroid, the approximation
decides; only where they overlap is the full vector fetched.

The approximations and the vectors are columns of one table, bucketed by row.  The first round
adds up all vectors.  A later round reads the approximations alone and decides each vector under
the former and the new centroids; vectors that may have moved, or that an interval leaves open,
are fetched by a join on the row that moves their numbers and never the vectors, and their
exact moves correct the sums.  So no assignment is kept between rounds, a lost executor costs its
own tasks, and a hot vector is never a group: all sums are added up within the tasks first.

Defined cases: vectors that are null, have another number of components, or hold a null or
non-finite one take no part; values beyond ``HELD`` are held there, so that a squared distance
fits a long; sums of distances are held within a long; equal distances go to the smaller number;
a null id hashes as empty text; rows with the same id are rows of their own, and as first
centroids they follow the order of their values; fewer vectors than centroids make fewer of them;
no vector gives no rows; extra columns never matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import query, table, written
from driftloom.session import fresh_path

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SALT = 8, 10, 64, 1024.0, "3"
#: Bits of a cell, at most eight.
BITS = 8
#: Quantiles between which the cells of a dimension are equally wide.
ENDS = (0.001, 0.999)
#: Largest magnitude of a component: 64 squares of twice that stay within a long.
HELD = (1 << 27) - 1
#: Rows of a bucket, about.
BUCKET = 500_000
LONG = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """``key`` and ``x``, the components as integers ``floor(scale * c)``, of the vectors that take part."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(F.col(vector), lambda c: F.least(F.greatest(F.floor(F.lit(scale) * c.cast("double")), F.lit(-HELD)), F.lit(HELD)).cast("int"))
    return vectors.where((F.size(vector) == dimensions) & finite).select(F.col(key).alias("key"), x.alias("x"))


class Cells:
    """Cells of every dimension: equally wide between two quantiles, open to the extremes at both ends."""

    def __init__(self, low: np.ndarray, high: np.ndarray, marks: list[np.ndarray], bits: int) -> None:
        self.marks = marks
        self.least, self.most = (np.zeros((len(marks), 1 << bits), np.int64) for _ in range(2))
        for d, m in enumerate(marks):  # cell i holds marks[i-1] < x <= marks[i]
            self.least[d, : len(m) + 1], self.most[d, : len(m) + 1] = np.r_[low[d], m + 1], np.r_[m, high[d]]

    @staticmethod
    def of(vectors: DataFrame, bits: int = BITS) -> Cells | None:
        """Cells that suit the values of ``vectors``; none for an empty table."""
        values = vectors.select(F.posexplode("x").alias("d", "v")).groupBy("d")
        found = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", list(ENDS), 1000).alias("ends")).orderBy("d").collect()
        if not found:
            return None
        even = [np.unique(np.linspace(*r.ends, (1 << bits) - 1).astype(np.int64)) for r in found]
        marks = [m[(m >= r.low) & (m < r.high)] for m, r in zip(even, found, strict=True)]
        return Cells(np.array([r.low for r in found]), np.array([r.high for r in found]), marks, bits)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The cell of every component."""
        return np.stack([np.searchsorted(m, x[:, d]) for d, m in enumerate(self.marks)], 1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> np.ndarray:
        """``[dimension, cell, least or most, centroid]``: the dimension's part of the squared distance.

        Of each distance the one to the middle of the centroids is taken off, which is the same
        for all of them.  What is left is linear in a component, so a cell's ends bound it, and
        the intervals are several times narrower than those of the distances themselves.
        """
        middle = (centroids.sum(0) // len(centroids))[:, None, None]
        a, b = (((e[:, :, None] - centroids.T[:, None]) ** 2) - (e[:, :, None] - middle) ** 2 for e in (self.least, self.most))
        return np.stack([np.minimum(a, b), np.maximum(a, b)], 2)


def intervals(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Which centroids can be the nearest of each row: those whose least distance no other's largest undercuts."""
    total = np.zeros((len(codes), *tables.shape[2:]), np.int64)
    for d, lookup in enumerate(tables):
        total += lookup[codes[:, d]]
    return total[:, 0] <= total[:, 1].min(1, keepdims=True)


def nearest(x: np.ndarray, centroids: np.ndarray, can: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number of and exact squared distance to the nearest centroid among those a row ``can`` have."""
    far = np.full((len(x), len(centroids)), LONG)
    for i, c in enumerate(centroids):
        at = slice(None) if can is None else np.flatnonzero(can[:, i])
        gap = x[at] - c
        far[at, i] = (gap * gap).sum(1)
    number = far.argmin(1)
    return number, far[np.arange(len(x)), number]


def decided(codes: np.ndarray, tables: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Nearest centroid of rows at hand: by the intervals, by full vectors where they overlap."""
    can = intervals(codes, tables)
    number, open_rows = can.argmax(1), np.flatnonzero(can.sum(1) > 1)
    number[open_rows] = nearest(x[open_rows], centroids, can[open_rows])[0]
    return number


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


class _Sums:
    """Sums and counts by cluster of what a task has seen."""

    schema = "cluster int, sums array<long>"

    def __init__(self, clusters: int, dimensions: int) -> None:
        self.sums = np.zeros((clusters, dimensions + 1), np.int64)

    def add(self, number: np.ndarray, x: np.ndarray, sign: int = 1) -> None:
        for i in np.unique(number):
            at = number == i
            self.sums[i] += sign * np.r_[x[at].sum(0), at.sum()]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(len(self.sums)), pa.int32()), pa.array(self.sums.tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])


def _total(parts: DataFrame, clusters: int, dimensions: int) -> np.ndarray:
    """The tasks' sums added up, one row of sums and a count per cluster."""
    total = np.zeros((clusters, dimensions + 1), np.int64)
    for r in parts.select("cluster", F.posexplode("sums").alias("d", "v")).groupBy("cluster", "d").agg(F.sum("v").alias("v")).collect():
        total[r.cluster, r.d] = r.v
    return total


class VaFile:
    """The bucketed table of approximations and vectors, and the rounds over it."""

    def __init__(self, vectors: DataFrame, bits: int = BITS) -> None:
        self.spark, self.cells = vectors.sparkSession, Cells.of(vectors, bits)
        self.name = None
        if self.cells is None:
            return
        cells, dimensions, kind = self.cells, len(self.cells.marks), vectors.schema["key"].dataType.simpleString()

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = pa.array([c.tobytes() for c in cells.codes(_matrix(batch.column(2), dimensions))], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, codes], ["row", "key", "x", "code"])

        self.dimensions, self.name = dimensions, f"driftloom_va_{uuid.uuid4().hex}"
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), vectors.count() // BUCKET)
        rows = vectors.select(F.monotonically_increasing_id().alias("row"), "key", "x").mapInArrow(coded, f"row long, key {kind}, x array<int>, code binary")
        out = rows.repartition(buckets, "row").write.bucketBy(buckets, "row").sortBy("row")
        out.option("path", fresh_path(self.spark, "va")).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def first_centroids(self, clusters: int, order: Column) -> np.ndarray:
        return np.array([r.x for r in self.rows.orderBy(order, "x").limit(clusters).select("x").collect()], np.int64)

    def sums(self, centroids: np.ndarray) -> np.ndarray:
        """Sums and counts of all vectors by nearest centroid."""
        cells, dimensions = self.cells, self.dimensions

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, tables = _Sums(len(centroids), dimensions), cells.tables(centroids)
            for batch in batches:
                x = _matrix(batch.column(1), dimensions)
                out.add(decided(_codes(batch.column(0)), tables, x, centroids), x)
            yield out.batch()

        return _total(self.rows.select("code", "x").mapInArrow(task, _Sums.schema), len(centroids), dimensions)

    def open_rows(self, old: np.ndarray, new: np.ndarray) -> DataFrame:
        """Rows that may have moved between two sets of centroids, by their approximations alone."""
        cells = self.cells

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, after = cells.tables(old), cells.tables(new)
            for batch in batches:
                codes = _codes(batch.column(1))
                one, two = intervals(codes, before), intervals(codes, after)
                still = (one.sum(1) == 1) & (two.sum(1) == 1) & (one.argmax(1) == two.argmax(1))
                yield batch.select([0]).filter(pa.array(~still))

        return self.rows.select("row", "code").mapInArrow(task, "row long")

    def moves(self, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """What the step from ``old`` to ``new`` centroids changes in the sums and counts."""
        cells, dimensions = self.cells, self.dimensions

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, before, after = _Sums(len(new), dimensions), cells.tables(old), cells.tables(new)
            for batch in batches:
                codes, x = _codes(batch.column(0)), _matrix(batch.column(1), dimensions)
                one, two = decided(codes, before, x, old), decided(codes, after, x, new)
                moved = one != two
                out.add(one[moved], x[moved], -1)
                out.add(two[moved], x[moved])
            yield out.batch()

        fetched = self.open_rows(old, new).join(self.rows, "row").select("code", "x")
        return _total(fetched.mapInArrow(task, _Sums.schema), len(new), dimensions)

    def rounds(self, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        """Centroids after so many rounds of assigning all vectors and taking floored means."""
        old, total = None, None
        for _ in range(rounds):
            total = self.sums(centroids) if old is None else total + self.moves(old, centroids)
            old, counts = centroids, np.maximum(total[:, -1:], 1)
            centroids = np.where(total[:, -1:] > 0, total[:, :-1] // counts, old)
            if (centroids == old).all():  # every further round would find the same
                break
        return centroids

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """``key``, ``cluster`` and ``distance`` of every vector."""
        cells, dimensions = self.cells, self.dimensions

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = cells.tables(centroids)
            for batch in batches:
                x = _matrix(batch.column(2), dimensions)
                number = decided(_codes(batch.column(1)), tables, x, centroids)
                gap = x - centroids[number]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array((gap * gap).sum(1))], ["key", "cluster", "distance"])

        kind = self.rows.schema["key"].dataType.simpleString()
        return self.rows.select("key", "code", "x").mapInArrow(task, f"key {kind}, cluster int, distance long")

    def forget(self) -> None:
        """Take the table's name out of the session; written results do not need it."""
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def clusters(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: float = SCALE, salt: str = SALT, bits: int = BITS,
) -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` of every vector that takes part."""
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    file = VaFile(whole_numbers(vectors, key, vector, dimensions, scale), bits)
    if file.cells is None:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = file.rounds(file.first_centroids(clusters, order), rounds)
    found = written(file.assigned(centroids))
    file.forget()

    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_d"))
    sizes = {r.cluster: int(r._d) for r in by.collect()}  # one row per centroid
    means = [(i, min(sizes.get(i, 0), LONG), min(sum(sizes.values()), LONG), [int(v) for v in c]) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(means, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.withColumnRenamed("key", key).join(F.broadcast(named), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _oracle() -> str:
    """The rounds written out one by one."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SALT}:' || vec_id)) - 1)::INTEGER AS k, x AS c FROM v
            ORDER BY sha256('{SALT}:' || vec_id) LIMIT {CLUSTERS})""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, x, d // {1 << 8} AS distance, (d % {1 << 8})::INTEGER AS k FROM (
                SELECT vec_id, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {1 << 8} + k) AS d
                FROM v, c{i} GROUP BY vec_id))"""
        )
        if i < ROUNDS:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
                    SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY d) AS c FROM (
                        SELECT k, d, sum(x[d])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {DIMENSIONS + 1}) AS r(d) GROUP BY k, d) GROUP BY k) m USING (k))"""
            )
    last = ROUNDS
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, k AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{last} JOIN c{last} USING (k)"""


ORACLE = _oracle()


@query("op12_clusters", ORACLE)
def op12_clusters(spark: SparkSession, folder: str) -> DataFrame:
    found = clusters(table(spark, folder, "embeddings"))
    sha = F.sha2(F.array_join(F.transform("centroid", lambda c: c.cast("string")), ",").cast("binary"), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", sha.alias("centroid_sha256"))
