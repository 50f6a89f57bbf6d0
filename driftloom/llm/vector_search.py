"""Exact top-k inner products by multi-resolution segment statistics.

A vector is described at several resolutions by the mean and deviation of its segments.  For
two segments of one length the distance is at least that between their (mean, deviation)
points, so the inner product is at most ``sum(length * (mean * mean + deviation * deviation))``;
with the norms fixed, the largest inner product is the least distance.  A task meets a block of
queries with a block of candidates: bounds go from coarse to fine, each level drops the
candidates whose bound lies below the k-th best score known for the query, and exact integer
products are computed for the survivors only.  Blocks keep their own k best, which are merged.

Queries are a stated set, met in blocks with all rows: a block has at most ``BLOCK`` queries and
about ``BLOCK`` candidates, whatever the table holds, so a task's memory is fixed.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part;
a shorter vector counts as if zeros followed; an empty vector scores 0; equal scores go to the
smaller id, a null id last; every row is a candidate of its own, also when an id repeats, and
only the query's own row is left out; scores beyond 64 bits are held at the ends of the range;
an empty table gives no rows; extra columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.common import query, table, written

K = 5
SCALE = 256.0
#: Rows of a block.
BLOCK = 8192
#: Segments per resolution, coarse to fine.
LEVELS = (4, 8, 16)
#: Candidates with the best coarse bounds that give a query its first k-th best score.
PROBE = 32
#: Largest magnitude whose products are exact in doubles, for vectors of up to 2**13 components.
EXACT = float(1 << 20)


def floored(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """Written rows that take part: ``row``, ``key`` and ``x``, the components as doubles ``floor(scale * c)``."""
    x = F.transform(F.col(vector), lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("double"))
    fine = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    raw = F.transform(F.col(vector), lambda c: F.lit(scale) * c.cast("double"))
    big = F.exists(raw, lambda c: F.abs(c) >= 2.0**62)  # already whole numbers, beyond what floor() returns
    return written(vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.when(big, raw).otherwise(x).alias("x")))


def _dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, zeros behind shorter ones."""
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    sizes = pc.list_value_length(flat).to_numpy(zero_copy_only=False)
    values = flat.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments of every row, times the root of the segment's length."""
    parts = []
    for part in np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1])):
        mean = x[:, part].mean(1)
        parts += [np.sqrt(len(part)) * mean, np.sqrt(len(part)) * np.sqrt(np.maximum((x[:, part] ** 2).mean(1) - mean**2, 0))]
    return np.stack(parts, 1) if parts else np.zeros((len(x), 1))


def _whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows, held within 64 bits."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT and a.shape[1] <= 1 << 13:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    ends = (-(1 << 63), (1 << 63) - 1)
    return np.array([min(max(sum(int(p) * int(q) for p, q in zip(u, v, strict=True)), ends[0]), ends[1]) for u, v in zip(a, b, strict=True)], np.int64)


def best_of_block(q: np.ndarray, q_row: np.ndarray, c: np.ndarray, c_row: np.ndarray, c_rank: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, candidate, score) of the k best candidates of every query; equal scores by ``c_rank``."""
    found: list[tuple[np.ndarray, ...]] = []
    small = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) < EXACT and q.shape[1] <= 1 << 13
    qs, cs = [segment_statistics(q, n) for n in LEVELS], [segment_statistics(c, n) for n in LEVELS]
    slack = 1e-9 * (np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(c, axis=1).max(initial=0) + 1)
    for lo in range(0, len(q), 128):
        at = slice(lo, min(lo + 128, len(q)))
        bound = qs[0][at] @ cs[0].T + slack
        own = q_row[at, None] == c_row[None, :]
        probes = min(len(c), max(PROBE, 2 * k) + 1)
        near = np.argpartition(-bound, probes - 1, axis=1)[:, :probes] if probes < len(c) else np.tile(np.arange(len(c)), (len(bound), 1))
        i = np.repeat(np.arange(len(bound)), near.shape[1])
        known = _whole(q[at][i], c[near.ravel()]).astype(float)
        known[own[i, near.ravel()]] = -np.inf
        known = known.reshape(near.shape)
        floor = np.partition(known, -k, axis=1)[:, -k] if known.shape[1] >= k else np.full(len(bound), -np.inf)
        alive = (bound >= floor[:, None]) & ~own
        left = np.flatnonzero(alive.any(0))  # candidates that some query of the slice still needs
        for a, b in zip(qs[1:], cs[1:], strict=True):
            keep = alive[:, left] & (a[at] @ b[left].T + slack >= floor[:, None])
            alive[:, left] = keep
            left = left[keep.any(0)]
        alive = alive[:, left]
        if small:  # whole numbers below 2**53 all along, so the products are exact
            dots = np.where(alive, q[at] @ c[left].T, -np.inf)
            if dots.shape[1] > k:
                alive &= dots >= np.partition(dots, -k, axis=1)[:, -k, None]
            i, j = np.nonzero(alive)
            score = dots[i, j].astype(np.int64)
            j = left[j]
        else:
            i, j = np.nonzero(alive)
            j = left[j]
            score = np.concatenate([_whole(q[at][i[s : s + 65536]], c[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
        order = np.lexsort((c_rank[j], -score.astype(object) if len(score) and score.min() == -(1 << 63) else -score, i))
        i, j, score = i[order], j[order], score[order]
        starts = np.searchsorted(i, i)
        top = np.arange(len(i)) - starts < k
        found.append((i[top] + lo, j[top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def top_k(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, scale: float = SCALE, block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``key`` and ``score`` of the k best rows of ``vectors`` for every query.

    ``queries`` is a condition on the columns of ``vectors``, as a function of the frame.
    """
    chosen = queries
    rows = floored(vectors, key, vector, scale)
    asked = rows.where(chosen(F.col("key")))
    n, m = rows.count(), asked.count()
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    c_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-m // block))
    kind = vectors.schema[key].dataType.simpleString()
    candidates = rows.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(c_blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    wanted = asked.withColumn("q", F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        c_keys = c.column("key").combine_chunks()
        c_keys = c_keys if isinstance(c_keys, pa.Array) else pa.concat_arrays(c_keys.chunks)
        order = pc.sort_indices(pa.table({"k": c_keys}), sort_keys=[("k", "ascending")], null_placement="at_end").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        i, j, score = best_of_block(_dense(q.column("x"), width), q.column("row").to_numpy(), _dense(c.column("x"), width), c.column("row").to_numpy(), rank, k)
        return pa.table({
            "query_row": q.column("row").take(pa.array(i, pa.int64())), "query_id": q.column("key").take(pa.array(i, pa.int64())),
            "key": c_keys.take(pa.array(j, pa.int64())), "row": c.column("row").take(pa.array(j, pa.int64())), "score": pa.array(score, pa.int64())})

    met = wanted.select("c", "q", "row", "key", "x").groupBy("c", "q").cogroup(candidates.select(F.col("c").cast("long").alias("c"), "q", "row", "key", "x").groupBy("c", "q"))
    some = met.applyInArrow(meet, f"query_row long, query_id {kind}, key {kind}, row long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("key").asc_nulls_last(), "row"))
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op2_top_k", ORACLE)
def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), lambda key: key % 50 == 0)
