"""What the operators of this package share: patterns, checked broadcasts, written tables, partial sums."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.session import cut_lineage, fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A word and a run of white space, as Java patterns.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: The most rows of fixed width that are broadcast; above it a join shuffles.
BROADCAST_ROWS = 500_000
#: The most row numbers that are broadcast at once.
LISTED_ROWS = 2_000_000
#: Rows of an Arrow batch handed to a Python function that sees whole texts.
BATCH_ROWS = 256


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its oracle when there is one."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, kept when executors are lost."""
    return cut_lineage(df)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe equality join with a written table of fixed-width rows.

    ``right`` is broadcast when its row count is at most ``most``; a larger one joins by
    shuffle, where adaptive execution splits hot keys.  Its key columns do not return.
    """
    if right.count() <= most:
        right = F.broadcast(right)
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
    match = reduce(lambda a, b: a & b, [same(left[c], renamed[f"__{c}"]) for c in on])
    return left.join(renamed, match, how).drop(*[f"__{c}" for c in on])


class Rows:
    """The rows of a table by number, to read again or leave out a listed set of them without moving any.

    A number is that of the row's file, by its path, and its place in the file.  Listed rows are
    broadcast as plain numbers, at most ``most`` at a time: a longer list is worked off in passes
    over consecutive files, each with the part of the list that belongs to them.  So the texts of
    a table are read where they lie at every size, and never shuffled.  Files that are not
    Parquet, and frames that are no table, are written first.
    """

    #: Bits of the place in a file, and of the blocks of rows that a pass is made of.
    PLACE, SPAN = 40, 20

    def __init__(self, docs: DataFrame, most: int = LISTED_ROWS) -> None:
        self.most = max(1, most)
        self.columns = docs.columns
        self.docs = docs if _is_parquet(docs) else written(docs)
        paths = self.docs.select(F.col("_metadata.file_path").alias("_path")).distinct()
        files = [(r[0], i) for i, r in enumerate(sorted(paths.collect()))]  # one per file, as the driver lists them anyway
        self.files = docs.sparkSession.createDataFrame(files, "_path string, _file long")
        self.paths = [p for p, _ in files]

    def numbered(self) -> DataFrame:
        """``_doc``, a struct of all columns, and ``_at``, the number of the row."""
        rows = self.docs.select(
            F.struct(*[F.col(f"`{c}`") for c in self.columns]).alias("_doc"), F.col("_metadata.row_index").alias("_place"), F.col("_metadata.file_path").alias("_in"))
        rows = rows.join(F.broadcast(self.files), F.col("_in") == F.col("_path"))
        return rows.select("_doc", F.shiftleft("_file", self.PLACE).bitwiseOR(F.col("_place")).alias("_at"), "_in")

    def _passes(self, listed: DataFrame) -> list[tuple[int, int]]:
        """Ranges of blocks that together hold all rows, with at most ``most`` listed ones each, or one block."""
        blocks = listed.groupBy(F.shiftright("_at", self.SPAN).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()
        cuts, held = [-1], 0
        for r in blocks:
            if held and held + r.n > self.most:
                cuts.append(r.b)
                held = 0
            held += r.n
        return list(zip(cuts, [*cuts[1:], 1 << 62], strict=True))

    def chosen(self, listed: DataFrame, inside: bool, *columns: Column | str) -> DataFrame:
        """``columns`` (of ``_doc`` and ``_at``) of the rows that ``listed`` (written, distinct ``_at``) holds, or of all others."""
        rows, how = self.numbered(), "left_semi" if inside else "left_anti"
        passes = self._passes(listed) if listed.count() > self.most else [(-1, 1 << 62)]
        if len(passes) == 1:
            return rows.join(F.broadcast(listed), "_at", how).select(*columns)
        path = fresh_path(listed.sparkSession, "rows")
        block = F.shiftright("_at", self.SPAN)
        for low, high in passes:
            first, last = (min(max(b, 0) >> (self.PLACE - self.SPAN), len(self.paths) - 1) for b in (low, high))
            part = rows.where(F.col("_in").between(self.paths[first], self.paths[last]) & (block >= low) & (block < high))
            part.join(F.broadcast(listed.where((block >= low) & (block < high))), "_at", how).select(*columns).write.mode("append").parquet(path)
        return listed.sparkSession.read.parquet(path)


def _is_parquet(docs: DataFrame) -> bool:
    """Whether every row of ``docs`` is a row of a Parquet file: a scan below nothing but filters and projections."""
    plan = docs._jdf.queryExecution().analyzed().toString()
    if not all(re.match(r"[\s+:-]*(Project|Filter|SubqueryAlias|Relation)\b", line) for line in plan.splitlines()):
        return False
    try:
        docs.select("_metadata.row_index", "_metadata.file_path")
    except AnalysisException:
        return False
    return "_metadata" not in docs.columns


def unit(hashed: Column) -> Column:
    """A 64-bit hash as a number in [0, 1)."""
    return F.shiftrightunsigned(hashed, 11).cast("double") * F.lit(2.0**-53)


def crc_fold(key: Column, parts: int) -> Column:
    """``crc32(key as text) mod parts``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def octets(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty: what Python functions get, without decoding."""
    return F.coalesce(text, F.lit("")).cast("binary")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows, so that very long texts stay within a worker's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = np.frombuffer(data.as_buffer(), np.float64)
            if slot in sums:
                sums[slot] += part
            else:
                sums[slot] = part.copy()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slot", "data"]
    )


def added(parts: DataFrame, slots: int) -> dict[int, np.ndarray]:
    """Element-wise sums of ``(slot int, data binary of doubles)`` rows, one array per slot.

    Partial sums are added in rounds of eight partitions, so that neither a task nor the
    driver ever holds more than eight of them; ``slots`` arrays reach the driver at the end.
    """
    n = parts.rdd.getNumPartitions()
    while n > 8:  # a shuffle first: merging partitions in place would merge the tasks that make the parts
        n = -(-n // 8)
        parts = parts.repartition(n).mapInArrow(_added, "slot int, data binary")
    sums: dict[int, np.ndarray] = {}
    for row in parts.toLocalIterator():
        data = np.frombuffer(row["data"], np.float64)
        sums[row["slot"]] = sums[row["slot"]] + data if row["slot"] in sums else data
    if len(sums) > slots:
        raise ValueError(f"{len(sums)} slots where {slots} are declared")
    return sums
