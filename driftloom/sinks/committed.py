"""Sinks with a commit protocol on the Python data source API.

Tasks write parts under names that no other attempt uses, and the driver commits all parts of a
micro-batch at once, under the number of the batch.  Parts of a lost, repeated or failed attempt are
never committed, and a batch that is committed again replaces itself, so every row counts once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "file string, rows bigint"


@dataclass
class Part(ds.WriterCommitMessage):
    """What a task reports: the name of its part and its rows."""

    file: str
    rows: int


Write = Callable[[Iterator[pa.RecordBatch], dict[str, str]], Part]
Finish = Callable[[list[Part], int, dict[str, str]], None]


def write_part(batches: Iterator[pa.RecordBatch], options: dict[str, str]) -> Part:
    """One Parquet file below ``path``/rows, a batch in memory at a time."""
    files, root = fs.FileSystem.from_uri(options["path"])
    files.create_dir(f"{root}/rows")
    name, rows, writer = f"part-{uuid.uuid4().hex}.parquet", 0, None
    for batch in batches:
        writer = writer or pq.ParquetWriter(f"{root}/rows/{name}", batch.schema, filesystem=files)
        writer.write_batch(batch)
        rows += batch.num_rows
    if writer:
        writer.close()
    return Part(name, rows)


def commit_parts(parts: list[Part], batch_id: int, options: dict[str, str]) -> None:
    """The list of a batch's parts, put in place by one rename."""
    files, root = fs.FileSystem.from_uri(options["path"])
    for folder in ("rows", "commits", "pending"):
        files.create_dir(f"{root}/{folder}")
    pending = f"{root}/pending/{uuid.uuid4().hex}"
    with files.open_output_stream(pending) as out:
        for part in parts:
            if part.rows:
                out.write((json.dumps({"file": part.file, "rows": part.rows}) + "\n").encode())
    files.move(pending, f"{root}/commits/{batch_id}.json")


def abort_parts(parts: list[Part], batch_id: int, options: dict[str, str]) -> None:
    """Remove what the tasks of a failed batch had finished."""
    files, root = fs.FileSystem.from_uri(options["path"])
    for part in parts:
        if files.get_file_info(f"{root}/rows/{part.file}").type == fs.FileType.File:
            files.delete_file(f"{root}/rows/{part.file}")


def register_sink(
    spark: SparkSession, format_name: str, write: Write = write_part, commit: Finish = commit_parts, abort: Finish = abort_parts
) -> None:
    """Register ``format_name`` for ``writeStream``; the functions are the user's own or those for Parquet parts.

    ``write`` runs in every task; ``commit`` and ``abort`` run once a batch on the driver, with what the
    tasks reported (a failed task reports nothing).
    """

    class Writer(ds.DataSourceStreamArrowWriter):
        def __init__(self, options: dict[str, str]) -> None:
            self.options = options

        def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
            return write(iterator, self.options)

        def commit(self, messages: list[Part | None], batchId: int) -> None:
            commit([m for m in messages if m is not None], batchId, self.options)

        def abort(self, messages: list[Part | None], batchId: int) -> None:
            abort([m for m in messages if m is not None], batchId, self.options)

    class Sink(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def streamWriter(self, schema: T.StructType, overwrite: bool) -> Any:
            return Writer(dict(self.options))

    spark.dataSource.register(Sink)


def read_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed parts; other files in the folder do not count."""
    commits = spark.read.schema(MANIFEST).json(f"{path}/commits")
    rows = spark.read.schema(schema).parquet(f"{path}/rows").select("*", F.col("_metadata.file_name").alias("_file"))
    return rows.join(commits.select(F.col("file").alias("_file")), "_file", "left_semi").drop("_file")
