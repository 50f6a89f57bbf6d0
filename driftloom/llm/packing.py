"""Packing token sequences by vector bin packing.

Every document becomes token ids and one end id.  Each task packs the documents of its own
input split, so no text moves: pieces of full length fill a sequence alone, the rest wait in a
pool of bounded size.  A sequence is filled by the dot-product heuristic: of the waiting pieces
that fit all residual limits (tokens, segments, loss-bearing tokens), the one whose demand has
the largest dot product with the residual capacity goes next; where none fits whole, the best
one is cut.  A sequence that another limit closes early is cut back to a power of two, and the
last documents of a task fill sequences of powers of two, so that no padding is left.

Defined cases: a null or empty text is the end id alone; a text of any length is encoded whole
and keeps only its own ids in memory; repeated rows are packed as often as they come; an empty
table gives no rows; only the columns named are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftloom.llm.common import query, small_batches, table

LENGTH = 2048
SEGMENTS = 128
END = 1
SPECIAL = "<|endoftext|>"
#: Waiting pieces of a task: at most so many, and at most so many ids.
POOL, POOL_IDS = 192, 1 << 20
#: Runs without white space longer than this are encoded by the library whose cost is not quadratic in them.
RUN = 20_000

SCHEMA = "start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def _encoders(ranks_path: str, json_path: str):  # noqa: ANN202
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    return fast, Tokenizer.from_file(json_path)


def encode(text: str, ranks_path: str, json_path: str) -> np.ndarray:
    """Ids of ``text`` as the tokenizer file gives them, without added special tokens.

    The same vocabulary as ranks encodes several times faster with equal ids.
    """
    fast, slow = _encoders(ranks_path, json_path)
    if len(text) >= RUN and max(map(len, text.split()), default=0) >= RUN:
        ids = slow.encode(text, add_special_tokens=False).ids
    elif SPECIAL in text:
        ids = fast.encode(text, allowed_special={SPECIAL})
    else:
        ids = fast.encode_ordinary(text)
    return np.array(ids, "<u4")


class Packer:
    """Fills sequences from a pool of waiting pieces; a piece is [key, ids, start, doc_tokens, first loss id]."""

    def __init__(self, length: int, segments: int, loss: int, first_id: int) -> None:
        self.caps = np.array([length, segments, loss], float)
        self.length, self.next_id = length, first_id
        self.pool: list[list] = []
        self.size = np.zeros((POOL + 64, 3))
        self.ids = 0
        self.out: list[tuple] = []

    def _loss(self, piece: list) -> int:
        """Loss-bearing ids of a piece: those from its document's first one on."""
        return max(0, piece[2] + len(piece[1]) - max(piece[2], piece[4]))

    def _put(self, piece: list) -> None:
        at = len(self.pool)
        if at == len(self.size):
            self.size = np.vstack([self.size, np.zeros_like(self.size)])
        self.size[at] = len(piece[1]), 1, self._loss(piece)
        self.pool.append(piece)
        self.ids += len(piece[1])

    def _take(self, at: int) -> list:
        piece, last = self.pool[at], self.pool.pop()
        if at < len(self.pool):
            self.pool[at], self.size[at] = last, self.size[len(self.pool)]
        self.ids -= len(piece[1])
        return piece

    @staticmethod
    def _cut(piece: list, n: int) -> tuple[list, list]:
        key, ids, start, whole, first = piece
        return [key, ids[:n], start, whole, first], [key, ids[n:], start + n, whole, first]

    def _within(self, piece: list, tokens: int, loss: int) -> int:
        """Ids of a piece that fit both limits."""
        before = max(0, piece[4] - piece[2])
        return int(min(len(piece[1]), tokens, before + loss))

    def _emit(self, pieces: list[list]) -> None:
        offset = 0
        for piece in pieces:
            self.out.append((piece[0], piece[2], len(piece[1]), piece[1].tobytes(), piece[3], self._loss(piece), self.next_id, offset))
            offset += len(piece[1])
        self.next_id += 1

    def _fill(self, length: int) -> None:
        """One sequence of exactly ``length`` ids, or of the largest power of two that the limits allow."""
        left, chosen = self.caps.copy(), []
        left[0] = length
        while left[0] > 0 and left[1] > 0 and self.pool:
            size = self.size[: len(self.pool)]
            gain = (size / self.caps) @ (left / self.caps)
            fits = (size <= left).all(axis=1)
            at = int(np.argmax(np.where(fits, gain, -1.0))) if fits.any() else int(np.argmax(gain))
            n = self._within(self.pool[at], int(left[0]), int(left[2]))
            if n == 0:
                break  # no loss-bearing id fits any more
            piece = self._take(at)
            piece, rest = self._cut(piece, n)
            if len(rest[1]):
                self._put(rest)
            chosen.append(piece)
            left -= [n, 1, self._loss(piece)]
        used = length - int(left[0])
        over = used - (1 << (used.bit_length() - 1)) if used < self.length else 0
        while over:  # closed by another limit: back to a power of two
            piece = chosen.pop()
            piece, rest = self._cut(piece, max(0, len(piece[1]) - over))
            over -= len(rest[1])
            self._put(rest)
            if len(piece[1]):
                chosen.append(piece)
        self._emit(chosen)

    def add(self, key: object, ids: np.ndarray, first_loss: int) -> None:
        piece = [key, ids, 0, len(ids), first_loss]
        while len(piece[1]) >= self.length:
            n = self._within(piece, self.length, int(self.caps[2]))
            if n < self.length:
                break
            full, piece = self._cut(piece, n)
            self._emit([full])
        if len(piece[1]):
            self._put(piece)
        while len(self.pool) >= POOL or self.ids > POOL_IDS:
            self._fill(self.length)

    def finish(self) -> None:
        while self.pool:
            self._fill(min(self.length, 1 << (self.ids.bit_length() - 1)))


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", prompt_tokens: str | None = None, length: int = LENGTH,
    segments: int = SEGMENTS, loss_tokens: int | None = None, end: int = END,
    ranks_path: str = public_tokenizers.path("byte_bpe_50k.tiktoken"), json_path: str = public_tokenizers.path("byte_bpe_50k.json"),
) -> DataFrame:
    """Pieces of all documents: ``key``, start, length, ids (little-endian 32-bit), doc_tokens, loss_tokens,
    sequence_id and offset.

    ``prompt_tokens`` names a column with the number of leading ids that bear no loss (none by
    default); ``length``, ``segments`` and ``loss_tokens`` are the limits of a sequence.
    """
    small_batches(docs.sparkSession)
    loss = length if loss_tokens is None else loss_tokens
    prompt = F.lit(0) if prompt_tokens is None else F.coalesce(F.col(prompt_tokens).cast("long"), F.lit(0))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), prompt.cast("long").alias("prompt"))
    kind = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(length, segments, loss, TaskContext.get().partitionId() << 40)
        key_type = None

        def drained() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True))
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", *[x.split()[0] for x in SCHEMA.split(", ")]])

        for batch in batches:
            key_type = batch.column(0).type
            for k, body, first in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                packer.add(k, np.append(encode(body.as_py(), ranks_path, json_path), np.array([end], "<u4")), first)
                if len(packer.out) >= 1024:
                    yield drained()
        packer.finish()
        if packer.out:
            yield drained()

    packed = rows.mapInArrow(task, f"key {kind}, {SCHEMA}")
    return packed.withColumnRenamed("key", key)


def digest(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


@query("op9_packing")
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return digest(pack(table(spark, folder, "documents")))
