"""Near duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints of 64 bits link at a few differing bits.  The index has three kinds of nodes, each
a mask and the bit pattern that all fingerprints below it share:

* upper nodes are fixed masks: the 64 bits are cut into blocks, and two fingerprints within
  ``bits`` differences agree on all but ``bits`` of the blocks, so they meet below at least one
  common upper node.  These nodes are what the cluster partitions by;
* below an upper node the fingerprints are sorted by Gray rank, where neighbours differ in few
  bits; runs of 16 form leaf groups and runs of 16 groups form inner nodes, whose mask holds
  the bits on which the whole run agrees;
* a search goes down two subtrees at once, adds up the differences on the masked bits, and
  drops whole groups as soon as they exceed the limit.

Links never leave a node as pairs: each task keeps a spanning forest of what it linked, so the
rows written are at most one per fingerprint and node.  Components follow from large-star and
small-star rounds over distinct fingerprints, whatever the number of their copies.  A node with
more than ``CELL`` fingerprints is dealt into parts and every two parts meet in one cell, so a
hot node is spread and loses no link.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words
than a shingle count as one shingle; a null id never names a component unless all its ids are
null; repeated rows are separate rows of one component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import LISTED_ROWS, Rows, join_checked, octets, query, small_batches, table, written

SHINGLE, SEED, BITS = 4, 42, 4
#: Fingerprints of a cell: about so many per part of a divided node.
CELL = 4096
#: Blocks of the upper nodes' masks: 15 masks of about 21 bits for four differences.
BLOCKS = 6
RUN = 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes of an UTF-8 text, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    digest = xxhash.xxh64_intdigest
    first, last = starts[: n - shingle + 1].tolist(), (starts[shingle:] - 1).tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    counts = np.zeros((8, 8), np.int64)  # [bit within byte, byte]
    for at in range(0, len(hashes), 255):  # eight counters of a byte per word
        part = hashes[at : at + 255]
        for bit in range(8):
            counts[bit] += np.array([((part >> np.uint64(bit)) & LANES).sum(dtype=np.uint64)], "<u8").view(np.uint8)
    ones = counts.T.reshape(64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a long) of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), octets(F.col(text)).alias("text"))
    return rows.mapInArrow(task, f"key {kind}, fp long").withColumnRenamed("key", key)


def node_masks(bits: int, blocks: int) -> list[int]:
    """Masks of all choices of ``blocks - bits`` blocks of the 64 bits."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(block, blocks - bits)]


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray sequence."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """Smallest member of the part each index is linked to, kept as compressed parents."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            open_pairs = ra != rb
            if not open_pairs.any():
                return
            a, b, ra, rb = a[open_pairs], b[open_pairs], ra[open_pairs], rb[open_pairs]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (nxt := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = nxt


def _nodes(cells: np.ndarray, masks: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of up to RUN consecutive children of one cell: first child, number, cell, shared mask, pattern."""
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    place = np.arange(len(cells)) - np.repeat(starts, np.diff(np.r_[starts, len(cells)]))
    first = np.flatnonzero(place % RUN == 0)
    both = np.bitwise_and.reduceat(patterns, first)
    either = np.bitwise_or.reduceat(patterns, first)
    mask = np.bitwise_and.reduceat(masks, first) & ~(both ^ either)
    return first, np.diff(np.r_[first, len(cells)]), cells[first], mask, both & mask


def _pairs(n: np.ndarray, m: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
    """All (left child, right child, pair) of node pairs with n and m children from the given first ones."""
    size = n * m
    pair = np.repeat(np.arange(len(size)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return left[pair] + inside // m[pair], right[pair] + inside % m[pair], pair


def linked(cells: np.ndarray, prints: np.ndarray, bits: int, room: int = 1 << 20) -> np.ndarray:
    """For sorted cells of fingerprints, the index of the smallest one each is linked to within its cell."""
    order = np.lexsort((gray_rank(prints), cells))
    c, p = cells[order], prints[order]
    full = np.full(len(p), ALL)
    leaf = _nodes(c, full, p)
    top = _nodes(leaf[2], leaf[3], leaf[4])
    forest = Forest(len(p))

    def down(level: int, a: np.ndarray, b: np.ndarray, spent: np.ndarray, seen: np.ndarray) -> None:
        """Go on with node pairs (a <= b) whose masked differences so far are ``spent`` on bits ``seen``."""
        first, count = (top, leaf)[level][:2]
        size = np.cumsum(count[a] * count[b])
        cuts = np.flatnonzero(np.diff(size // room)) + 1
        for part in np.split(np.arange(len(a)), cuts):
            i, j, pair = _pairs(count[a[part]], count[b[part]], first[a[part]], first[b[part]])
            keep = (i <= j) if level == 0 else (i < j)
            i, j, pair = i[keep], j[keep], part[pair[keep]]
            masks, patterns = (leaf[3], leaf[4]) if level == 0 else (full, p)
            fresh = masks[i] & masks[j] & ~seen[pair]
            total = spent[pair] + np.bitwise_count((patterns[i] ^ patterns[j]) & fresh)
            near = total <= bits
            if level == 0:
                down(1, i[near], j[near], total[near], seen[pair][near] | fresh[near])
            else:
                forest.link(i[near], j[near])

    starts = np.flatnonzero(np.r_[True, top[2][1:] != top[2][:-1]])
    sizes = np.diff(np.r_[starts, len(top[2])])
    done = 0
    step = np.maximum(1, room // RUN**2)
    pairs = np.cumsum(sizes * sizes)
    for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(pairs // step)) + 1):
        i, j, _ = _pairs(sizes[part], sizes[part], starts[part], starts[part])
        keep = i <= j
        i, j = i[keep], j[keep]
        seen = top[3][i] & top[3][j]
        spent = np.bitwise_count((top[4][i] ^ top[4][j]) & seen).astype(np.int64)
        near = spent <= bits
        down(0, i[near], j[near], spent[near], seen[near])
        done += len(part)
    back = np.empty(len(p), np.int64)
    back[order] = order[forest.root]
    return back


def links(prints: DataFrame, bits: int = BITS, cell: int = CELL, blocks: int = BLOCKS) -> DataFrame:
    """``a`` and ``b``: a spanning forest of the links between distinct fingerprints ``fp``, cell by cell.

    ``prints`` is a written table of distinct fingerprints.  More ``blocks`` make more and
    narrower upper nodes; any number above ``bits`` finds all links.
    """
    n = prints.count()
    masks = node_masks(bits, max(blocks, bits + 1))
    nodes = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(m - (1 << 64) if m >> 63 else m).cast("long").alias("mask")) for i, m in enumerate(masks)])
    spread = prints.select("fp", F.explode(nodes).alias("node")).select("fp", F.col("node.m").alias("m"), F.col("fp").bitwiseAND(F.col("node.mask")).alias("pattern"))
    hot = spread.groupBy("m", "pattern").agg(F.count("*").alias("c")).where(F.col("c") > 2 * cell)
    hot = written(hot.select("m", "pattern", F.ceil(F.col("c") / cell).cast("int").alias("parts")))
    spread = join_checked(spread, hot, ["m", "pattern"], "left") if hot.count() else spread.withColumn("parts", F.lit(None).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meets = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.least(x, part) * F.col("parts") + F.greatest(x, part)))
    rows = spread.select("fp", "m", "pattern", F.explode(meets).alias("pair"))
    rows = rows.select("fp", F.xxhash64("m", "pattern", "pair").alias("cell"))
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // 400_000)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        fp = np.concatenate([b.column(0).to_numpy() for b in held])
        cells = np.concatenate([b.column(1).to_numpy() for b in held])
        back = linked(cells, fp.view(np.uint64), bits)
        at = np.flatnonzero(back != np.arange(len(back)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[back[at]])], ["a", "b"])

    return rows.repartition(tasks, "cell").mapInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``a`` and ``root`` for every non-root vertex, by alternating large-star and small-star rounds.

    A star's centre is the smallest neighbour; minima are combined before the shuffle, so a
    vertex with very many neighbours is no hot group.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        if (now := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) == before:
            return edges.select("a", F.col("b").alias("root"))
        before = now
        # large star: larger neighbours of every vertex move to its smallest neighbour
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(large.distinct())
        # small star: all smaller neighbours of a vertex, and itself, move to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        edges = written(small.distinct())


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """``key``, ``fp`` and ``component`` (the smallest key reachable by links) of every row."""
    rows = written(fingerprints(docs, key, text, shingle).withColumnRenamed(key, "_id"))
    prints = written(rows.groupBy("fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_c")))
    return named(rows, prints, components(links(prints.select("fp"), bits)), key)


def named(rows: DataFrame, prints: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``rows`` (``_id``, ``fp``) with the smallest id of the component that ``roots`` puts their ``fp`` in."""
    named = prints.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("_least").alias("component"), F.sum("_c").alias("_size"))
    # only fingerprints of more than one row need a name
    named = named.join(least.where("_size > 1"), "root").select("fp", "component", "root")
    out = join_checked(rows, written(named), ["fp"], "left")
    component = F.when(F.col("root").isNull(), F.col("_id")).otherwise(F.col("component"))
    return out.select(F.col("_id").alias(key), "fp", component.alias("component"), F.coalesce("root", "fp").alias("root"))


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS, shingle: int = SHINGLE, listed_rows: int = LISTED_ROWS) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest key, all columns unchanged.

    Rows are told apart by their place in the files, so rows that share a key are rows of their
    own, and texts are read where they lie at every size.
    """
    rows = Rows(docs, listed_rows)
    name = F.struct(F.col(f"_doc.`{key}`").isNull().alias("no"), F.col(f"_doc.`{key}`").alias("id"), F.col("_at").alias("at"))
    found = near_components(rows.numbered().select(name.alias("_name"), F.col(f"_doc.`{text}`").alias("_text")), "_name", "_text", bits, shingle)
    gone = written(found.where("_name <> component").select(F.col("_name.at").alias("_at")))
    return rows.chosen(gone, False, "_doc.*")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
