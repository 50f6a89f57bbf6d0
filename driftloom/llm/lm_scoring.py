"""Language-model scores of documents by a hashed maximum-entropy model.

A token's probability is that of its class, given features of the tokens before it, times that
of the token within its class, given the same features.  The class factor is a softmax over hashed
n-gram and skip features (previous token, pair of previous tokens, token before the previous one,
classes of the last three).  Within a class the tokens are the leaves of a binary tree, and every
branch is a logistic model over the same features, with weights hashed by feature and branch.  Both
are trained by distributed gradient updates: in every round each task starts from the common
weights, takes steps over its share of the training documents, and the mean of the tasks' changes
updates the weights, a slot's changes weighted by the squared gradients that it had in each task,
so that a feature which few tasks see keeps what they learn.  All training documents are used once.

Every frequent token (at most ``HEAD``) is a leaf of its own.  All others share leaves by a hash, about
``SHARING`` distinct ones each, and have within their leaf their count, with one unknown slot a leaf, so
the model is a proper distribution over the known tokens and the unknown slots.  Leaves grow with the
vocabulary, and so do the slots of the weights, up to ``1 << MOST_BITS``.

Frequent tokens go to the tasks as a table; counts of all others are joined by token, so no table of
the vocabulary is ever broadcast or collected.  A frequent token is a class of its own or shares one by
frequency; the class of any other token is a hash of its ending, which needs no table.

Defined cases: null and empty texts are one end token; texts of any length are scored whole;
without training text every count is zero and the score comes from the unknown slots; repeated
rows are scored (and learned) as often as they come; an empty table gives no rows; extra columns
never matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import added, crc_fold, octets, query, small_batches, table, unit, written

#: Tokens with their own entry in the tasks' table, at most.
HEAD = 1 << 16
#: Classes: the OWN most frequent tokens have one each, frequent ones share SHARED, endings the rest.
OWN, SHARED, ENDINGS = 10, 6, 16
CLASSES = OWN + SHARED + ENDINGS
#: Hashed feature slots of the class factor at least, rounds, tokens of a step, learning rate.
SLOTS, ROUNDS, STEP, RATE = 1 << 12, 2, 2048, 0.6
#: Tokens of a step and learning rate of the branches.
LEAF_STEP, LEAF_RATE = 512, 0.1
#: Either factor has as many weights as the power of two above the distinct tokens, within these powers.
LEAST_BITS, MOST_BITS = (SLOTS * CLASSES).bit_length() - 1, 21
#: Distinct tokens outside the table for each leaf they share, and weights of a row that a task sends.
SHARING, BLOCK = 64, 1 << 13
#: CRC-32 of every byte, as ``zlib`` has it.
CRC = ~np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) for i in range(256)], np.uint32)
#: The end token; no word is empty.
END = b""
#: Distinct tokens of a partition, on average, up to which counts are joined by a hash table; above it, by sorting.
HASHED = 1 << 20
#: Bytes of distinct tokens that a task holds while it counts.
COUNTED = 1 << 25
#: Places without a token before every text, as many as features look back; texts are read together up to so many tokens.
BEFORE, TOGETHER = 3, 1 << 17
LOG10 = np.log(10.0)


def words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Numbers of the words of the texts (binary), and all words in order, lower-cased; the end tokens are left out."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    flat = split.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)  # white space at either end leaves an empty piece
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy()]
    return np.diff(before), flat.filter(real).view(pa.binary()).dictionary_encode()


def names_of(found: pa.DictionaryArray) -> list[bytes]:
    """The distinct words; joining and splitting them makes Python objects several times as fast as Arrow does."""
    names = found.dictionary
    return pc.binary_join(pa.ListArray.from_arrays([0, len(names)], names), b" ")[0].as_py().split()


def crc32s(tokens: pa.Array, last: int | None = None, long: int = 48) -> np.ndarray:
    """``zlib.crc32`` of all tokens (binary), or of their ``last`` bytes, a byte of all of them at a time."""
    offsets, data = (np.frombuffer(b or b"", t) for b, t in zip(tokens.buffers()[1:], (np.int32, np.uint8), strict=True))
    offsets = offsets[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
    ends, size = offsets[1:], np.minimum(np.diff(offsets), last or len(data))
    order = np.argsort(-np.minimum(size, long + 1).astype(np.int8), kind="stable")
    start, size = (ends - size)[order], size[order]
    crc = np.full(len(tokens), 0xFFFFFFFF, np.uint32)
    for at in range(min(long, size[0] if len(size) else 0)):
        n = np.searchsorted(-size, -at)
        crc[:n] = CRC[(crc[:n] ^ data[start[:n] + at]) & 0xFF] ^ (crc[:n] >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for i, at, n in zip(order.tolist(), start.tolist(), size[size > long].tolist(), strict=False):
        out[i] = zlib.crc32(data[at : at + n])
    return out


def ending_class(token: bytes) -> int:
    """Class of a token without an entry: by its last bytes."""
    return OWN + SHARED + zlib.crc32(token[-3:]) % ENDINGS


@dataclass
class Vocabulary:
    """Entries of the frequent tokens: class and count."""

    entry: dict[bytes, tuple[int, int]]

    def of(self, token: bytes) -> tuple[int, int]:
        return self.entry.get(token) or (ending_class(token), -1)

    @cached_property
    def arrays(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Tokens, classes and counts of the entries, in their order."""
        kind, count = (np.array([e[i] for e in self.entry.values()], np.int64) for i in (0, 1))
        return pa.array(list(self.entry), pa.binary()), kind.astype(np.int32), count


def plain(array: np.ndarray) -> np.ndarray:
    """A copy with numpy's own dtype object.

    An array out of a pickle, so out of a broadcast, brings another one, and ``np.add.at`` then takes some tens of times as long.
    """
    return array.astype(array.dtype.type)


@dataclass
class Tree:
    """Leaves of every class in a row, and the branches above each of them.

    A branch is named by the first leaf on its right side, which no other branch shares.
    """

    place: dict[bytes, int]  #: leaf of a frequent token
    shared: list[int]  #: first shared leaf of every class of endings
    bits: int  #: of the hash that tells the shared leaves of a class apart
    first: np.ndarray  #: where the branches above each leaf start in ``above``
    size: np.ndarray  #: number of those of each leaf
    above: np.ndarray
    odds: np.ndarray  #: log odds of the right side, by the counts alone
    room: np.ndarray  #: log of what the counts of a leaf add up to

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = {k: plain(x) if isinstance(x, np.ndarray) else x for k, x in state.items()}


def branches(weight: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``first``, ``above`` and ``odds`` of a tree; ``classes`` are the places where the leaves of a class start, and the end.

    Every run of leaves is split where its halves come nearest to equal weight.
    """
    total = np.concatenate([[0.0], np.cumsum(weight)])
    odds, leaves, above = np.zeros(len(weight)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    low, high = classes[:-1], classes[1:]
    while (many := high - low > 1).any():
        low, high = low[many], high[many]
        half = (total[low] + total[high]) / 2
        at = np.searchsorted(total, half)
        at = np.clip(at - (half - total[at - 1] < total[at] - half), low + 1, high - 1)
        odds[at] = np.log((total[high] - total[at]) / (total[at] - total[low]))
        size = high - low
        leaves.append(np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum()))
        above.append(np.repeat(at, size))
        low, high = np.concatenate([low, at]), np.concatenate([at, high])
    leaf = np.concatenate(leaves)
    order = np.argsort(leaf, kind="stable")
    first = np.searchsorted(leaf[order], np.arange(len(weight) + 1))
    return first, np.concatenate(above)[order].astype(np.int32), odds.astype(np.float32)


def tree_of(vocabulary: Vocabulary, sums: np.ndarray, kinds: np.ndarray) -> Tree:
    """The tree of a vocabulary; ``sums`` and ``kinds`` are the counts and distinct tokens of the shared leaves (class, leaf)."""
    bits = sums.shape[1].bit_length() - 1
    # within a class, neighbours have like endings
    head = sorted(vocabulary.entry.items(), key=lambda e: (e[1][0], e[0][::-1]))
    held = np.bincount([kind for _, (kind, _) in head], minlength=CLASSES).astype(np.int64)
    size = held + np.repeat([0, sums.shape[1]], [OWN + SHARED, ENDINGS])
    classes = np.concatenate([[0], np.cumsum(size)])
    shared = (classes[:-1] + held)[OWN + SHARED :]
    before = np.cumsum(held) - held
    place = {token: int(classes[kind] + i - before[kind]) for i, (token, (kind, _)) in enumerate(head)}
    weight = np.zeros(classes[-1])
    weight[list(place.values())] = [c + 0.5 for _, (_, c) in head]
    weight[shared[:, None] + np.arange(sums.shape[1])] = sums + 0.5 * (kinds + 1)
    first, above, odds = branches(weight, classes)
    return Tree(place, shared.tolist(), bits, first, np.diff(first), above, odds, np.log(weight))


def count_tokens(docs: DataFrame, text: str = "text", room: int = 200_000) -> DataFrame:
    """``token`` (binary) and ``c`` over all rows, combined in the tasks before the shuffle."""
    small_batches(docs.sparkSession)

    def full(held: list[pa.RecordBatch], times: int) -> bool:
        return sum(map(len, held)) > times * room or sum(x.nbytes for x in held) > times * COUNTED

    def summed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sums = pa.Table.from_batches(held).group_by("token", use_threads=False).aggregate([("c", "sum")]).combine_chunks()
        return pa.RecordBatch.from_arrays([x.combine_chunks() for x in (sums["token"], sums["c_sum"])], ["token", "c"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for texts in together(batch.column(0)):
                sizes, found = words(pa.array(texts, pa.binary()))
                tokens = pa.concat_arrays([found.dictionary, pa.array([END], pa.binary())])
                c = np.append(np.bincount(found.indices, minlength=len(found.dictionary)), len(sizes))
                held.append(pa.RecordBatch.from_arrays([tokens, pa.array(c, pa.int64())], ["token", "c"]))
                if full(held, 2):
                    held = [summed(held)]
                    if full(held, 1):
                        yield held.pop()
        if held:
            yield summed(held)

    return docs.select(octets(F.col(text)).alias("text")).mapInArrow(task, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int = HEAD) -> Vocabulary:
    """The most frequent tokens, at most ``most``: those from the smallest count on that leaves so many.

    Counts are looked at in steps of an eighth of a power of two, so the table of steps has a few
    hundred rows and only tokens of the result are collected.
    """
    step = F.floor(F.log2(F.col("c").cast("double")) * 8)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in sizes:
        total += row["n"]
        if total > most:
            break
        least = row["least"]
    top = [] if least is None else sorted(counts.where(F.col("c") >= least).collect(), key=lambda r: (-r["c"], bytes(r["token"])))
    entry = {}
    for i, (token, c) in enumerate(top):
        kind = i if i < OWN else OWN + int(np.log2(i / OWN)) if i < OWN << SHARED else ending_class(bytes(token))
        entry[bytes(token)] = (kind, c)
    return Vocabulary(entry)


class Reader:
    """Turns texts into arrays of classes and hashes; every distinct token of the texts read together is looked at once."""

    def __init__(self, vocabulary: Vocabulary, tree: Tree | None = None) -> None:
        self.head, self.head_kind, self.head_count = vocabulary.arrays
        self.tree = tree
        self.head_leaf = None if tree is None else np.fromiter(map(tree.place.__getitem__, vocabulary.entry), np.int32, len(vocabulary.entry))

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of all texts among ``names``, from 1, zeros before each text, and where each text starts."""
        sizes, found = words(pa.array(texts, pa.binary()))
        starts = np.cumsum(sizes + 1 + BEFORE) - sizes - 1
        self.names = pa.concat_arrays([found.dictionary, pa.array([END], pa.binary())])
        ids = np.zeros(len(found) + len(texts) * (BEFORE + 1), np.int64)
        ids[starts + sizes] = len(self.names)
        ids[np.arange(len(found)) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)] = found.indices.to_numpy() + 1
        place = pc.index_in(self.names, value_set=self.head).fill_null(-1).to_numpy()
        known, rare = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        entry = place[known]
        self.kind, self.count, self.hash, self.leaf = (np.full(len(place) + 1, x, t) for x, t in ((-1, np.int32), (-1, np.int64), (0, np.uint32), (0, np.int32)))
        self.hash[1:] = crc32s(self.names)
        self.kind[known + 1], self.count[known + 1] = self.head_kind[entry], self.head_count[entry]
        self.kind[rare + 1] = OWN + SHARED + crc32s(self.names.take(pa.array(rare)), 3) % ENDINGS
        if self.tree is not None:
            self.leaf[known + 1] = self.head_leaf[entry]
            self.leaf[rare + 1] = np.array(self.tree.shared)[self.kind[rare + 1] - OWN - SHARED] + (self.hash[rare + 1].astype(np.int64) >> 32 - self.tree.bits)
        return ids, starts


def together(column: pa.Array) -> Iterator[list[bytes]]:
    """Texts of a batch, as many at once as hold about ``TOGETHER`` tokens."""
    texts, size = [], 0
    for t in column:
        texts.append(t.as_py())
        size += len(texts[-1])
        if size > 6 * TOGETHER:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


MIX = np.uint32(2654435761)


def features(kind: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of the feature templates (rows) at every position, from the tokens before it."""
    n = len(hashes)
    h1, h2, k = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros((3, n), np.uint32)
    h1[1:], h2[2:] = hashes[:-1], hashes[:-2]
    for back in range(1, 4):
        k[back - 1, back:] = kind[:-back] + 1
    return np.stack([h1, h2 ^ np.uint32(0x9E3779B9), (h1 * np.uint32(31)) ^ (h2 * MIX) ^ np.uint32(0x85EBCA6B), (k[0] * np.uint32(64) + k[1]) * np.uint32(64) + k[2] + np.uint32(1 << 20)])


def slots_of(hashed: np.ndarray, slots: int) -> np.ndarray:
    """Slots of hashed features, of a power of two."""
    return ((hashed * MIX) >> np.uint32(33 - slots.bit_length())).astype(np.int64)


def feature_slots(kind: np.ndarray, hashes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Slots of the feature templates (rows) at every position."""
    return slots_of(features(kind, hashes), slots)


def positions(reader: Reader, ids: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes, feature slots, leaves and hashed features of the positions that hold a token."""
    kind, real = reader.kind.take(ids), np.flatnonzero(ids)
    hashed = features(kind, reader.hash.take(ids)).take(real, axis=1)
    return kind.take(real), slots_of(hashed, slots), reader.leaf.take(ids.take(real)), hashed


def margins(weights: np.ndarray, tree: Tree, leaf: np.ndarray, hashed: np.ndarray, each: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all branches above the leaves, one after another: where those of each leaf end, the side (1 or -1) of the leaf, their slots (feature, branch), the log odds of that side.

    A slot has ``each`` numbers in ``weights``, the first of them its weight.
    """
    low = tree.first.take(leaf)
    size = tree.size.take(leaf)
    ends = size.cumsum()
    owner = np.arange(len(leaf)).repeat(size)
    low -= ends
    low += size
    entry = low.take(owner)
    entry += np.arange(len(owner))
    branch = tree.above.take(entry)
    side = (leaf.take(owner) >= branch).astype(np.float32)
    side += side
    side -= 1
    mixed = hashed.take(owner, axis=1)
    mixed += branch.view(np.uint32) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    slots = slots_of(mixed, len(weights) // each)
    if each > 1:
        slots *= each
    z = tree.odds.take(branch)
    for w in weights.take(slots):
        z += w
    z *= side
    return ends, side, slots, np.clip(z, -80, 80, out=z)


def log_leaves(weights: np.ndarray, tree: Tree, leaf: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Log probabilities of the leaves within their classes."""
    ends, _, _, z = margins(weights, tree, leaf, hashed)
    z = np.log(1 + np.exp(np.negative(z, out=z), out=z), out=z)
    # one more, as a leaf without branches may be the last
    starts = np.append(0, ends)
    return -np.add.reduceat(np.append(z, np.float32(0)), starts[:-1], dtype=np.float64) * (starts[:-1] < ends)


def leaf_step(held: np.ndarray, tree: Tree, leaf: np.ndarray, hashed: np.ndarray) -> None:
    """One gradient step of the branches above the leaves given, in place.

    ``held`` has the weight and the squared gradients of every slot side by side, so that memory is read once for both.
    """
    _, side, slots, z = margins(held, tree, leaf, hashed, 2)
    grad = side / (1 + np.exp(z, out=z))
    twice, squares = grad * grad, slots + 1
    for s in squares:
        np.add.at(held, s, twice)
    grad *= np.float32(LEAF_RATE)
    change = held.take(squares)
    np.divide(grad, np.sqrt(change, out=change), out=change)
    for s, c in zip(slots, change, strict=True):
        np.add.at(held, s, c)


def log_classes(weights: np.ndarray, bias: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Log probabilities (position, class) from the sparse features of every position."""
    z = weights.take(slots[0], axis=0)
    for s in slots[1:]:
        z += weights.take(s, axis=0)
    z += bias
    z -= np.ascontiguousarray(z.T).max(0)[:, None]  # several times as fast as along short rows
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def totals(rows: np.ndarray, order: np.ndarray, first: np.ndarray, few: int = 8) -> np.ndarray:
    """Sums of runs of ``rows`` taken in ``order``; ``first`` is where the runs start.

    Most runs are short, and those of at most ``few`` rows are added row by row, in the order in which ``reduceat`` adds them.
    """
    size = np.diff(first, append=len(order))
    total = rows.take(order[first], axis=0)
    left, more = np.flatnonzero((size > 1) & (size <= few)), np.flatnonzero(size > few)
    if len(left):
        rest = rows.take(order[first[left] + 1], axis=0)
        for at in range(2, few):
            held = np.flatnonzero(size[left] > at)
            rest[held] += rows.take(order[first[left[held]] + at], axis=0)
        total[left] += rest
    if len(more):
        each = size[more]
        starts = np.cumsum(each) - each
        run = np.arange(each.sum()) + np.repeat(first[more] - starts, each)
        total[more] = np.add.reduceat(rows.take(order[run], axis=0), starts, axis=0)
    return total


def step(weights: np.ndarray, square: np.ndarray, bias: np.ndarray, slots: np.ndarray, kind: np.ndarray) -> None:
    """One gradient step on the positions given, in place; ``square`` holds the squared gradients of the slots."""
    grad = log_classes(weights, bias, slots)
    np.exp(grad, out=grad)
    grad[np.arange(len(kind)), kind] -= 1
    # sorting slot and place as one number is several times as fast as an argsort
    flat = np.sort(slots.ravel() << 32 | np.arange(slots.size))
    order = (flat & 0xFFFFFFFF) % len(kind)
    flat >>= 32
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    total, hit = totals(grad, order, first), flat[first]
    seen = square.take(hit) + np.einsum("ij,ij->i", total, total)
    square[hit] = seen
    total *= (-RATE / np.sqrt(seen))[:, None]
    total += weights.take(hit, axis=0)
    weights[hit] = total


def changes(start: np.ndarray, weights: np.ndarray, square: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Changes of a task and the squared gradients of their slots, in half precision, as rows of ``BLOCK`` weights."""
    change = np.split((weights - start).astype(np.float16).ravel(), weights.size // BLOCK)
    seen = np.split(np.minimum(square - 1, 6e4).astype(np.float16), len(change))
    for i in range(len(change)):
        if seen[i].any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block + i], pa.int32()), pa.array([change[i].tobytes()], pa.binary()), pa.array([seen[i].tobytes()], pa.binary())], ["block", "change", "seen"])


def mean_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean change of every weight of the blocks of a partition, weighted by the squared gradients."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, change, seen in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            weight = np.frombuffer(seen.as_buffer(), np.float16).astype(np.float32)
            part = np.frombuffer(change.as_buffer(), np.float16).reshape(len(weight), -1) * weight[:, None]
            held = sums.setdefault(block, [np.zeros(part.shape, np.float32), np.zeros(len(weight), np.float32)])
            held[0] += part
            held[1] += weight
    for block, (part, weight) in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([(part / np.where(weight > 0, weight, 1)[:, None]).tobytes()], pa.binary())], ["block", "change"])


def train(docs: DataFrame, vocabulary: Vocabulary, tree: Tree, bias: np.ndarray, slots: int, text: str = "text", rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (slot, class) of the class factor and (slot) of the branches after one pass over all rows of ``docs``."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    weights = np.zeros((slots, CLASSES), np.float32), np.zeros(slots * CLASSES, np.float32)
    blocks = slots * CLASSES // BLOCK
    shared = spark.sparkContext.broadcast((vocabulary, tree))
    share = F.floor(unit(F.xxhash64(F.col(text), F.lit("round"))) * rounds)
    for r in range(rounds):
        start = spark.sparkContext.broadcast(weights)

        def task(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            (vocabulary, tree), of_class, log_shares = shared.value, plain(start.value[0]), plain(bias)
            class_square, of_branch = np.ones(slots, np.float32), np.ones((slots * CLASSES, 2), np.float32)
            of_branch[:, 0] = start.value[1]
            reader, seen = Reader(vocabulary, tree), 0
            for batch in batches:
                for texts in together(batch.column(0)):
                    kind, found, leaf, hashed = positions(reader, reader.read(texts)[0], slots)
                    for at in range(0, len(kind), STEP):
                        step(of_class, class_square, log_shares, found[:, at : at + STEP], kind[at : at + STEP])
                    for at in range(0, len(kind), LEAF_STEP):
                        leaf_step(of_branch.ravel(), tree, leaf[at : at + LEAF_STEP], hashed[:, at : at + LEAF_STEP])
                    seen += len(kind)
            if seen:
                yield from changes(start.value[0], of_class, class_square, 0)
                yield from changes(start.value[1], *of_branch.T, blocks)

        rows = docs.where(share == r).select(octets(F.col(text)).alias("text"))
        parts = rows.mapInArrow(task, "block int, change binary, seen binary")
        flat = [w.copy().ravel() for w in weights]
        for row in parts.repartition("block").mapInArrow(mean_changes, "block int, change binary").toLocalIterator():
            table, place = divmod(row["block"], blocks)
            flat[table][place * BLOCK : (place + 1) * BLOCK] += np.frombuffer(row["change"], np.float32)
        weights = flat[0].reshape(slots, CLASSES), flat[1]
        start.unpersist()
    return weights


def leaf_totals(counts: DataFrame, vocabulary: Vocabulary, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token counts of every class; token counts and distinct tokens of the shared leaves (class, leaf)."""
    leaves = ENDINGS << bits

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES + 2 * leaves)
        for batch in batches:
            tokens, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            found = [vocabulary.of(t) for t in tokens]
            total[:CLASSES] += np.bincount([kind for kind, _ in found], c, minlength=CLASSES)
            rare = np.array([i for i, (_, count) in enumerate(found) if count < 0], np.int64)
            leaf = np.array([(found[i][0] - OWN - SHARED << bits) + (zlib.crc32(tokens[i]) >> 32 - bits) for i in rare], np.int64)
            total[CLASSES : CLASSES + leaves] += np.bincount(leaf, c[rare], minlength=leaves)
            total[CLASSES + leaves :] += np.bincount(leaf, minlength=leaves)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "data"])

    sums = added(counts.select("token", "c").mapInArrow(task, "slot int, data binary"), 1).get(0, np.zeros(CLASSES + 2 * leaves))
    return sums[:CLASSES], *sums[CLASSES:].reshape(2, ENDINGS, 1 << bits)


def slots_for(vocabulary: int) -> int:
    """Slots of the class factor; the branches have ``CLASSES`` times as many, of one weight each."""
    return (1 << min(max(vocabulary.bit_length(), LEAST_BITS), MOST_BITS)) // CLASSES


def model_of(training: DataFrame, text: str = "text", rounds: int = ROUNDS, head: int = HEAD) -> tuple[DataFrame, np.ndarray, tuple[Vocabulary, Tree, np.ndarray, np.ndarray]]:
    """Token counts, log shares of the classes, and the model: vocabulary, tree, weights of classes and of branches."""
    small_batches(training.sparkSession)
    counts = written(count_tokens(training, text))
    v = counts.count()
    vocabulary = head_of(counts, head)
    rare = max(1, (v - len(vocabulary.entry)) // (SHARING * ENDINGS))  # shared leaves of a class, before rounding down
    sums, *leaves = leaf_totals(counts, vocabulary, rare.bit_length() - 1)
    tree = tree_of(vocabulary, *leaves)
    bias = np.log((sums + 0.5) / (sums + 0.5).sum()).astype(np.float32)
    return counts, bias, (vocabulary, tree, *train(training, vocabulary, tree, bias, slots_for(v), text, rounds))


def lm_scores(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, head: int = HEAD) -> DataFrame:
    """``key``, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``, learned from ``training``."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    counts, bias, learned = model_of(training, text, rounds, head)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    slots = slots_for(v)
    model = spark.sparkContext.broadcast(learned)
    kind = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, tree, of_class, of_branch = model.value
        of_class, of_branch, log_shares = map(plain, (of_class, of_branch, bias))
        reader, row = Reader(vocabulary, tree), TaskContext.get().partitionId() << 33
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in batches:
            done = 0
            for texts in together(batch.column(1)):
                ids, starts = reader.read(texts)
                kind, found, leaf, hashed = positions(reader, ids, slots)
                logs = -tree.room[leaf]
                for at in range(0, len(kind), STEP):
                    part = log_classes(of_class, log_shares, found[:, at : at + STEP])
                    logs[at : at + STEP] += part[np.arange(len(part)), kind[at : at + STEP]]
                    logs[at : at + STEP] += log_leaves(of_branch, tree, leaf[at : at + STEP], hashed[:, at : at + STEP])
                starts = starts - BEFORE * np.arange(1, len(starts) + 1)
                ids = ids[ids > 0]
                n = np.diff(np.append(starts, len(ids)))
                count = reader.count[ids]
                known = np.add.reduceat((count >= 0).astype(np.int64), starts)
                base = np.add.reduceat(np.where(count >= 0, np.log10(np.maximum(count, 0) + 0.5), 0.0), starts)
                owner = np.repeat(np.arange(len(texts)), n)[count < 0]
                pair, times = np.unique(owner << 32 | ids[count < 0], return_counts=True)
                rare = pa.StructArray.from_arrays([reader.names.take(pa.array((pair & 0xFFFFFFFF) - 1)), pa.array(times, pa.int64())], ["token", "times"])
                offsets = pa.array(np.searchsorted(pair >> 32, np.arange(len(texts) + 1)), pa.int32())
                columns = [np.arange(row, row + len(texts)), n, known, base, np.add.reduceat(logs, starts) / LOG10]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(texts)), *[pa.array(x, t) for x, t in zip(columns, types, strict=True)], pa.ListArray.from_arrays(offsets, rare)],
                    ["key", "row", "n", "known", "logs", "parts", "rare"])
                row, done = row + len(texts), done + len(texts)

    rows = docs.select(F.col(key).alias("key"), octets(F.col(text)).alias("text"))
    rows = written(rows.mapInArrow(task, f"key {kind}, row long, n long, known long, logs double, parts double, rare array<struct<token: binary, times: long>>"))
    # a token of these pairs has no entry, so none is hot; a hash table of a partition's tokens spares sorting all pairs
    few = v <= HASHED * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select("row", F.inline("rare")).join(counts.hint("shuffle_hash") if few else counts, "token", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("also"))
    out = rows.drop("rare").join(found, "row", "left")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n") * float(np.log10(n + 0.5 * (v + 1)))).alias("base_score"), (logs + F.col("parts")).alias("score"))


@query("op4_lm_scores")
def op4_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = lm_scores(docs, docs.where(crc_fold(F.col("doc_id"), 5) != 1))
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
