"""Near-duplicate documents by SimHash, compared in bit slices.

A document's fingerprint has a bit set where more than half of the hashes of
its word shingles have it set.  Fingerprints link at ``radius`` or fewer
differing bits, and documents that are linked over any number of steps form one
group.

Copies share a fingerprint and are one node.  Fingerprints that differ in r
bits agree in at least ``BLOCKS - r`` of the ``BLOCKS`` parts into which their
bits are cut, so each choice of that many parts is a table whose buckets hold
every link.  A bucket of one is dropped before any row moves on; one with more
than ``CELL`` fingerprints is cut into chunks, and each pair of chunks is a cell of
its own.  A task compares the cells it is dealt and returns, for each
fingerprint, the smallest one it reaches within the cell: at most one row per
fingerprint and cell, however dense the cell is.

Defined results: a null text counts as an empty one and has fingerprint zero,
which links like any other; repeated rows are copies of each other; a group
whose ids are all null has a null component; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytewake.llm.common import add_columns, free_names, texts
from bytewake.llm.components import components
from bytewake.staging import Stage

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
CELL = 1024
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)
#: hashes whose bits are counted at once
HASHES = 50_000
#: (fingerprint, block) words that are updated at once
WORDS = 1 << 20
#: bits between two looks at which blocks are out of reach
ABANDON = 8


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only the six white-space characters split
    if not words:
        return []
    whole = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(whole, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return [xxhash.xxh64_intdigest(whole[a:b - 1], SEED) for a, b in zip(starts, ends[size - 1:])]


def simhash(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprint of each list; no hash gives zero."""
    counts = np.zeros((len(hashes), 64), np.int64)
    flat = np.fromiter((h for one in hashes for h in one), np.uint64)
    owner = np.repeat(np.arange(len(hashes)), [len(one) for one in hashes])
    for at in range(0, len(flat), HASHES):
        bits = np.unpackbits(flat[at:at + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at:at + HASHES]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    majority = 2 * counts > np.array([len(one) for one in hashes], np.int64).reshape(-1, 1)
    return np.packbits(majority, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Documents with their fingerprint as a signed 64-bit integer."""

    def make():
        def columns(part: pa.RecordBatch) -> list[pa.Array]:
            return [pa.array(simhash([shingle_hashes(t) for t in texts(part, text)]).view(np.int64), pa.int64())]

        return columns

    return add_columns(docs, text, [T.StructField(name, T.LongType())], make)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class Slices:
    """Fingerprints of many cells, stored as bit planes of blocks of 64."""

    def __init__(self, fps: np.ndarray, cells: np.ndarray):
        self.fps = fps
        n = len(fps)
        starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        sizes = np.diff(np.concatenate([starts, [n]]))
        place = np.arange(n) - np.repeat(starts, sizes)
        per_cell = -(-sizes // 64)
        first_block = np.concatenate([[0], np.cumsum(per_cell)[:-1]])
        self.block = np.repeat(first_block, sizes) + place // 64  # of each row
        self.left = np.repeat(first_block + per_cell, sizes) - self.block  # blocks from its own one on
        self.block_start = np.flatnonzero(place % 64 == 0)
        lane = (place % 64).astype(np.uint64)
        gather = lambda bits: np.bitwise_or.reduceat(bits << lane, self.block_start)
        self.planes = [gather((fps >> np.uint64(b)) & ONE) for b in range(64)]
        self.lanes = gather(np.full(n, ONE))

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows i < j of one cell within the radius, a batch at a time."""
        ends = np.cumsum(self.left)
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + WORDS, "right")))
            row = np.repeat(np.arange(at, to), self.left[at:to])
            block = self.block[row] + np.arange(len(row)) - np.repeat(ends[at:to] - self.left[at:to] - done, self.left[at:to])
            yield self._near(row, block, radius)
            at = to

    def _near(self, row: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        counters = [np.zeros(len(row), np.uint64) for _ in range(radius.bit_length())]
        over = ~self.lanes[block]
        for b in range(64):
            carry = self.planes[b][block] ^ (np.uint64(0) - ((self.fps[row] >> np.uint64(b)) & ONE))
            for c in counters:
                carry_on = c & carry
                c ^= carry
                carry = carry_on
            over |= carry
            if b % ABANDON == ABANDON - 1 and len(row):
                alive = over | self._beyond(counters, radius) != ALL
                row, block, over = row[alive], block[alive], over[alive]
                counters = [c[alive] for c in counters]
        near = ~(over | self._beyond(counters, radius))
        lanes = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        entry, lane = np.nonzero(lanes)
        i, j = row[entry], self.block_start[block[entry]] + lane
        later = j > i
        return i[later], j[later]

    @staticmethod
    def _beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
        """Lanes whose counter exceeds the radius, bit by bit from the top."""
        more, same = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
        for k in reversed(range(len(counters))):
            if radius >> k & 1:
                same &= counters[k]
            else:
                more |= same & counters[k]
                same &= ~counters[k]
        return more


def local_roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row that each of ``n`` rows reaches."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = root[i], root[j]
            open_ = a != b
            if not open_.any():
                break
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (nxt := root[root]).tobytes() != root.tobytes():
                root = nxt
    return root


def cell_links(fps: np.ndarray, cells: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints sorted by cell and value: those that reach a smaller one in their cell, and that one."""
    root = local_roots(len(fps), Slices(fps, cells).links(radius))
    moved = root != np.arange(len(root))
    return fps[moved], fps[root[moved]]


def buckets(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(table, key, fp): one row for each choice of parts that must agree."""
    width = 64 // blocks
    part = lambda b: F.shiftrightunsigned(F.col("fp"), b * width).bitwiseAND((1 << width) - 1)
    keys = []
    for chosen in combinations(range(blocks), blocks - radius):
        key = F.lit(0).cast("long")
        for b in chosen:
            key = F.shiftleft(key, width).bitwiseOR(part(b))
        keys.append(key)
    return fps.select("fp", F.posexplode(F.array(*keys)).alias("table", "key"))


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Pairs (node, other) that connect distinct fingerprints ``fp`` exactly as their links do."""
    rows = buckets(fps, radius, blocks)
    shared = rows.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1")
    n_chunks = F.ceil(F.col("size") / cell)
    dealt = (
        rows.join(shared, ["table", "key"])
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), n_chunks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)))
        .select("fp", F.xxhash64("table", "key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, cells = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in _and_end(batches):
            if batch is not None:
                fp = np.concatenate([fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
                cells = np.concatenate([cells, batch.column("cell").to_numpy(zero_copy_only=False)])
                # the last cell may go on in the next batch
                whole = int(np.searchsorted(cells, cells[-1], "left")) if len(cells) else 0
            else:
                whole = len(cells)
            if whole:
                node, other = cell_links(fp[:whole], cells[:whole], radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), pa.array(other.view(np.int64))], names=["node", "other"])
                fp, cells = fp[whole:], cells[whole:]

    return (
        dealt.repartition("cell").sortWithinPartitions("cell", "fp")
        .mapInArrow(run, "node long, other long").distinct()
    )


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def group(docs: DataFrame, stage: Stage, doc_id: str = "doc_id", fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) for every fingerprint of ``docs``, which must lie in a table."""
    first = stage(docs.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("first_id")), "fingerprints")
    linked = stage(links(first.select("fp"), radius), "links")
    roots = components(linked, stage)
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, stage: Stage, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One row per document: its id, fingerprint in hexadecimal, and component_id."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = stage(fingerprint(narrow).select("doc_id", "fp"), "documents")
    return found.join(group(found, stage, radius=radius), "fp").select(
        "doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(
    docs: DataFrame, stage: Stage, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One document of each group, one with the smallest id, with the columns it came with, whatever they are called."""
    mark, row = free_names(docs, "_fp", "_row")
    marked = stage(fingerprint(docs, text, mark).withColumn(row, F.monotonically_increasing_id()), "documents")
    ids = marked.select(F.col(doc_id).alias("_id"), F.col(mark).alias("_fp"), F.col(row).alias("_row"))
    grouped = ids.join(group(ids, stage, "_id", "_fp", radius), F.col("_fp") == F.col("fp"))
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("first"))
    return marked.join(first.select(F.col("first._row").alias(row)), row, "left_semi").select(*docs.columns)
