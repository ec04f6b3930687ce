"""Benchmark decontamination by winnowing.

Every run of ``K`` words has a hash, and of each ``WINDOW`` neighbouring hashes
the smallest is a fingerprint.  The choice depends on those words alone, so two
texts that share ``K + WINDOW - 1`` words in a row (SPAN, ten) share a
fingerprint inside them.  Fingerprints of documents are joined with those of
the benchmark, and each hit is extended: all spans of ten words around it are
compared word by word.  Items of fewer than ten words are one window each and
are found by a hash of the whole item, for each length that occurs.

The benchmark side of the join is a set of blocks, each of at most about
``BLOCK_WINDOWS`` windows, whatever the size of the benchmark.  A usual
benchmark is one block and the documents pass once, without a shuffle; more
blocks are more passes over the documents and give the same rows.

Defined results: a null or empty text has no words, is never hit and hits
nothing; an item without an id marks words but is not listed or counted; an id
that occurs twice is listed once; equal documents get equal rows; with an empty
benchmark nothing is contaminated; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytewake.llm.common import add_columns, without

K = 5
WINDOW = 6
SPAN = K + WINDOW - 1
BLOCK_WINDOWS = 200_000

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SCRAMBLE = np.uint64(0xBF58476D1CE4E5B9)
STEP = np.uint64(0x94D049BB133111EB)

#: word bytes, lower-cased at A-Z; 0 for all others
FOLDED = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    FOLDED[_b] = _b
for _b in range(0x41, 0x5B):
    FOLDED[_b] = _b + 0x20


@dataclass
class Words:
    """The words of many texts in one buffer of folded bytes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray  # text that a word belongs to, ascending
    hash: np.ndarray

    def run(self, first: int, n: int) -> bytes:
        """``n`` words joined by one space."""
        return b" ".join(self.data[self.start[i]:self.end[i]].tobytes() for i in range(first, first + n))


def words_of(column: pa.Array) -> Words:
    """Words and their hashes, computed over the whole buffer at once."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = column.buffers()[2]
    data = FOLDED[np.frombuffer(raw, np.uint8)[low:high]] if high > low else np.zeros(0, np.uint8)
    bounds = offsets - low
    inside = data > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    with np.errstate(over="ignore"):
        power = np.full(len(data), BASE)
        back = np.full(len(data), BASE_INVERSE)
        if len(data):
            power[0] = back[0] = 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * np.cumprod(power), out=total[1:])
        hashed = (total[end] - total[start]) * np.cumprod(back)[start]
        hashed = (hashed ^ (hashed >> np.uint64(31))) * SCRAMBLE
        hashed ^= hashed >> np.uint64(29)
    owner = np.searchsorted(bounds, start, "right") - 1
    return Words(data, start, end, owner, hashed)


def gram_hashes(words: Words, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on; NONE where they leave the text."""
    size = len(words.hash)
    out = np.full(size, NONE)
    if size >= n:
        with np.errstate(over="ignore"):
            mixed = words.hash[:size - n + 1].copy()
            for j in range(1, n):
                mixed = (mixed ^ (mixed >> np.uint64(32))) * STEP + words.hash[j:size - n + 1 + j]
        whole = words.owner[:size - n + 1] == words.owner[n - 1:]
        out[:size - n + 1][whole] = np.minimum(mixed[whole], NONE - np.uint64(1))
    return out


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed runs; all of equal smallest ones are kept."""
    grams = gram_hashes(words, K)
    n = len(grams)
    padded = np.concatenate([np.full(WINDOW - 1, NONE), grams, np.full(WINDOW - 1, NONE)])
    least = np.min([padded[j:j + n + WINDOW - 1] for j in range(WINDOW)], axis=0)  # window that ends at each position
    chosen = grams != NONE
    chosen &= np.any([least[j:j + n] == grams for j in range(WINDOW)], axis=0)
    at = np.flatnonzero(chosen)
    return at, grams[at]


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, window) rows; a window is its words joined by one space."""
    source = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column("text"))
            first = np.searchsorted(words.owner, np.arange(batch.num_rows + 1))
            items, windows = [], []
            for i, name in enumerate(batch.column("item").to_pylist()):
                n = int(first[i + 1] - first[i])
                for at in range(max(n - SPAN, 0) + 1 if n else 0):
                    items.append(name)
                    windows.append(words.run(int(first[i]) + at, min(n, SPAN)))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(windows, pa.binary())], names=["item", "window"])

    return source.mapInArrow(run, "item string, window binary").distinct()


class Block:
    """Windows of the benchmark with what is needed to find them in documents."""

    def __init__(self, rows: list[tuple[str | None, bytes]]):
        self.items: dict[bytes, set[str]] = {}
        for item, window in rows:
            found = self.items.setdefault(bytes(window), set())
            if item is not None:
                found.add(item)
        words = words_of(pa.array([w.decode() for w in self.items], pa.string()))
        counts = np.bincount(words.owner, minlength=len(self.items))
        at, hashes = fingerprints(words)
        full = counts[words.owner[at]] == SPAN
        self.fingerprints = np.unique(hashes[full])
        first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        self.short = {
            int(n): np.unique(gram_hashes(words, int(n))[first[counts == n]]) for n in np.unique(counts) if 0 < n < SPAN
        }

    def starts(self, words: Words) -> Iterator[tuple[int, int]]:
        """(position, length) of spans worth comparing: around each shared fingerprint, and whole short items."""
        at, hashes = fingerprints(words)
        hits = at[np.isin(hashes, self.fingerprints)]
        around = np.unique((hits[:, None] - np.arange(WINDOW)[None, :]).ravel())
        around = around[(around >= 0) & (around + SPAN <= len(words.hash))]
        for p in around[words.owner[around] == words.owner[around + SPAN - 1]].tolist():
            yield p, SPAN
        for n, known in self.short.items():
            for p in np.flatnonzero(np.isin(gram_hashes(words, n), known)).tolist():
                yield p, n

    def mark(self, words: Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words are hit, and the items found in each text."""
        edges = np.zeros(len(words.hash) + 1, np.int64)
        found: dict[int, set[str]] = {}
        for p, n in self.starts(words):
            items = self.items.get(words.run(p, n))
            if items is not None:
                edges[p] += 1
                edges[p + n] -= 1
                found.setdefault(int(words.owner[p]), set()).update(items)
        return np.cumsum(edges[:-1]) > 0, found


STATE = [
    T.StructField("_leak_words", T.LongType()), T.StructField("_leak_hits", T.LongType()),
    T.StructField("_leak_mask", T.BinaryType()), T.StructField("_leak_items", T.ArrayType(T.StringType())),
]


def _pass(docs: DataFrame, block: Block, text: str, seen: bool) -> DataFrame:
    """One pass over the documents: adds the hits of a block to those of earlier passes."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        block = shared.value

        def columns(part: pa.RecordBatch) -> list[pa.Array]:
            words = words_of(part.column(text))
            counts = np.bincount(words.owner, minlength=part.num_rows)
            last = np.cumsum(counts)
            hit, found = block.mark(words)
            touched = np.flatnonzero(np.bincount(words.owner[hit], minlength=part.num_rows))
            hits = part.column("_leak_hits").to_pylist() if seen else [0] * part.num_rows
            masks = part.column("_leak_mask").to_pylist() if seen else [None] * part.num_rows
            items = part.column("_leak_items").to_pylist() if seen else [None] * part.num_rows
            for i in touched.tolist():
                own = np.packbits(hit[last[i] - counts[i]:last[i]])
                if masks[i]:
                    own |= np.frombuffer(masks[i], np.uint8)
                hits[i], masks[i] = int(np.unpackbits(own).sum()), own.tobytes()
                items[i] = sorted({*(items[i] or ()), *found.get(i, ())})
            return [
                pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(masks, pa.binary()),
                pa.array(items, pa.list_(pa.string())),
            ]

        return columns

    return add_columns(docs, text, STATE, make)


RESULT = ["n_words", "n_hit", "n_items", "items", "contaminated"]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    block_windows: int = BLOCK_WINDOWS, prefix: str = "",
) -> DataFrame:
    """Documents with the number of words inside benchmark windows and the items found, sorted as strings."""
    windows = benchmark_windows(benchmark, item, item_text)
    n_blocks = max(1, -(-windows.count() // block_windows))
    marked = docs
    for n in range(n_blocks):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == n).collect()  # about block_windows rows
        marked = _pass(marked, Block([(r["item"], r["window"]) for r in rows]), text, n > 0)
    names = [prefix + n for n in RESULT]
    items = F.coalesce("_leak_items", F.array().cast("array<string>"))
    return marked.select(
        *without(docs, names).columns, F.col("_leak_words").alias(names[0]), F.col("_leak_hits").alias(names[1]),
        F.size(items).cast("long").alias(names[2]), items.alias(names[3]), (F.col("_leak_hits") > 0).alias(names[4]),
    )


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that share no window with the benchmark, with the columns they came with."""
    return find_leaks(docs, benchmark, text, prefix="_leak_").where("NOT _leak_contaminated").select(*docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", items_digest(F.col("items")).alias("items_sha256"), "contaminated"
    )
