"""Documents whose sets of word n-grams overlap, by a prefix-tree join.

A document's set holds its distinct ``SIZE``-word shingles, or with fewer words
the whole sequence.  Two sets link at a Jaccard similarity of ``percent`` or
more, and documents that are linked over any number of steps form one
component.

Sets are ordered globally.  Sets that link share l shingles among the first
n - ceil(n * percent / 100) + l of each, in any order and for any l; l grows with
the size (``EXTRA``), so that a passage which is a small part of a document brings
nobody together.  Only sets with enough shingles there that another set has there
as well go on: first in the order of hashes, then, those that are left, with the
shingles last that ``COMMON`` of them or more have, the most common ones at the
very end.  So a passage that many documents share brings only those together whose
own words agree as well, and what a shingle brings together grows no further.

1.  they are placed in blocks of about ``BLOCK_BYTES``, sets that share a
    shingle together.  A cluster that needs several is dealt by the most common
    shingles whose sets fit into a block, or into ``FAR`` of them, so that sets
    which share much without linking meet in few blocks.  A block's sets form a
    prefix tree.  Each set walks
    the tree; a walk shares the overlap of a common beginning among all sets
    below it, and turns back where the shingles that remain on either side
    cannot make the overlap that the sizes below ask for, or where all sets
    below are known to be in its component.
2.  one set of each component found so far stands for it, in blocks of their
    own, as long as that leaves out a tenth of them, so that a large group of
    near copies has few standing for all.
3.  sets that share enough early shingles with sets of other components in another
    block visit that block's tree, the sets of the block with fewer sets the
    other one; a block with many visitors is dealt to several tasks, with its sets.

Copies are one set, and a task returns at most one row per set and component it
meets.  Nothing is capped, and no group is gathered whole.  Shingles are 64-bit
hashes and sets are known by 64-bit digests: two of n different sets share one
with a chance of n * n / 2^65.

Defined results: null text and text without words have an empty set, linked with
nothing, and are a component of their own; repeated rows are copies; a component
whose ids are all null has a null id; an empty table gives an empty one.  A very
long text is a step of its own and hashed in windows.  Other columns are not
read, so their names may clash with any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytewake.llm.common import steps
from bytewake.llm.components import components
from bytewake.llm.hashed_words import BLANK, mix, per_text, text_bytes, words
from bytewake.staging import Stage

SIZE = 4
PERCENT = 85
#: bytes of sets in a prefix tree, and of visitors that one task takes to it
BLOCK_BYTES = 2 << 20
VISIT_BYTES = 2 << 20
#: blocks that sets with a shingle may fill, for those of a large cluster to be dealt by it
FAR = 8
#: shingles of one node of a tree: a walk can turn back after so many
SEGMENT = 64
#: how many more shingles at the beginning of a set are looked at, in hundredths of its size
EXTRA = 6
#: sets that have a shingle, for it to come late in their order, and how many such shingles are sent to every task
COMMON = 16
SENT_SHINGLES = 1 << 20
#: parts in which shingles are counted, by their first bits; the 32 bits after them tell two shingles of a part apart
PARTS = 1 << 10
#: ids of documents or sets that are sent to every task; more are joined by shuffle, with the texts or sets
SENT_IDS = 2_000_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each of some runs."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)


def shingles(column: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every text, ascending, and where each text's begin and the last end."""
    data, bounds = text_bytes(column)
    starts, _, word = words(data, bounds, BLANK)
    begin = per_text(starts, bounds)
    n = np.diff(begin)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at, doc = ranges(begin[:-1], count), np.repeat(np.arange(len(n)), count)
    hashed, length = np.zeros(len(at), np.uint64), np.minimum(n, size)[doc]
    for j in range(size):
        more = length > j
        hashed[more] = mix(hashed[more] * _STEP + word[at[more] + j])
    begin = np.cumsum(count) - count
    for x, y in zip(begin.tolist(), (begin + count).tolist()):
        hashed[x:y].sort()
    fresh = np.ones(len(hashed), bool)
    fresh[1:] = hashed[1:] != hashed[:-1]
    fresh[begin[count > 0]] = True
    until = np.concatenate([[0], np.cumsum(fresh)])
    return hashed[fresh], np.append(until[begin], until[-1])


def digests(hashed: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A number for each set; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashed + _STEP), dtype=np.uint64)])
    n = np.diff(begin).astype(np.uint64)
    return np.where(n > 0, mix(total[begin[1:]] - total[begin[:-1]] + n), np.uint64(0)).view(np.int64)


def shared_at_least(n):
    """How many shingles a set of that size shares at the beginning with one that links, if both are ``beginning`` long."""
    return 1 + (n * EXTRA) // 100


def beginning(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - (n * percent + 99) // 100 + shared_at_least(n))


# -- passes over the documents ------------------------------------------------

def _sets(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                hashed, begin = shingles(part.column("text"), size)
                n = np.diff(begin)
                ends = begin[:-1] + beginning(n, percent)
                first = [hashed[a:b].tobytes() for a, b in zip(begin.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(digests(hashed, begin)), pa.array(n), pa.array(first, pa.binary())],
                    names=["doc_id", "node", "n", "first"])

    return run


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for part in steps(batch, "first"):
            node, first = part.column("node").to_pylist(), part.column("first").to_pylist()
            fresh = [i for i, x in enumerate(node) if x not in seen and (seen.add(x) or True)]  # copies in this task
            packed = [first[i] for i in fresh]
            count, at = np.array([len(x) // 8 for x in packed], np.int64), np.array(fresh, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.frombuffer(b"".join(packed), np.int64)),
                *(pa.array(np.repeat(np.asarray(part.column(c))[at], count)) for c in ("node", "n"))], names=["shingle", "node", "n"])


def _members(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                hashed, begin = shingles(part.column("text"), size)
                key = hashed.astype(">u8")  # bytes sort as the numbers do
                own = np.flatnonzero(digests(hashed, begin) == part.column("node").to_numpy(zero_copy_only=False))
                packed = [key[begin[i]:begin[i + 1]].tobytes() for i in own.tolist()]
                own = pa.array(own)
                yield pa.RecordBatch.from_arrays([part.column("node").take(own), pa.array(packed, pa.binary())], names=["node", "keys"])

    return run


# -- shingles that many sets have -----------------------------------------------

_LOW = np.uint64((1 << 32) - 1)


def _counted(hashed: np.ndarray) -> np.ndarray:
    """What shingles are counted by: the bits that name the part, and 32 more."""
    return hashed >> np.uint64(64 - 32 - PARTS.bit_length() + 1)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all sets, one after another, and how many each set has."""
    packed = column.to_pylist()
    return np.frombuffer(b"".join(packed), ">u8").astype(np.uint64), np.array([len(x) // 8 for x in packed], np.int64)


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets have each shingle, one row for each part and some of the sets."""
    for batch in batches:
        for piece in steps(batch, "keys"):
            value, times = np.unique(_counted(_unpacked(piece.column("keys"))[0]), return_counts=True)
            low, times = (value & _LOW).astype(np.uint32), times.astype(np.uint32)
            part, at = np.unique(value >> np.uint64(32), return_index=True)
            cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(value)]))
            yield pa.RecordBatch.from_arrays([
                pa.array(part.astype(np.int64)),
                *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (low, times))], names=["part", "low", "times"])


def _frequent(least: int) -> Callable[[pa.Table], pa.Table]:
    """Of one part the shingles that so many sets have, and the number of digits of their count."""
    def run(rows: pa.Table) -> pa.Table:
        low, times = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint32) for c in ("low", "times"))
        value, at = np.unique(low, return_inverse=True)
        count = np.bincount(at, weights=times).astype(np.int64)
        value, count = value[count >= least], count[count >= least]
        part = rows.column("part")[0].as_py() << 32
        return pa.table({"counted": part + value.astype(np.int64), "digits": np.frexp(count)[1].astype(np.int32)})

    return run


def _common(members: DataFrame, stage: Stage, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, ascending as they are counted, and the binary digits of their counts.

    No more than ``most``: where there are more, the rarer ones are left in the order of hashes.
    """
    tallies = members.select("keys").mapInArrow(_tallies, "part long, low binary, times binary")
    found = stage(tallies.groupBy("part").applyInArrow(_frequent(least), "counted long, digits int"), "common")
    lowest, size = 64, 0
    for row in sorted(found.groupBy("digits").count().collect(), reverse=True):
        size += row["count"]
        if size > most:
            break
        lowest = row["digits"]
    sent = found.where(F.col("digits") >= lowest).toArrow()
    counted, digits = sent.column("counted").to_numpy().astype(np.uint64), sent.column("digits").to_numpy().astype(np.int8)
    order = np.argsort(counted)
    return counted[order], digits[order]


def _rarest(common, percent: int):
    """Entries of the beginnings of sets, with common shingles last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, digits = common.value
        for batch in batches:
            for part in steps(batch, "keys"):
                hashed, n = _unpacked(part.column("keys"))
                late = np.zeros(len(hashed), np.int8)
                if len(counted):
                    value = _counted(hashed)
                    place = np.minimum(np.searchsorted(counted, value), len(counted) - 1)
                    late = np.where(counted[place] == value, digits[place], late)
                begin, count = np.cumsum(n) - n, beginning(n, percent)
                order = np.lexsort((late, np.repeat(np.arange(len(n)), n)))  # the hashes of a set ascend already
                first = hashed[order[ranges(begin, count)]].view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(first), *(pa.array(np.repeat(x, count)) for x in (part.column("node").to_numpy(), n))],
                    names=["shingle", "node", "n"])

    return run


# -- the prefix tree ----------------------------------------------------------

class Tree:
    """Ordered sets in a tree of their common beginnings; a node stands for a run of sets and some shingles."""

    def __init__(self, packed: list[bytes], percent: int):
        # in the order of their shingles, sets with a common beginning are neighbours
        self.order = sorted(range(len(packed)), key=packed.__getitem__)
        self.sets = [np.frombuffer(packed[i], ">u8").astype(np.uint64) for i in self.order]
        self.percent = percent
        self.n = np.array([len(s) for s in self.sets])
        self.keys = np.concatenate(self.sets)
        offset = np.cumsum(self.n) - self.n
        common = [0] + [self._common(a, b) for a, b in zip(self.sets, self.sets[1:])]
        common = np.array(common + [0])
        nodes, children, last = [], [], []
        stack = [(0, len(packed), 0, -1)]
        while stack:
            a, b, depth, parent = stack.pop()
            if parent >= 0 and self.n[a] == depth:  # ends at the parent
                last[parent] = a
                a += 1
                if a == b:
                    continue
            shared = int(common[a + 1:b].min()) if b - a > 1 else int(self.n[a])
            if shared > depth:
                end = min(shared, depth + SEGMENT)
                me = len(nodes)
                nodes.append((a, b, offset[a] + depth, end - depth, end))
                children.append([])
                last.append(-1)
                if parent >= 0:
                    children[parent].append(me)
                stack.append((a, b, end, me))
            else:  # the sets part here
                cuts = [a, *(np.flatnonzero(common[a + 1:b] == depth) + a + 1).tolist(), b]
                if len(cuts) > 2:
                    stack.extend((x, y, depth, parent) for x, y in zip(cuts, cuts[1:]))
        table = np.array(nodes, np.int64).reshape(-1, 5)
        self.a, self.b, self.at, self.count, self.depth = table.T
        self.last = np.array(last, np.int64)
        self.fewest = np.array([self.n[a:b].min() for a, b in zip(self.a, self.b)])
        self.most = np.array([self.n[a:b].max() for a, b in zip(self.a, self.b)])
        self.child_count = np.array([len(c) for c in children], np.int64)
        self.child_begin = np.cumsum(self.child_count) - self.child_count
        self.children = np.array([x for c in children for x in c], np.int64)
        below = np.zeros(len(nodes), bool)
        below[self.children] = True
        self.top = np.flatnonzero(~below)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    def enough(self, overlap, n, m):
        """Whether sets of sizes n and m with an overlap link."""
        return (100 + self.percent) * overlap >= self.percent * (n + m)

    def linked(self, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Of the wanted sets those that link with a set, as places in the tree's order."""
        n, found = len(keys), []
        until = np.concatenate([[0], np.cumsum(wanted)])
        front, overlap = self.top, np.zeros(len(self.top), np.int64)
        while len(front):
            some = until[self.b[front]] > until[self.a[front]]
            front, overlap = front[some], overlap[some]
            if not len(front):
                break
            count = self.count[front]
            own = self.keys[ranges(self.at[front], count)]
            place = np.searchsorted(keys, own)
            held = keys[np.minimum(place, n - 1)] == own
            ends = np.cumsum(count)
            overlap = overlap + np.add.reduceat(held.astype(np.int64), ends - count)
            depth = self.depth[front]
            rest = n - place[ends - 1] - held[ends - 1]  # of the walking set, after the node's last shingle
            size = np.clip(depth + rest, self.fewest[front], self.most[front])  # the size below that asks for least
            ok = self.enough(overlap + np.minimum(rest, size - depth), n, size)
            front, overlap, depth = front[ok], overlap[ok], depth[ok]
            last = self.last[front]
            hit = (last >= 0) & self.enough(overlap, n, depth)
            found.extend(x for x in last[hit].tolist() if wanted[x])
            below = self.child_count[front]
            overlap = np.repeat(overlap, below)
            front = self.children[ranges(self.child_begin[front], below)]
        return np.array(found, np.int64)

    def groups(self) -> np.ndarray:
        """For each set of the tree's order the first set of its component within the tree."""
        group = np.full(len(self.sets), -1)
        wanted = np.ones(len(self.sets), bool)
        for first in range(len(self.sets)):
            if not wanted[first]:
                continue
            wanted[first], group[first] = False, first
            waiting = [first]
            while waiting:
                near = self.linked(self.sets[waiting.pop()], wanted)
                wanted[near], group[near] = False, first
                waiting.extend(near.tolist())
                if not wanted.any():
                    return group
        return group


Rows = list[tuple[int, bytes]]


def _within(percent: int) -> Callable:
    """Links within a block: each set and the least of its component there."""
    def links(members: Rows, visitors: Rows) -> Iterator[tuple[int, int]]:
        if len(members) > 1:
            tree = Tree([keys for _, keys in members], percent)
            names = np.array([members[i][0] for i in tree.order])
            yield from zip(names.tolist(), names[tree.groups()].tolist())

    return links


def _across(percent: int) -> Callable:
    """Links of visitors with a block: each visitor and one set of every component there that it links with."""
    def links(members: Rows, visitors: Rows) -> Iterator[tuple[int, int]]:
        tree = Tree([keys for _, keys in members], percent)
        names, group = [members[i][0] for i in tree.order], tree.groups()
        firsts = np.unique(group)
        for name, packed in visitors:
            keys = np.frombuffer(packed, ">u8").astype(np.uint64)
            wanted = np.isin(np.arange(len(names)), firsts)
            near = tree.linked(keys, wanted)  # the first set of a component answers for most of it
            wanted = ~np.isin(group, near)
            for i in (*near.tolist(), *np.unique(group[tree.linked(keys, wanted)]).tolist()):
                yield name, names[i]

    return links


def _by_block(links: Callable) -> Callable:
    """Hands the rows of one (block, share) after another, which lie together, to a function."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, visitors = None, {}, {}

        def answer() -> pa.RecordBatch:
            pairs = [(a, b) for a, b in links(list(members.items()), list(visitors.items())) if a != b]
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["node", "other"])

        for batch in batches:
            for *key, visits, node, keys in zip(*(batch.column(c).to_pylist() for c in ("block", "share", "visits", "node", "keys"))):
                if key != now and now is not None:
                    yield answer()
                    members, visitors = {}, {}
                now = key
                (visitors if visits else members)[node] = keys  # a repeated row is there once
        if now is not None:
            yield answer()

    return run


def _walk(rows: DataFrame, links: Callable) -> DataFrame:
    dealt = rows.select("block", "share", "visits", "node", "keys").repartition("block", "share")
    return dealt.sortWithinPartitions("block", "share", "visits").mapInArrow(_by_block(links), "node long, other long")


# -- the join -----------------------------------------------------------------

def _needed(nodes: DataFrame, block_bytes: int, name: str, *keys: str) -> DataFrame:
    """How many blocks the nodes of each group need."""
    return nodes.groupBy(*keys).agg(F.ceil(F.sum(F.col("n") * 8) / F.lit(block_bytes)).alias(name))


def _signs(nodes: DataFrame, shared: DataFrame, block_bytes: int) -> DataFrame:
    """Nodes of clusters that a block does not hold, with the shingles they are dealt by.

    ``near`` is the most common one whose sets in the cluster fit into a block, ``far`` into FAR blocks.
    """
    large = _needed(nodes, block_bytes, "blocks", "cluster").where("blocks > 1").select("cluster")
    entries = shared.select("shingle", "node").distinct().join(nodes.join(large, "cluster"), "node")
    # a window, as for what is met: the entries are shuffled once, and no join makes them again
    size = F.sum(F.col("n") * 8).over(Window.partitionBy("cluster", "shingle"))
    sized = entries.withColumn("bytes", size).where(F.col("bytes") <= FAR * block_bytes)
    most = lambda fits: F.max(F.when(fits, F.struct("bytes", "shingle")))["shingle"]
    return sized.groupBy("node").agg(most(F.col("bytes") <= block_bytes).alias("near"), most(F.lit(True)).alias("far"))


def _blocks(nodes: DataFrame, block_bytes: int) -> DataFrame:
    """Nodes with the block they lie in; a cluster's nodes are dealt to as many as its bytes need."""
    placed = nodes.join(_needed(nodes, block_bytes, "blocks", "cluster"), "cluster")
    placed = placed.join(_needed(nodes, block_bytes, "parts", "cluster", "far"), ["cluster", "far"])
    alone = F.xxhash64("cluster", "far", F.pmod(F.xxhash64("near"), "parts"))
    together = F.xxhash64("cluster", F.pmod(F.xxhash64("far"), "blocks"))
    return placed.withColumn("block", F.when(F.col("parts") > 1, alone).otherwise(together)).drop("parts")


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def _mixed(cells: DataFrame) -> DataFrame:
    """Entries of the shingles that sets of different components have in different blocks."""
    of_shingle = Window.partitionBy("shingle")
    ends = cells.select("*", *(f(c).over(of_shingle).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("root", "block")))
    return ends.where("min_root <> max_root AND min_block <> max_block").select(cells.columns)


def _met(begun: DataFrame) -> DataFrame:
    """Entries of the shingles that several sets have at the beginning, with the least of those sets."""
    # a window, because a join with the counts would shuffle these entries twice; what is common spills
    of_shingle = Window.partitionBy("shingle")
    ends = begun.select("*", F.min("node").over(of_shingle).alias("least"), F.max("node").over(of_shingle).alias("greatest"))
    return ends.where("least <> greatest").drop("greatest")


def links(
    rows: DataFrame, sets: DataFrame, stage: Stage, size: int = SIZE, percent: int = PERCENT,
    block_bytes: int = BLOCK_BYTES, visit_bytes: int = VISIT_BYTES,
) -> DataFrame:
    """(node, root) of every set that links with another; ``sets`` has (doc_id, node, n, first) of the documents ``rows``."""
    entries = "shingle long, node long, n long"
    # the other set may be smaller, and ask for fewer
    least = F.expr(f"1 + (((n * {percent} + 99) div 100) * {EXTRA}) div 100")

    def sharing(shared: DataFrame) -> DataFrame:
        found = shared.groupBy("node").agg(F.max("n").alias("n"), F.min("least").alias("head"), F.count(F.lit(1)).alias("shared"))
        return found.where(F.col("shared") >= least)

    met = _met(sets.select("node", "n", "first").mapInArrow(_beginnings, entries))
    one = sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = _sent(stage(sharing(met).select("node").join(one, "node"), "wanted"))
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"])).select("node", "text")
    members = stage(texts.mapInArrow(_members(size), "node long, keys binary"), "members")

    common = rows.sparkSession.sparkContext.broadcast(_common(members, stage, COMMON, SENT_SHINGLES))
    shared = stage(_met(members.mapInArrow(_rarest(common, percent), entries)), "shared")
    heads = stage(sharing(shared), "heads")
    of_head = heads.select(F.col("node").alias("head"), F.col("head").alias("cluster"))
    nodes = heads.join(of_head, "head", "left").withColumn("cluster", F.coalesce("cluster", "head"))
    nodes = stage(nodes.select("node", "n", "cluster"), "clusters")
    signs = nodes.join(_signs(nodes, shared, block_bytes), "node", "left").select(
        "node", "n", "cluster", F.coalesce("near", "node").alias("near"), F.coalesce("far", "node").alias("far"))
    nodes = stage(_blocks(stage(signs, "signs"), block_bytes), "nodes")

    whole = F.lit(0).alias("share"), F.lit(False).alias("visits")
    alone = lambda placed: members.join(_sent(placed.select("node", "block")), "node").select("*", *whole)

    edges = stage(_walk(alone(nodes), _within(percent)), "within")
    # of a cluster with several blocks, one set of each component goes on while they become fewer
    standing = nodes.where("blocks > 1")
    before = standing.count()
    while before:
        standing = stage(_blocks(standing.select("node", "n", "cluster", "near", "far").join(edges, "node", "left_anti"), block_bytes), "standing")
        left = standing.count()
        if left * 10 > before * 9:  # a walk costs as much as their sets; the last step finds what is left
            break
        before = left if not standing.where("blocks > 1").isEmpty() else 0
        edges = stage(edges.unionByName(_walk(alone(standing), _within(percent))), "within")

    weights = nodes.groupBy("block").agg(F.count(F.lit(1)).alias("weight"))
    roots = stage(nodes.join(components(edges, stage), "node", "left").join(weights, "block").select(
        "node", "n", "block", "weight", F.coalesce("root", "node").alias("root")), "roots")
    mixed = stage(_mixed(shared.select("shingle", "node").distinct().join(roots, "node")), "mixed")
    for _ in range(2):  # without the sets that share too few with other components, fewer shingles are shared
        enough = mixed.groupBy("node").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
        mixed = stage(_mixed(mixed.join(enough.select("node"), "node", "left_semi")), "mixed")
    targets = mixed.groupBy("shingle", F.col("block").alias("there"), F.col("weight").alias("heavy")).agg(
        F.min("root").alias("a"), F.max("root").alias("b"), F.min("n").alias("fewest"), F.max("n").alias("most"))
    near = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("fewest") * percent <= F.col("n") * 100)
    other = (F.col("a") != F.col("root")) | (F.col("b") != F.col("root"))
    heavier = F.struct("heavy", "there") > F.struct(F.col("weight").alias("heavy"), F.col("block").alias("there"))
    visits = mixed.join(targets, "shingle").where(heavier & other & near)
    # a set that links shares so many of them, and each has brought a row
    visits = visits.groupBy("node", F.col("there").alias("block")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("shared"))
    visits = stage(visits.where(F.col("shared") >= least), "visits")
    if not visits.isEmpty():
        shares = stage(visits.groupBy("block").agg(F.ceil(F.sum(F.col("n") * 8) / F.lit(visit_bytes)).alias("shares")), "shares")
        dealt = stage(visits.join(shares, "block").select(
            "node", "block", F.pmod(F.xxhash64("node"), "shares").cast("int").alias("share")), "dealt")
        guests = members.join(_sent(dealt), "node").select("block", "share", F.lit(True).alias("visits"), "node", "keys")
        hosts = members.join(_sent(nodes.join(shares, "block").select("node", "block", "shares")), "node").select(
            "block", F.explode(F.sequence(F.lit(0), F.col("shares").cast("int") - 1)).alias("share"), F.lit(False).alias("visits"), "node", "keys")
        edges = stage(edges.unionByName(_walk(guests.unionByName(hosts), _across(percent))), "across")
    return components(edges, stage)


def join(docs: DataFrame, stage: Stage, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT, **bounds: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; see above."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = stage(rows.mapInArrow(_sets(size, percent), "doc_id long, node long, n long, first binary"), "sets")
    found = links(rows, sets.where("n > 0"), stage, size, percent, **bounds)
    rooted = sets.drop("first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    component: Column = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rooted.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
