"""Ranked lexical search with blocks of similar documents in each posting list.

Every document is scored for every query by the terms they share (weights and
impacts below, 64-bit integers), and each query gets its ``k`` best documents.

A task cuts its documents into shards and indexes each of them: impacts by
document, and a posting list for each query term.  A list is ordered by which of
some pivot documents a document is most similar to, and cut into blocks of
neighbours; a block's summary is the coordinatewise maximum of its documents'
impacts, so query times summary is never below the score of a document in it.
Lists are taken in order of what their term can add at most.  A block is skipped
only if its bound is below the query's k-th score so far, and the remaining
lists once all their terms together are; what is left is scored exactly.  A task
carries its k-th scores from shard to shard, the first of which are small, and
returns its k best of each query, from which a ranking keeps k.

Counts come from a first pass over all documents.  Queries go to the tasks in
blocks of at most ``Settings.query_terms`` term entries, each block one pass over
the documents, written before the next begins; nothing else is collected.

Defined results: null text has no terms, so such a document is never found and
such a query finds nothing; documents without a term count nowhere; a null
doc_id is smaller than any other; repeated rows are documents of their own, and
queries that occur twice are answered twice; an empty table gives an empty
ranking.  Very long texts are a step of their own, handled in windows.  Other
columns are not read, so their names may clash with any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytewake.llm.common import steps
from bytewake.llm.hashed_words import per_text, separators, text_bytes, words
from bytewake.staging import Stage

#: what is no part of a term
APART = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: stands for a null id inside a task
NO_ID = np.iinfo(np.int64).min
#: rows of the statistics that are no terms
N_DOCS, N_WORDS = -1, -2
#: the ranking's fixed values: weight, impact and length are scaled to integers
SCALE, IMPACT, LENGTH, SHARE = 1000, 1_000_000_000, 100, 90


@dataclass(frozen=True)
class Settings:
    k: int = 10
    #: documents of a block
    block: int = 16
    #: documents of a task's first shard, by how much the next ones are larger, and entries that end a shard
    first: int = 400
    growth: int = 4
    entries: int = 1_500_000
    #: entries (query, term) that go to the tasks at once
    query_terms: int = 200_000


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, term) for the distinct terms of each text."""
    for batch in batches:
        for part in steps(batch, "text"):
            data, bounds = text_bytes(part.column("text"))
            starts, ends, _ = words(data, bounds, APART)
            begin = per_text(starts, bounds)
            for i, q in enumerate(part.column("q").to_pylist()):
                found = sorted({data[starts[j]:ends[j]].tobytes().lower() for j in range(begin[i], begin[i + 1])})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * len(found), pa.int64()), pa.array([t.decode() for t in found], pa.string())], names=["q", "term"])


class Vocabulary:
    """The terms of some queries, found in texts by their hashes."""

    def __init__(self, terms: list[str]):
        column = pa.array(terms, pa.string())
        data, bounds = text_bytes(column)
        _, _, hashed = words(data, bounds, APART)
        self.order = np.argsort(hashed)
        self.sorted = hashed[self.order]

    def __len__(self) -> int:
        return len(self.order)

    def postings(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(words of each document), and (document, term, times) by document."""
        data, bounds = text_bytes(batch.column("text"))
        starts, _, hashed = words(data, bounds, APART)
        n = np.diff(per_text(starts, bounds))
        at = np.minimum(np.searchsorted(self.sorted, hashed), max(len(self) - 1, 0))
        known = self.sorted[at] == hashed if len(self) else np.zeros(len(hashed), bool)
        doc, term = np.repeat(np.arange(batch.num_rows), n)[known], self.order[at[known]] if len(self) else at[known]
        key, times = np.unique(doc * max(len(self), 1) + term, return_counts=True)
        return n, key // max(len(self), 1), key % max(len(self), 1), times


def _statistics(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, docs, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for part in steps(batch, "text"):
                n, _, term, _ = vocabulary.postings(part)
                holding += np.bincount(term, minlength=len(vocabulary)).astype(np.int64)
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
        at = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, [N_DOCS, N_WORDS])), pa.array(np.append(holding[at], [docs, total]))], names=["term", "n"])

    return run


def weight(n_docs: int, holding: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each of some runs."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)


class Shard:
    """Documents with their impacts, and posting lists in blocks with summaries, made when a query asks for one."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, width: int, block: int):
        self.ids, self.term, self.impact, self.size = ids, term, impact, block
        self.begin = np.searchsorted(doc, np.arange(len(ids) + 1))
        by_term = np.argsort(term, kind="stable")
        self.lists, self.list_begin = doc[by_term], np.searchsorted(term[by_term], np.arange(width + 1))
        self.most = np.zeros(width, np.int64)
        np.maximum.at(self.most, term, impact)
        self.cluster = self._clusters(doc, width)
        self.blocks: dict[int, tuple[np.ndarray, ...]] = {}

    def _clusters(self, doc: np.ndarray, width: int) -> np.ndarray:
        """For each document the pivot that is most similar by the angle between impacts."""
        count = max(1, min(math.isqrt(len(self.ids)), 4_000_000 // max(width, 1)))
        pivots = np.linspace(0, len(self.ids) - 1, count).astype(np.int64)
        place = np.zeros((width, count), np.float32)
        for i, d in enumerate(pivots):
            own = slice(self.begin[d], self.begin[d + 1])
            place[self.term[own], i] = self.impact[own]
        place /= np.maximum(np.sqrt((place.astype(np.float64) ** 2).sum(0)), 1)
        nearest = np.zeros(len(self.ids), np.int64)
        a = 0
        while a < len(self.ids):  # documents whose entries make a bounded matrix
            b = max(a + 1, int(np.searchsorted(self.begin, self.begin[a] + 4_000_000 // count, "right")) - 1)
            own = slice(self.begin[a], self.begin[b])
            if own.stop > own.start:
                near = place[self.term[own]] * self.impact[own, None].astype(np.float32)
                held = np.flatnonzero(np.diff(self.begin[a:b + 1]))
                nearest[a + held] = np.add.reduceat(near, self.begin[a + held] - own.start).argmax(1)
            a = b
        return nearest

    def _blocks(self, t: int) -> tuple[np.ndarray, ...]:
        """Documents of a term's list by similarity, and where in the summaries (terms, maxima) each block begins."""
        if t not in self.blocks:
            docs = self.lists[self.list_begin[t]:self.list_begin[t + 1]]
            docs = docs[np.argsort(self.cluster[docs], kind="stable")]
            count = self.begin[docs + 1] - self.begin[docs]
            at = ranges(self.begin[docs], count)
            block = np.repeat(np.arange(len(docs)) // self.size, count)
            order = np.lexsort((self.term[at], block))
            block, term, impact = block[order], self.term[at][order], self.impact[at][order]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (block[1:] != block[:-1]) | (term[1:] != term[:-1])
            first = np.flatnonzero(fresh)
            begin = np.searchsorted(block[first], np.arange((len(docs) - 1) // self.size + 1))
            self.blocks[t] = docs, term[first], np.maximum.reduceat(impact, first), begin
        return self.blocks[t]

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        count = self.begin[docs + 1] - self.begin[docs]  # never 0: each holds the list's term
        at = ranges(self.begin[docs], count)
        return np.add.reduceat(weights[self.term[at]] * self.impact[at], np.cumsum(count) - count)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int):
        """The k best (scores, ids) among ``best`` and this shard; ``weights`` is 0 but for the query's terms."""
        bound = weights[terms] * self.most[terms]
        order = np.argsort(-bound, kind="stable")
        left = np.cumsum(bound[order][::-1])[::-1]  # what a list's term and all later ones can add
        seen = np.zeros(len(self.ids), bool)
        for t, rest in zip(terms[order].tolist(), left.tolist()):
            least = int(best[0][-1]) if len(best[0]) == k else 1
            if rest < least:
                break
            if self.list_begin[t] == self.list_begin[t + 1]:
                continue
            docs, term, most, begin = self._blocks(t)
            reach = np.add.reduceat(weights[term] * most, begin) >= least
            docs = docs[np.repeat(reach, self.size)[:len(docs)]]
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                best = merged(best, (self.scores(docs, weights), self.ids[docs]), k)
        return best


def merged(best, found, k: int):
    scores, ids = np.concatenate([best[0], found[0]]), np.concatenate([best[1], found[1]])
    order = np.lexsort((ids, -scores))
    order = order[scores[order] > 0][:k]
    return scores[order], ids[order]


def _search(vocabulary: Vocabulary, queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_words: int, conf: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        best = {q: nothing for q, _ in queries}
        held, docs, entries, most = [], 0, 0, conf.first

        def search() -> None:
            at = np.cumsum([0] + [len(h[0]) for h in held])
            ids, doc, term, impact = (np.concatenate(x) for x in (
                [h[0] for h in held], [h[1] + a for h, a in zip(held, at)], [h[2] for h in held], [h[3] for h in held]))
            shard = Shard(ids, doc, term, impact, len(vocabulary), conf.block)
            own = np.zeros(len(vocabulary), np.int64)
            for q, terms in queries:
                own[terms] = weights[terms]
                best[q] = shard.search(terms, own, best[q], conf.k)
                own[terms] = 0

        for batch in batches:
            for whole in steps(batch, "text"):
                size = most
                for a in range(0, whole.num_rows, size):
                    part = whole.slice(a, size)
                    n, doc, term, times = vocabulary.postings(part)
                    longer = LENGTH - SHARE + (SHARE * n * n_docs) // max(n_words, 1)
                    impact = (IMPACT * times) // (SCALE * times + 8 * longer[doc])
                    ids = part.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                    held.append((ids, doc, term, impact))
                    docs, entries = docs + len(ids), entries + len(doc)
                    if docs >= most or entries >= conf.entries:
                        search()
                        held, docs, entries, most = [], 0, 0, most * conf.growth
        if held:
            search()
        for q, (scores, ids) in best.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), q)), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["q", "doc_id", "score"])

    return run


def search(
    docs: DataFrame, queries: DataFrame, stage: Stage, conf: Settings = Settings(), doc_id: str = "doc_id",
    text: str = "text", item_id: str = "item_id", query: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each query, equal scores by ascending doc_id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = stage(queries.select(F.col(item_id).alias("item_id"), F.col(query).alias("text"),
                                 F.monotonically_increasing_id().alias("q")), "queries")
    terms = stage(asked.select("q", "text").mapInArrow(_terms, "q long, term string"), "terms")
    blocks = -(-terms.count() // conf.query_terms)
    found = []
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()  # bounded: see Settings
        found.append(stage(_answers(rows, [(r.q, r.term) for r in own], conf), f"answers-{block}"))
    if not found:
        found = [asked.select("q", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)]
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= conf.k)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def _answers(rows: DataFrame, entries: list[tuple[int, str]], conf: Settings) -> DataFrame:
    """The best documents of a block of queries in each task."""
    known = sorted({term for _, term in entries})
    vocabulary, place = Vocabulary(known), {term: i for i, term in enumerate(known)}
    of: dict[int, list[int]] = {}
    for q, term in entries:
        of.setdefault(q, []).append(place[term])
    counted = rows.select("text").mapInArrow(_statistics(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r.term: r.n for r in counted.collect()}  # one row per term of the block
    n_docs, n_words = counts.pop(N_DOCS, 0), counts.pop(N_WORDS, 0)
    weights = np.zeros(len(known), np.int64)
    for term, holding in counts.items():
        weights[term] = weight(n_docs, holding)
    asked = [(q, np.array(sorted(t), np.int64)) for q, t in sorted(of.items())]
    return rows.mapInArrow(_search(vocabulary, asked, weights, n_docs, n_words, conf), "q long, doc_id long, score long")
