"""The ranking against scores of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from bytewake.llm import ranked_search
from bytewake.llm.ranked_search import Settings
from bytewake.staging import stage_in
from tests.llm.helpers import AWKWARD, prose
from tests.llm.test_source_divergence import lowered

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lowered(text or ""))


def brute(docs, queries, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in queries:
        found = []
        for d, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, -math.inf if d is None else d, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus():
    texts = AWKWARD + [prose(i, 20 + i, 200) for i in range(120)] + [prose(3, 40, 200)] * 15 + [prose(900, 9000), "Only 42 here", "42"]
    queries = [(i, prose(i * 7, 12, 200)) for i in range(12)] + [(20, prose(3, 40, 200)), (21, None), (22, ""), (23, "absent zzz"), (24, "42 ONLY é"), (24, "42")]
    return list(enumerate(texts)), queries


def run(spark, docs, queries, conf=Settings()):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("doc_id", "text", "1 AS q", "2 AS score", "3 AS item_id")
    items = spark.createDataFrame(queries, "item_id long, text string").selectExpr("item_id", "text", "1 AS q", "2 AS doc_id", "3 AS rank")
    found = ranked_search.search(df, items, stage_in(spark, "search"), conf)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("conf", [
    Settings(), Settings(k=3, block=1, first=1, growth=2), Settings(block=4, first=7, entries=300, query_terms=25)])
def test_equals_scores_of_all_documents(spark, conf):
    docs, queries = corpus()
    assert run(spark, docs, queries, conf) == brute(docs, queries, conf.k)


def test_empty_tables_and_missing_ids(spark):
    docs, queries = corpus()
    assert run(spark, [], queries) == [] == run(spark, docs, [])
    tied = [(None, "same words"), (5, "same words"), (2, "same words"), (2, "same words"), (9, "nothing else of it")]
    got = run(spark, tied, [(1, "same")])
    assert got == brute(tied, [(1, "same")]) and [r[2] for r in got] == [None, 2, 2, 5]


def test_blocks_are_skipped_and_bounds_hold():
    """A shard whose lists are long: few documents are scored, and no summary lies below a document."""
    rnd = np.random.default_rng(1)
    n, width = 2000, 300
    doc, term = np.divmod(np.unique(np.concatenate([rnd.zipf(1.5, 30) % width + d * width for d in range(n)])), width)
    impact = rnd.integers(1, 10**6, len(doc))
    shard = ranked_search.Shard(np.arange(n), doc, term, impact, width, 16)
    weights = np.zeros(width, np.int64)
    asked = np.array([1, 2, 3, 50, 120])
    weights[asked] = [5, 9, 20, 4000, 7000]
    scored = []
    exact = shard.scores
    shard.scores = lambda docs, w: scored.extend(docs.tolist()) or exact(docs, w)
    found = shard.search(asked, weights, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
    held = np.unique(doc)
    scores = np.zeros(n, np.int64)
    scores[held] = exact(held, weights)
    order = np.lexsort((np.arange(n), -scores))[:10]
    assert found[0].tolist() == scores[order].tolist() and found[1].tolist() == order.tolist()
    assert len(scored) < (scores > 0).sum() / 2
    for t in asked.tolist():
        docs, terms_, most, begin = shard._blocks(t)
        bound = np.repeat(np.add.reduceat(weights[terms_] * most, begin), 16)[:len(docs)]
        assert (bound >= scores[docs]).all()


