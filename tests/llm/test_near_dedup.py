import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bytewake.llm import near_dedup as nd
from bytewake.llm.components import components
from bytewake.staging import stage_in
from tests.llm.helpers import AWKWARD, documents, prose


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, radius=2):
    """Smallest position that each one reaches."""
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= radius:
                    root[i] = min(root[i], root[j])
    return root


def near_copies(seed, n):
    rnd = random.Random(seed)
    base = prose(seed, 300).split(" ")
    out = []
    for _ in range(n):
        words = list(base)
        words[rnd.randrange(len(words))] = rnd.choice(["other", "word", "there"])
        out.append(" ".join(words))
    return out


def test_documents_equal_brute_force(spark):
    texts = AWKWARD + near_copies(1, 25) + near_copies(2, 5) + [prose(9, 50)] * 3 + [prose(i, 80) for i in range(20, 30)]
    fps = [brute_fingerprint(t) for t in texts]
    want = [(i, f"{fp:016x}", root) for i, (fp, root) in enumerate(zip(fps, brute_groups(fps)))]
    got = nd.near_duplicates(documents(spark, texts), stage_in(spark, "test"))
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("cell", [2, 7, 1024])
def test_links_of_dense_buckets(spark, cell):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    one = np.uint64(1)
    fps = {int(b) for b in base} | {0, 3}
    for b in base:
        for _ in range(60):
            fps.add(int(b ^ (one << np.uint64(rng.integers(64))) ^ (one << np.uint64(rng.integers(64)))))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    stage = stage_in(spark, "test")
    roots = dict(map(tuple, components(nd.links(table, cell=cell), stage).collect()))
    groups = {}
    for x, root in zip(signed, brute_groups(fps)):
        groups.setdefault(root, []).append(x)
    want = {x: min(g) for g in groups.values() for x in g if x != min(g)}
    assert {k: v for k, v in roots.items() if k != v} == want


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_slices_count_exactly(radius):
    rng = np.random.default_rng(radius)
    start = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = [start ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(8)]
    fps = np.unique(np.concatenate([start, *flips, flips[0] ^ np.uint64(0b1011)]))
    cells = np.sort(rng.integers(0, 3, len(fps)))
    got = set()
    for i, j in nd.Slices(fps, cells).links(radius):
        got |= set(zip(i.tolist(), j.tolist()))
    want = {
        (a, b) for a in range(len(fps)) for b in range(a + 1, len(fps))
        if cells[a] == cells[b] and bin(int(fps[a] ^ fps[b])).count("1") <= radius
    }
    assert got == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "node long, other long"), stage_in(spark, "test")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{x: 100 for x in range(101, 160)}, 201: 200, 202: 200}


def test_one_document_of_each_group_stays(spark):
    texts = near_copies(4, 10) + [prose(50, 100)] * 4 + [prose(i, 90) for i in range(60, 64)]
    docs = documents(spark, texts).union(spark.createDataFrame([(13, texts[13]), (None, texts[13]), (None, prose(77, 90))], "doc_id long, text string"))
    docs = docs.withColumn("_ROW", F.lit("mine")).withColumn("_fp", F.lit(77))
    with pytest.raises(Exception):
        nd.keep_first(docs.select("doc_id", "text", F.lit(1).alias("_fp"), F.lit(2).alias("_fp")), stage_in(spark, "test")).count()
    kept = nd.keep_first(docs, stage_in(spark, "test"))
    fps = [brute_fingerprint(t) for t in texts]
    want = sorted({root for root in brute_groups(fps)})
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.select("_ROW", "_fp").distinct().collect()] == [("mine", 77)]
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, i) for i in want] + [(True, None)]


def test_empty_table(spark):
    docs = documents(spark, ["x"]).limit(0)
    assert nd.near_duplicates(docs, stage_in(spark, "test")).count() == 0
    assert nd.keep_first(docs, stage_in(spark, "test")).count() == 0
