"""The prefix-tree join against all pairs."""

import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from bytewake.llm import ngram_join
from bytewake.staging import stage_in
from tests.llm.helpers import AWKWARD, prose

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 4]) for i in range(max(len(words) - 3, 1)))


def brute(docs, percent=85):
    sets = [brute_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[top(i)] = top(j)
    of = {}
    for i, (d, _) in enumerate(docs):
        of.setdefault(top(i), []).append(d)
    return sorted((d, len(s), min(of[top(i)])) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def changed(text, rnd, times):
    words = text.split()
    for _ in range(times):
        words[rnd.randrange(len(words))] = f"other{rnd.random()}"
    return " ".join(words)


def corpus(seed=3):
    """Copies, chains at and near the limit, one large group, a passage that many share."""
    rnd = random.Random(seed)
    texts = list(AWKWARD) + AWKWARD[:6] + [prose(i, 60 + i) for i in range(25)]
    for base in range(8):
        text = prose(500 + base, 80 + 40 * base)
        for _ in range(6):
            texts.append(text)
            text = changed(text, rnd, rnd.randint(1, 4))
    hub = prose(900, 120)
    texts += [changed(hub, rnd, rnd.randint(0, 3)).upper() for _ in range(60)]
    passage = prose(901, 70)
    texts += [f"{passage} {prose(1000 + i, 12 + 3 * i)}" for i in range(30)]
    texts += [prose(77, 3000), prose(77, 3000) + " tail", "a b c d", "a b c", "A B c", "a b"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def run(spark, docs, **bounds):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    df = df.selectExpr("doc_id", "text", "1 AS node", "2 AS n", "'x' AS keys", "3 AS block")  # names that clash
    found = ngram_join.join(df, stage_in(spark, "join"), **bounds)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(map(tuple, found.collect()))


def test_equals_all_pairs(spark):
    docs = corpus()
    assert run(spark, docs) == brute(docs)


def test_equals_all_pairs_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SENT_IDS", 0)
    docs = corpus(4)
    assert run(spark, docs, block_bytes=4000, visit_bytes=3000) == brute(docs)


def test_a_large_cluster_is_dealt_by_what_its_sets_share(spark):
    """Each shingle of eight sets lies in one block, each of forty in a few, and no block is much too large."""
    nodes = spark.createDataFrame([(i, 10, 0) for i in range(400)], "node long, n long, cluster long")
    shared = spark.createDataFrame(
        [(s, i) for i in range(400) for s in (-1, i // 8, 1000 + i // 40)], "shingle long, node long")
    signs = {r.node: (r.near, r.far) for r in ngram_join._signs(nodes, shared, 800).collect()}
    assert signs == {i: (i // 8, 1000 + i // 40) for i in range(400)}
    dealt = nodes.join(ngram_join._signs(nodes, shared, 800), "node")
    block = {r.node: r.block for r in ngram_join._blocks(dealt, 800).collect()}
    assert len(block) == 400
    for size, most in ((8, 1), (40, 4)):
        assert all(len({block[i] for i in range(first, first + size)}) <= most for first in range(0, 400, size))
    assert max(sum(b == x for b in block.values()) for x in set(block.values())) <= 40


def test_a_passage_that_many_sets_share_in_small_blocks(spark):
    """Sets without links share much, some of them with near copies."""
    rnd, texts = random.Random(5), []
    for group in range(6):
        passage = prose(2000 + group, 60)
        for i in range(25):
            texts.append(f"{passage} {prose(3000 + 100 * group + i, 40)}")
            if i % 5 == 0:
                texts.append(changed(texts[-1], rnd, 1))
    docs = list(enumerate(texts))
    assert run(spark, docs, block_bytes=6000, visit_bytes=5000) == brute(docs)


def test_sets_are_walked_again_only_while_they_become_fewer(spark):
    """One near copy among sets of a large cluster is no reason to walk all of them once more."""
    passage = prose(70, 60)
    texts = [f"{passage} {prose(7100 + i, 40)}" for i in range(40)]
    docs, names = list(enumerate([*texts, changed(texts[3], random.Random(7), 1)])), []
    write = stage_in(spark, "join")

    def stage(df, name):
        names.append(name)
        return write(df, name)

    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = ngram_join.join(df, stage, block_bytes=6000, visit_bytes=5000).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(docs)
    assert names.count("within") == 1


def test_sets_that_share_only_what_many_have_are_not_placed(spark):
    """A passage that is the larger part of forty texts brings none of them into a tree, however many blocks they would fill."""
    passage = prose(80, 60)
    texts = [f"{passage} {prose(8100 + i, 40)}" for i in range(40)]
    docs, rows = list(enumerate([*texts, changed(texts[3], random.Random(8), 1)])), {}
    write = stage_in(spark, "join")

    def stage(df, name):
        staged = write(df, name)
        rows[name] = staged.count()
        return staged

    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = ngram_join.join(df, stage, block_bytes=6000, visit_bytes=5000).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(docs)
    assert rows["nodes"] == 2


def test_common_shingles_come_last(spark, monkeypatch):
    rnd = random.Random(9)
    numbers = lambda n: [rnd.getrandbits(64) for _ in range(n)]
    every, some = numbers(30), numbers(10)
    sets = [sorted({*every, *numbers(50), *(some if i < 20 else ())}) for i in range(64)]
    rows = [(i, np.array(s, ">u8").tobytes()) for i, s in enumerate(sets)]
    members = spark.createDataFrame(rows, "node long, keys binary").repartition(3)
    stage = stage_in(spark, "join")
    low = lambda values: sorted(x >> 22 for x in values)
    counted, digits = ngram_join._common(members, stage, 16, 100)
    assert counted.tolist() == low([*every, *some])
    assert dict(zip(counted.tolist(), digits.tolist())) == {x >> 22: 7 for x in every} | {x >> 22: 5 for x in some}
    assert ngram_join._common(members, stage, 16, 35)[0].tolist() == low(every)
    assert [len(x) for x in ngram_join._common(members, stage, 16, 9)] == [0, 0]
    assert [len(x) for x in ngram_join._common(members.limit(0), stage, 16, 9)] == [0, 0]

    monkeypatch.setattr(ngram_join, "beginning", lambda n, percent: n)
    common = spark.sparkContext.broadcast((counted, digits))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([k for _, k in rows], pa.binary())], names=["node", "keys"])
    got = pa.Table.from_batches(ngram_join._rarest(common, 85)([batch])).to_pydict()
    want = [(x, i, len(s)) for i, s in enumerate(sets) for x in sorted(s, key=lambda x: ((x in every) * 2 + (x in some), x))]
    assert [(x % (1 << 64), i, n) for x, i, n in zip(got["shingle"], got["node"], got["n"])] == want


def test_shared_shingles_are_counted_without_a_join(spark):
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    cells = spark.createDataFrame([(1, 10, 10, 1), (1, 11, 11, 2), (2, 10, 10, 1), (2, 12, 10, 3)], "shingle long, node long, root long, block long")
    assert sorted(map(tuple, ngram_join._mixed(cells).collect())) == [(1, 10, 10, 1), (1, 11, 11, 2)]
    assert joins(ngram_join._mixed(cells)) == 0
    nodes = spark.createDataFrame([(i, 30, 0) for i in range(8)], "node long, n long, cluster long")
    shared = spark.createDataFrame([(s, i) for i in range(8) for s in (100, 200 + i // 4, 300 + i // 2)], "shingle long, node long")
    signs = ngram_join._signs(nodes, shared, 480)
    assert {r.node: (r.near, r.far) for r in signs.collect()} == {i: (300 + i // 2, 100) for i in range(8)}
    assert joins(signs) == 2  # with the clusters that are large, and with their nodes


def test_empty_table_and_missing_ids(spark):
    assert run(spark, []) == []
    text = prose(1, 50)
    df = spark.createDataFrame([(None, text), (None, text), (4, None), (7, text), (7, "other words are in this one")], "doc_id long, text string")
    found = ngram_join.join(df, stage_in(spark, "join")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == sorted(
        [(None, 47, 7), (None, 47, 7), (4, 0, 4), (7, 47, 7), (7, 3, 7)], key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_what_all_pairs_find(seed):
    rnd = random.Random(seed)
    base = [rnd.randrange(1 << 20) for _ in range(200)]
    sets = {tuple(sorted(set(rnd.sample(base, rnd.randint(1, 200))) | {rnd.randrange(1 << 20) for _ in range(rnd.randint(0, 9))})) for _ in range(80)}
    sets |= {tuple(sorted(set(base) - {rnd.choice(base)})) for _ in range(20)}
    tree = ngram_join.Tree([np.array(s, ">u8").tobytes() for s in sets], 85)
    for keys in tree.sets:
        wanted = np.array([rnd.random() < 0.7 for _ in tree.sets])
        want = {i for i, s in enumerate(tree.sets) if wanted[i] and 185 * len(np.intersect1d(keys, s)) >= 85 * (len(keys) + len(s))}
        assert set(tree.linked(keys, wanted).tolist()) == want


def test_beginnings_of_linked_sets_meet_often_enough():
    for n in range(1, 400):
        first = int(ngram_join.beginning(np.array([n]), 85)[0])
        for m in range(-(-85 * n // 100), n + 1):  # a smaller set that links
            other = int(ngram_join.beginning(np.array([m]), 85)[0])
            overlap = -(-85 * (n + m) // 185)
            # the j-th shared shingle stands before all the later ones in both sets
            j = ngram_join.shared_at_least(m)
            assert n - overlap + j <= first and m - overlap + j <= other
            assert j >= ngram_join.shared_at_least(-(-85 * n // 100))


def test_windows_change_nothing(monkeypatch):
    from bytewake.llm import hashed_words

    column = pa.array(AWKWARD + [prose(5, 4000), "x" * 3000 + " y"])
    whole = ngram_join.shingles(column)
    monkeypatch.setattr(hashed_words, "WINDOW", 700)
    parts = ngram_join.shingles(column)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert [len(brute_set(t)) for t in column.to_pylist()] == np.diff(whole[1]).tolist()
