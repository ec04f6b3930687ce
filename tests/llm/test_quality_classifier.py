import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytewake.llm import quality_classifier as qc
from tests.llm.helpers import AWKWARD, prose

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"
SMALL = qc.Settings(labelled=200, given=40)


def corpus(n, seed=1):
    """Good prose mostly from good hosts, junk mostly from bad ones."""
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        text = prose(i, rnd.randint(30, 90)) if good else rnd.choice([
            " ".join(f"{w}***" for w in prose(i, 40).split()), "same again " * 40, prose(i, 40).upper().replace(" ", "!! ")])
        host = f"good{rnd.randrange(4)}" if good == (rnd.random() < 0.85) else f"bad{rnd.randrange(4)}"
        rows.append((i, text, host, rnd.choice(["en", "de"]), len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(800)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id % 2 = 0")
    model = qc.train(docs, known, SMALL)
    got = {r["doc_id"]: r for r in qc.score(docs, model).collect()}
    unseen = [(d, q) for d, q, _ in labels if d % 2]
    right = lambda column: sum((got[d][column] >= 0.5) == q for d, q in unseen) / len(unseen)
    assert right("score") > 0.95 and right("page_score") > 0.75
    assert right("score") >= right("page_score")
    assert all(r["kept"] == (r["score"] >= 0.5) for r in got.values())
    # probabilities, not just an order
    sure = [q for d, q in unseen if got[d]["score"] > 0.9]
    assert sum(sure) / len(sure) > 0.9


def test_fit_does_not_depend_on_partitions(spark):
    rows, labels = corpus(300, 2)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id % 3 = 0")
    one = qc.train(spark.createDataFrame(rows, SCHEMA).coalesce(1), known, SMALL)
    many = qc.train(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5), known.repartition(3), SMALL)
    assert all((a == b).all() for a, b in zip(one.views, many.views)) and (one.joint == many.joint).all()


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(0, 1, 0), (1, 1, 0)], 1.0), ([(0, None, 0), (None, 1, 0), (99, 0, 0)], 0.5)])
def test_labels_of_one_kind(spark, labels, share):
    docs = spark.createDataFrame([(i, t, "s", None, None) for i, t in enumerate(AWKWARD)], SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = qc.score(docs, qc.train(docs, known, SMALL)).collect()
    assert [(r["score"], r["kept"]) for r in got] == [(share, True)] * len(AWKWARD)


def test_awkward_rows_and_empty_table(spark):
    rows, labels = corpus(200, 3)
    rows += [(500 + i, t, None, None, None) for i, t in enumerate(AWKWARD)] + [(None, "x", "s", "en", -5), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("KEPT", F.lit(1)).withColumn("score", F.lit("x"))
    known = spark.createDataFrame(labels + [(0, 0, 0)], "doc_id long, quality int, toxic int")
    model = qc.train(docs, known, SMALL)
    got = qc.score(docs, model)
    assert got.count() == len(rows) and got.where("score IS NULL OR isnan(score)").count() == 0
    assert len({r["score"] for r in got.where("doc_id = 0").collect()}) == 1
    assert qc.score(docs.limit(0), model).count() == 0


def test_every_document_without_a_label_is_looked_at(spark):
    """Bins, limits and given labels against loops over all rows; labels of absent documents take no place."""
    rows, labels = corpus(400, 4)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    known = spark.createDataFrame(labels + [(-i, 1, 0) for i in range(1, 500)], "doc_id long, quality int, toxic int")
    known = known.where("doc_id % 4 = 0 OR doc_id < 0")
    settings = qc.Settings(labelled=100, given=10_000, rounds=2, confident=0.2)
    free = [r for r in rows if r[0] % 4]
    text = np.stack([qc.text_features(r[1], settings.text_bins) for r in free]).astype(np.float16)
    page = np.stack([qc.page_features(*r[2:], settings.source_bins) for r in free])
    views = [v.astype(np.float64).tolist() for v in (text, page)]
    rnd = np.random.default_rng(5)
    pool = qc.features(docs.where("doc_id % 4 <> 0"), settings)
    given, rounds, n_given = [{}, {}], [], {}
    for _ in range(2):
        weights = tuple(rnd.normal(size=len(v[0])).astype(np.float32) * 2 for v in views)
        counts = qc.histograms(pool, [*rounds, qc.Round(weights)], settings)
        bins = [[int(min(max(sum(a * b for a, b in zip(x, map(float, w))), -30), 30) // qc.BIN) for x in v] for v, w in zip(views, weights)]
        limits = []
        for view in (0, 1):
            left = Counter(b for i, b in enumerate(bins[view]) if i not in given[view])
            # the order of a sum may move a value over the edge of a bin
            assert sum(left.values()) == sum(counts[view].values())
            assert sum((left - Counter(counts[view])).values()) <= 2
            limits.append(qc.limits_of(counts[view], len(free), 0.7, settings))
            low, high = limits[-1]
            for i, b in enumerate(bins[view]):
                if i not in given[view] and (b <= low or b >= high):
                    given[view][i] = int(b >= high)
        rounds.append(qc.Round(weights, tuple(limits)))
    for view in (0, 1):
        for kind in (0, 1):
            n_given[view, kind] = sum(v == kind for v in given[view].values())
    assert min(len(g) for g in given) > 20
    got = qc.drawn(pool, rounds, n_given, settings)
    assert [sorted(Counter(s.y.tolist()).items()) for s in got] == [sorted(Counter(map(float, g.values())).items()) for g in given]
    model = qc.train(docs, known, settings)
    assert model.views is not None


def test_limits_meet_the_share_as_far_as_the_view_is_sure():
    settings = qc.Settings(confident=0.1)
    edge = round(settings.sure / qc.BIN)
    counts = {-edge - 3: 2, -edge - 2: 5, -edge - 1: 9, -edge: 50, edge - 1: 50, edge: 1, edge + 4: 3}
    assert qc.limits_of(counts, 100, 0.5, settings) == (-edge - 2, edge)
    assert qc.limits_of(counts, 1000, 0.99, settings) == (-edge - 3, edge)
    assert qc.limits_of({0: 10}, 10, 0.5, settings) == (-1 << 40, 1 << 40)


def test_evidence_outside_any_sample_is_used(spark):
    """The one host of junk is met only in documents that no small sample of ids would hold."""
    rows, labels = corpus(300, 6)
    rows = [(d, t, "mixed", g, n) for d, t, _, g, n in rows]
    more = [(1000 + i, f"{prose(i, 50)} {'*** ' * 60}", "dump", "en", 500) for i in range(60)]
    docs = spark.createDataFrame(rows + more, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id < 200")
    model = qc.train(docs, known, qc.Settings(labelled=200, given=30, confident=0.3))
    found = qc.score(docs, model).where("doc_id >= 1000").agg(F.avg("page_score")).first()[0]
    other = qc.score(docs, model).where("doc_id < 1000").agg(F.avg("page_score")).first()[0]
    assert found < other
