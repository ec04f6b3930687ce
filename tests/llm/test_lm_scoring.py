import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytewake.llm import lm_scoring as lm
from bytewake.staging import stage_in
from tests.llm.helpers import AWKWARD, prose

SMALL = lm.Settings(head=60, classes=4, class_size=12, buckets=5, dim=6, noise=4, batch=64)


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0 if doc_id is not None else True


def brute(rows):
    counts = Counter()
    for d, t in rows:
        if not is_held(d):
            counts.update(tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    return [
        (d, is_held(d), len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w))
        for d, t in rows for w in [tokens(t)]
    ]


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]


def check(got, rows):
    got = sorted(got, key=lambda r: repr((r["doc_id"], r["n_tokens"], r["base_score"])))
    want = sorted(brute(rows), key=lambda r: repr((r[0], r[2], r[5])))
    assert sorted(repr(tuple(r[c] for c in COLUMNS)) for r in got) == sorted(repr(r[:5]) for r in want)
    assert sorted(r["base_score"] for r in got) == pytest.approx(sorted(r[5] for r in want))


def rows_of(n):
    rnd = random.Random(n)
    return [(i, prose(i, rnd.randint(0, 120), 90)) for i in range(n)]


@pytest.mark.parametrize("settings", [SMALL, lm.Settings()])
def test_base_equals_brute_force(spark, settings):
    rows = rows_of(80) + [(1000 + i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("base", F.lit("x"))
    got = lm.score(docs.repartition(3), stage_in(spark, "test"), settings).collect()
    check(got, rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_empty_and_untrained_tables(spark):
    schema = "doc_id long, text string"
    assert lm.score(spark.createDataFrame([], schema), stage_in(spark, "test"), SMALL).count() == 0
    held = [i for i in range(100) if is_held(i)][:3]
    rows = [(i, "all held out") for i in held]
    got = lm.score(spark.createDataFrame(rows, schema), stage_in(spark, "test"), SMALL).collect()
    check(got, rows)


def vocabulary(spark, rows, settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = stage_in(spark, "test")
    return lm.vocabulary(stage(lm.count_words(docs, "text"), "counts"), settings)


def test_probabilities_of_all_words_add_up_to_one(spark):
    rows = rows_of(60)
    vocab = vocabulary(spark, rows, SMALL)
    model = lm.Model(SMALL, vocab.symbol_counts)
    rng = np.random.default_rng(1)
    for name in model.names:  # any parameters
        value = getattr(model, name)
        setattr(model, name, (value + rng.normal(0, 0.5, value.shape)).astype(np.float32))
    counts = Counter(x for _, t in rows for x in tokens(t))
    for context in ([48, 48, 48], [3, 1, 7]):
        by_symbol = [
            math.exp(model.log_probabilities(np.array([*context, s]), np.array([True]))[0]) for s in range(SMALL.symbols)]
        assert sum(by_symbol) == pytest.approx(1, abs=1e-4)
        chosen = {w: vocab.symbol[i] for w, i in vocab.index.items() if vocab.inside[i] == 0.0 and vocab.symbol[i] not in vocab.bucket_symbol}
        total = sum(by_symbol[s] for s in chosen.values())
        total += sum(by_symbol[s] for s in range(SMALL.symbols) if s not in set(chosen.values()) and s not in vocab.bucket_symbol)
        for w, c in counts.items():
            if w not in chosen:
                b = lm.bucket_of(w, SMALL.buckets)
                total += by_symbol[vocab.bucket_symbol[b]] * (c + 0.1) / 10 ** vocab.bucket_norm[b]
        for b in range(SMALL.buckets):  # what an unseen word would get
            total += by_symbol[vocab.bucket_symbol[b]] * 0.1 / 10 ** vocab.bucket_norm[b]
        assert total == pytest.approx(1, abs=1e-3)


def test_head_is_bounded_and_complete_from_its_least_count_on(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 1 + 1000 // (i + 1)) for i in range(500)], "word binary, c long")
    for most in (0, 1, 10, 100, 1000):
        head = lm.head_words(counts, most)
        assert len(head) <= most
        least = min((c for _, c in head), default=10 ** 9)
        assert {w for w, _ in head} == {r["word"] for r in counts.where(F.col("c") >= least).collect()}
    assert len(lm.head_words(counts, 1000)) == 500


def test_training_beats_frequencies_on_held_out_text(spark):
    rnd = random.Random(5)
    follow = {i: [rnd.randrange(30) for _ in range(3)] for i in range(30)}

    def text():
        at, out = rnd.randrange(30), []
        for _ in range(80):
            at = rnd.choice(follow[at])
            out.append(f"w{at}")
        return " ".join(out)

    docs = spark.createDataFrame([(i, text()) for i in range(400)], "doc_id long, text string")
    settings = lm.Settings(classes=8, class_size=8, buckets=4, dim=12, noise=8, batch=256, rounds=3)
    got = [r for r in lm.score(docs, stage_in(spark, "test"), settings).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in got)
    # 30 equal words cost log10(30) each; three successors cost about log10(3)
    assert sum(r["base_score"] for r in got) / n == pytest.approx(-math.log10(30), abs=0.1)
    assert sum(r["score"] for r in got) / n > -1.0


def test_mean_of_models_is_weighted(spark):
    rows = [(0, 1, np.array([1.0, 2.0], "<f4").tobytes()), (1, 3, np.array([5.0, 2.0], "<f4").tobytes())]
    got = spark.createDataFrame(rows, lm.TRAINED).groupBy("tokens").applyInArrow(lm._mean, lm.TRAINED).count()
    assert got == 2
    both = spark.createDataFrame(rows, lm.TRAINED).withColumn("part", F.lit(0).cast("long")).groupBy("part").applyInArrow(lm._mean, lm.TRAINED).first()
    assert both["tokens"] == 4 and np.frombuffer(both["state"], "<f4").tolist() == [4.0, 2.0]


@pytest.mark.parametrize("settings", [lm.Settings(), SMALL])
def test_log_probabilities_in_pieces(monkeypatch, settings):
    """Places are taken a few at a time, and each gets what the whole softmax gives."""
    rng = np.random.default_rng(1)
    model = lm.Model(settings, rng.integers(0, 90, settings.symbols))
    for name in ("class_out", "out"):
        setattr(model, name, rng.normal(0, 1, getattr(model, name).shape).astype(np.float32))
    padded = rng.integers(0, settings.symbols + 1, 500)
    counted = padded[settings.context:] < settings.symbols
    whole = model.log_probabilities(padded, counted)
    monkeypatch.setattr(lm, "CACHED", 7)
    pieces = model.log_probabilities(padded, counted)
    predicted = model.predict(padded, len(counted))[counted].astype(float)
    target, size = padded[settings.context:][counted], settings.class_size

    def softmax(vectors, bias):
        logits = predicted @ vectors.T.astype(float) + bias
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    at = np.arange(len(target))
    inside = softmax(model.out, model.bias).reshape(len(target), -1, size)[at, target // size]
    inside -= np.log(np.exp(inside).sum(1, keepdims=True))
    plain = softmax(model.class_out, model.class_bias)[at, target // size] + inside[at, target % size]
    assert np.allclose(whole, plain, atol=1e-4) and np.allclose(pieces, plain, atol=1e-4)


def test_small_numbers_are_ordered_as_large_ones():
    rng = np.random.default_rng(2)
    for most in (1, 70, 1 << 16, 1 << 20):
        values = rng.integers(0, most, 3000)
        assert (lm._order(values) == np.argsort(values, kind="stable")).all()
    assert len(lm._order(np.zeros(0, np.int64))) == 0
