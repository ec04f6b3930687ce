"""Quality classifier by co-training.

Two logistic models see different views of a document: what its text holds, and
what is known about the page (its source, language and length).  They start from
the same labelled documents.  In each round each model scores all documents
without a label, and gives the other one labels for those it is most sure of: a
share of the whole table, as many of each kind as the labels have.  Each view is
then calibrated on labelled documents that neither was fitted on, and a model of
the two calibrated log-odds scores all documents.

Where a view is sure enough is read from a histogram of its log-odds over all
documents that have no label from it yet, a few thousand counts whatever their
number.  Documents of one bin are treated alike, so a share is met from above.
What earlier rounds have given follows from their weights and limits, so no
table of given labels is kept or joined.  Fixed-width features are computed once
and staged.

Only fitting uses samples: at most ``Settings.labelled`` labelled documents, and
of those labelled by each view in each kind about ``Settings.given``, the ones
with the smallest hash of their id.  They are fitted in numpy on the driver.

Defined results: a null or empty text has the features of no words; a null
source or language is a value of its own, a null length is 0; labels that are
null, or whose document is not there, are left out and take no place in the
sample; if a document is labelled twice and differently it is used with both;
rows with equal ids and features are fitted once; of documents with one id at
most one is fitted with a label that a view gave; with labels of one kind only,
or none, every document's score is that kind's share (a half if there are none)
and none is dropped; equal rows get equal scores; a very long text is a row of
the same width as others; other columns of the input are not looked at, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewake.llm.common import steps, texts
from bytewake.staging import Stage, as_is


@dataclass(frozen=True)
class Settings:
    labelled: int = 6_000
    #: fitted documents of each kind that one view labelled
    given: int = 1_500
    rounds: int = 4
    #: share of the documents without a label that each view labels in a round
    confident: float = 0.05
    #: log-odds from which on a view is sure
    sure: float = 2.0
    #: one labelled document in so many is kept for calibration
    calibrate: int = 4
    text_bins: int = 1024
    source_bins: int = 256
    least_score: float = 0.5


DENSE = 10
LANGUAGES = 32
LENGTHS = 24
#: bins of log-odds are this wide; odds beyond REACH count as there
BIN, REACH = 1 / 64, 30.0
#: documents whose features are numbers at the same time
ROWS = 2_000


def text_features(text: str, bins: int) -> np.ndarray:
    """Shape of the text, then its hashed words by the root of their share."""
    out = np.zeros(DENSE + bins, np.float32)
    data = text.encode()
    words = data.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return out
    counts = Counter(words)
    without = lambda some: (len(data) - len(data.translate(None, some))) / size
    out[:DENSE] = [
        1.0, without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b"0123456789"), without(b"#*$%&|<>"), without(b"!?"),
        len(data) / n / 20, len(counts) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        max(counts.values()) / n, min(1.0, data.count(b"\n") / n),
    ]
    for word, c in counts.items():
        out[DENSE + zlib.crc32(word) % bins] += c
    out[DENSE:] = np.sqrt(out[DENSE:] / n)
    return out


def page_features(source: str | None, lang: str | None, n_chars: int | None, bins: int) -> np.ndarray:
    out = np.zeros(1 + bins + LANGUAGES + LENGTHS, np.float32)
    out[0] = 1
    out[1 + zlib.crc32(repr(source).encode()) % bins] = 1
    out[1 + bins + zlib.crc32(repr(lang).encode()) % LANGUAGES] = 1
    out[1 + bins + LANGUAGES + min(LENGTHS - 1, max(0, n_chars or 0).bit_length())] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights of a logistic model with both classes of equal weight, by accelerated gradient steps."""
    share = y.mean()
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32) / len(y)
    step = 4 / (float((weight * (x * x).sum(1)).sum()) + 4 * ridge)
    w = np.zeros(x.shape[1], np.float32)
    ahead, t = w, 1.0
    for _ in range(rounds):
        new = ahead - step * (x.T @ (weight * (sigmoid(x @ ahead) - y)) + ridge * ahead)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


def fit_small(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's method for a few well-scaled features; the ridge keeps separable classes finite."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        hessian = (x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


@dataclass
class Classifier:
    settings: Settings
    prior: float
    views: tuple[np.ndarray, np.ndarray] | None = None  # weights
    scales: tuple[np.ndarray, np.ndarray] | None = None  # (offset, slope) of each view's log-odds
    joint: np.ndarray | None = None  # (offset, weight of each calibrated view)

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by page and by both."""
        if self.views is None:
            same = np.full(len(text), self.prior)
            return same, same, same
        odds = [a + b * (x * w).sum(1, dtype=np.float64) for x, w, (a, b) in zip((text, page), self.views, self.scales)]
        both = self.joint[0] + self.joint[1] * odds[0] + self.joint[2] * odds[1]
        return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(both)


@dataclass(frozen=True)
class Round:
    """Weights of both views, and the bins up to and from which each gives labels to the other."""

    weights: tuple[np.ndarray, np.ndarray]
    limits: tuple[tuple[int, int], tuple[int, int]] | None = None


def bins_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    # sums of doubles in rows do not depend on how many rows there are
    odds = (x.astype(np.float64) * w.astype(np.float64)).sum(1)
    return np.floor(np.clip(odds, -REACH, REACH) / BIN).astype(np.int64)


def given_labels(views: tuple[np.ndarray, np.ndarray], rounds: list[Round]) -> list[np.ndarray]:
    """By giving view: the label each document got from it first, -1 for none."""
    out = [np.full(len(views[0]), -1, np.int8) for _ in views]
    for one in rounds:
        for label, x, w, (low, high) in zip(out, views, one.weights, one.limits):
            bins, free = bins_of(x, w), label < 0
            label[free & (bins <= low)] = 0
            label[free & (bins >= high)] = 1
    return out


def limits_of(counts: dict[int, int], total: int, prior: float, settings: Settings) -> tuple[int, int]:
    """The bins that hold the share to be labelled, from below and from above, as far as the view is sure."""
    wanted = int(settings.confident * total)
    n_bad = round(wanted * (1 - prior))
    edge = round(settings.sure / BIN)

    def reach(bins: list[int], n: int) -> int | None:
        last, met = None, 0
        for b in bins:
            if met >= n:
                break
            last, met = b, met + counts[b]
        return last

    low = reach(sorted(b for b in counts if b < -edge), n_bad)
    high = reach(sorted((b for b in counts if b >= edge), reverse=True), wanted - n_bad)
    return (-1 << 40 if low is None else low), (1 << 40 if high is None else high)


@dataclass
class Sample:
    """Features and labels of documents to fit on."""

    text: np.ndarray
    page: np.ndarray
    y: np.ndarray


def _fit_views(known: Sample, held: np.ndarray, given: tuple[Sample, Sample]) -> tuple[np.ndarray, np.ndarray]:
    """Each view from the labels, and from what the other one gave."""
    return tuple(
        fit(np.concatenate([x[~held], more]), np.concatenate([known.y[~held], extra.y]).astype(np.float32))
        for x, extra, more in ((known.text, given[1], given[1].text), (known.page, given[0], given[0].page)))


def co_train(known: Sample, pool: DataFrame, settings: Settings) -> Classifier:
    """``pool``: place, text and page of all documents without a label, as packed by ``features``."""
    prior = float(known.y.mean()) if len(known.y) else 0.5
    held = np.arange(len(known.y)) % settings.calibrate == 0
    if any(len(np.unique(part)) < 2 for part in (known.y[held], known.y[~held])):
        return Classifier(settings, prior)
    none = Sample(known.text[:0], known.page[:0], known.y[:0])
    given, rounds, n_given = (none, none), [], {}
    for _ in range(settings.rounds):
        weights = _fit_views(known, held, given)
        counts = histograms(pool, [*rounds, Round(weights)], settings)
        total = sum(counts[0].values()) + sum(n for (view, _), n in n_given.items() if view == 0)
        limits = tuple(limits_of(c, total, prior, settings) for c in counts)
        for view, (low, high) in enumerate(limits):
            for label, new in ((0, (n for b, n in counts[view].items() if b <= low)), (1, (n for b, n in counts[view].items() if b >= high))):
                n_given[view, label] = n_given.get((view, label), 0) + sum(new)
        rounds.append(Round(weights, limits))
        given = drawn(pool, rounds, n_given, settings)
    weights = _fit_views(known, held, given)
    scales, odds = [], []
    for x, w in zip((known.text, known.page), weights):
        z = (x[held] @ w).astype(np.float64)
        a, b = fit_small(np.stack([np.ones(len(z)), z], 1), known.y[held], 0.1)
        scales.append((a, b))
        odds.append(a + b * z)
    joint = fit_small(np.stack([np.ones(len(odds[0])), *odds], 1), known.y[held], 0.1)
    return Classifier(settings, prior, weights, tuple(scales), joint)


def histograms(pool: DataFrame, rounds: list[Round], settings: Settings) -> list[dict[int, int]]:
    """By view: documents in each bin of its last log-odds, without those it has labelled."""
    shared = pool.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *before, last = shared.value
        counts: Counter = Counter()
        for _, views in _unpacked(batches, settings):
            for view, (x, w, label) in enumerate(zip(views, last.weights, given_labels(views, before))):
                counts.update((view, int(b)) for b in bins_of(x, w)[label < 0])
        rows = [(view, b, n) for (view, b), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["view", "bin", "n"])

    # a few thousand bins a view, whatever the number of documents
    rows = pool.mapInArrow(run, "view long, bin long, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect()
    return [{r["bin"]: r["n"] for r in rows if r["view"] == view} for view in (0, 1)]


def drawn(pool: DataFrame, rounds: list[Round], n_given: dict[tuple[int, int], int], settings: Settings) -> tuple[Sample, Sample]:
    """By giving view: about ``Settings.given`` documents of each kind that it has labelled."""
    # of all that have a label the share with the smallest hash of their id; an id counts once
    reach = {key: int(min(1.0, settings.given / max(1, n)) * (1 << 30)) for key, n in n_given.items()}
    shared = pool.sparkSession.sparkContext.broadcast(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, views in _unpacked(batches, settings):
            spot = batch.column("place").to_numpy() & ((1 << 30) - 1)
            for view, label in enumerate(given_labels(views, shared.value)):
                for kind in (0, 1):
                    at = np.flatnonzero((label == kind) & (spot < reach[view, kind]))
                    some = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), view)), pa.array(np.full(len(at), kind, np.int32)), *[some.column(c) for c in PACKED]],
                        names=["view", "quality", *PACKED])

    rows = pool.mapInArrow(run, "view long, quality int, place long, text binary, page binary").groupBy("view", "place").agg(
        F.min(F.struct("quality", "text", "page")).alias("row")).select("view", "place", "row.*").collect()
    return tuple(_sample([r for r in rows if r["view"] == view], settings) for view in (0, 1))


def _views(part: pa.RecordBatch, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    text = np.stack([text_features(t, settings.text_bins) for t in texts(part, "text")])
    page = np.stack([
        page_features(s, lang, n, settings.source_bins)
        for s, lang, n in zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
    ])
    return text, page


PACKED = ["place", "text", "page"]


def features(docs: DataFrame, settings: Settings) -> DataFrame:
    """Documents (COLUMNS) as their id, its hash and packed features; a quality column stays."""
    more = [c for c in docs.columns if c == "quality"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                for at in range(0, part.num_rows, ROWS):
                    rows = part.slice(at, ROWS)
                    text, page = _views(rows, settings)
                    yield pa.RecordBatch.from_arrays([
                        *[rows.column(c) for c in ("doc_id", "place", *more)], pa.array([t.astype(np.float16).tobytes() for t in text]),
                        pa.array([np.packbits(p > 0).tobytes() for p in page]),
                    ], names=["doc_id", "place", *more, "text", "page"])

    columns = ["doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), F.xxhash64("doc_id").alias("place")]
    return docs.select(*columns, *more).mapInArrow(
        run, f"doc_id {kind}, place long, " + "quality int, " * len(more) + "text binary, page binary")


def _numbers(text: list[bytes], page: list[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    n_page = 1 + settings.source_bins + LANGUAGES + LENGTHS
    bits = np.frombuffer(b"".join(page), np.uint8).reshape(len(page), -1 if page else (n_page + 7) // 8)
    return (np.frombuffer(b"".join(text), np.float16).reshape(len(text), DENSE + settings.text_bins).astype(np.float32),
            np.unpackbits(bits, axis=1)[:, :n_page].astype(np.float32))


def _unpacked(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            yield rows, _numbers(rows.column("text").to_pylist(), rows.column("page").to_pylist(), settings)


def _sample(rows: list, settings: Settings) -> Sample:
    """In an order that does not depend on tasks."""
    found = sorted(rows, key=lambda r: (r["place"], r["quality"], bytes(r["text"]), bytes(r["page"])))
    text, page = _numbers([bytes(r["text"]) for r in found], [bytes(r["page"]) for r in found], settings)
    return Sample(text, page, np.array([r["quality"] for r in found], np.float64))


COLUMNS = ["doc_id", "text", "source", "lang", "n_chars"]


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), stage: Stage = as_is) -> Classifier:
    """A classifier from documents (COLUMNS) and labels (doc_id, quality 0 or 1)."""
    docs = docs.select(*COLUMNS)
    place = F.xxhash64("doc_id")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    # labels of documents that are there, then a bound; at most `labelled` rows of two numbers
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(place, "quality").limit(settings.labelled)
    labelled = features(docs.join(F.broadcast(there), "doc_id"), settings).drop("doc_id").distinct()
    order = ["place", "quality", "text", "page"]
    sample = _sample(labelled.orderBy(*order).limit(settings.labelled).collect(), settings)
    pool = features(docs, settings).join(known.select("doc_id").distinct(), "doc_id", "left_anti").select(*PACKED)
    return co_train(sample, stage(pool, "features"), settings)


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, text_score, page_score, score and kept of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in steps(batch, "text"):
                for at in range(0, part.num_rows, 1000):
                    rows = part.slice(at, 1000)
                    by_text, by_page, both = model.scores(*_views(rows, model.settings))
                    kept = both >= model.settings.least_score if model.views else np.ones(len(both), bool)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id"), *[pa.array(x.astype(np.float64)) for x in (by_text, by_page, both)], pa.array(kept)],
                        names=["doc_id", "text_score", "page_score", "score", "kept"])

    source = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    return source.mapInArrow(run, f"doc_id {kind}, text_score double, page_score double, score double, kept boolean")
