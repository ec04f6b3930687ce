"""Language-model scores of documents: a log-bilinear model trained with noise-contrastive estimation.

Vocabulary.  The most frequent words are symbols of the model; every other word
stands for the bucket of its last two bytes, and is told apart inside it by how
often it occurs in training.  Symbols lie in classes by frequency, and

    p(word | context) = p(class | context) * p(symbol | class, context) * p(word | bucket)

where the last factor is 1 for a word that is a symbol of its own.  All three
are normalised, so a score is the log-probability of a text, an unseen word
taking the one share that each bucket keeps for it.

Model.  The vectors of the last CONTEXT symbols, each scaled per position, add up
to a prediction; its products with the vectors of classes and symbols, plus
biases, are the logits.  Biases start at the frequencies, so training starts at
the unigram model.

Training.  Each task runs over its share of the training tokens with noise drawn
from the frequencies and tells data from noise (no normalisation), AdaGrad in
batches; the tasks' models are averaged, weighted by tokens, in a tree of small
groups, and the next round starts from the mean.  All training tokens are used.
A model has a fixed size, whatever the corpus.

Scoring.  Batched matrix products give the logits of all classes and, per class,
of its symbols; their log-sums normalise.

Counts cover all training words.  At most ``head`` words, those above a
frequency that a histogram of powers of two decides, travel to the tasks; the
words below are joined with their counts by a shuffle in which, being rare, none
is hot.

Defined results: a null text counts as an empty one, which has one token, the
end; a null id counts as an empty text for the split; repeated rows are scored
each, and counted each if they are in training; without training tokens every
score is that of the frequencies of nothing (all words unseen); an empty table
gives an empty one.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytewake.llm import shared_files
from bytewake.llm.common import steps, texts
from bytewake.staging import Stage

END = b""  # no word is empty
SMOOTH = 0.1
FLUSH = 400_000
FAN_IN = 16
#: places whose logits stay in a core's cache
CACHED = 2048


@dataclass(frozen=True)
class Settings:
    head: int = 1 << 18
    classes: int = 64
    class_size: int = 64
    buckets: int = 32
    context: int = 3
    dim: int = 16
    noise: int = 16
    rounds: int = 2
    batch: int = 16_384
    rate: float = 0.1
    seed: int = 7

    @property
    def symbols(self) -> int:
        return self.classes * self.class_size


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: only A-Z are lowered, only the six white-space characters split


def bucket_of(word: bytes, buckets: int) -> int:
    return zlib.crc32(word[-2:]) % buckets


def bucket_column(word: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.substring(word, -2, 2)), F.lit(buckets)).cast("int")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


# ---- vocabulary


def count_words(training: DataFrame, text: str) -> DataFrame:
    """(word, c) over all training texts, the end among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for part in steps(batch, text):
                for t in texts(part, text):
                    found.update(words_of(t))
                found[END] += part.num_rows
                if len(found) > FLUSH:
                    yield _counted(found)
                    found.clear()
        yield _counted(found)

    return training.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _counted(found: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


@dataclass
class Vocabulary:
    """What each task knows: the frequent words with their logs, and the buckets."""

    total: int
    distinct: int
    settings: Settings
    index: dict[bytes, int]  # of head words
    base: np.ndarray  # log10 of the base probability of each head word
    symbol: np.ndarray
    inside: np.ndarray  # log10 of p(word | bucket), 0 for symbols
    bucket_symbol: np.ndarray
    bucket_norm: list[float]  # log10 of what counts of a bucket are divided by
    symbol_counts: np.ndarray = field(repr=False, default=None)

    @property
    def base_norm(self) -> float:
        return float(np.log10(self.total + SMOOTH * (self.distinct + 1)))


def head_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words, at most ``most``: all whose count is in the upper steps of a histogram."""
    level = F.floor(F.log2(F.col("c")) * 16).cast("int")  # at most 16 * 63 levels
    left, lowest = most, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        lowest = row["level"]
    if lowest is None:
        return []
    rows = counts.where(level >= lowest).select("word", "c").collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda r: (-r[1], r[0]))


def vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = head_words(counts, settings.head)
    # words of their own: the most frequent ones; the end always
    own = settings.symbols - settings.buckets
    chosen = [w for w, _ in head[:own]]
    if END not in chosen:
        chosen = [END, *chosen[:own - 1]]
    count_of = dict(head)
    # all words per bucket, less those that are symbols of their own
    sizes = np.zeros((settings.buckets, 2), np.int64)
    for row in counts.groupBy(bucket_column(F.col("word"), settings.buckets).alias("b")).agg(F.sum("c"), F.count("*")).collect():
        sizes[row[0]] += row[1], row[2]
    for word in chosen:
        if word in count_of:
            sizes[bucket_of(word, settings.buckets)] -= count_of[word], 1
    ranked = sorted(
        [(count_of.get(w, 0), 1, w) for w in chosen] + [(int(sizes[b, 0]), 0, b) for b in range(settings.buckets)],
        key=lambda x: (-x[0], x[1], x[2] if isinstance(x[2], bytes) else bytes([x[2] % 256])))
    symbol_of, bucket_symbol = {}, np.zeros(settings.buckets, np.int64)
    for i, (_, is_word, name) in enumerate(ranked):
        if is_word:
            symbol_of[name] = i
        else:
            bucket_symbol[name] = i
    symbol_counts = np.zeros(settings.symbols)
    symbol_counts[:len(ranked)] = [c for c, _, _ in ranked]
    norm = [float(np.log10(n + SMOOTH * (v + 1))) for n, v in sizes]
    words = list(count_of) + ([END] if END not in count_of else [])
    logs = np.log10(np.array([count_of.get(w, 0) for w in words]) + SMOOTH)
    buckets = [bucket_of(w, settings.buckets) for w in words]
    symbol = np.array([symbol_of.get(w, bucket_symbol[b]) for w, b in zip(words, buckets)], np.int64)
    return Vocabulary(
        total, distinct, settings, {w: i for i, w in enumerate(words)},
        logs - np.log10(total + SMOOTH * (distinct + 1)), symbol,
        np.array([0.0 if w in symbol_of else x - norm[b] for w, b, x in zip(words, buckets, logs)]),
        bucket_symbol, norm, symbol_counts,
    )


ENCODED = "row long, doc_id {id}, held_out boolean, n_tokens long, known long, base double, inside double, symbols binary, rare array<struct<word:binary,n:long>>"


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Texts as symbols, with the sums over frequent words and the rare words left to join. Needs row, doc_id, held_out, text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        get, n_buckets = vocab.index.get, vocab.settings.buckets
        end = vocab.index[END]
        known_end = vocab.symbol_counts[vocab.symbol[end]] > 0
        for batch in batches:
            for part in steps(batch, "text"):
                rows: list[list] = [[] for _ in range(6)]
                for t in texts(part, "text"):
                    words = words_of(t)
                    at = np.array([get(w, -1) for w in words] + [end], np.int64)
                    symbols = vocab.symbol[at]
                    missing = np.flatnonzero(at < 0).tolist()
                    rare = Counter(words[i] for i in missing)
                    for i in missing:
                        symbols[i] = vocab.bucket_symbol[bucket_of(words[i], n_buckets)]
                    frequent = at[at >= 0]
                    values = [
                        len(at), len(frequent) - (not known_end), float(vocab.base[frequent].sum()),
                        float(vocab.inside[frequent].sum()), symbols.astype("<u2").tobytes(),
                        [{"word": w, "n": n} for w, n in rare.items()],
                    ]
                    for column, value in zip(rows, values):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), rare_type]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("row", "doc_id", "held_out")] + [pa.array(c, k) for c, k in zip(rows, kinds)],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "inside", "symbols", "rare"])

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, ENCODED.format(id=docs.schema["doc_id"].dataType.simpleString()))


# ---- model


class Model:
    """Parameters of fixed shapes; ``names`` in the order in which they are packed."""

    names = ("input", "scale", "class_out", "class_bias", "out", "bias")

    def __init__(self, settings: Settings, counts: np.ndarray):
        s = settings
        rng = np.random.default_rng(s.seed)
        self.settings = s
        self.input = rng.normal(0, 0.3, (s.symbols + 1, s.dim)).astype(np.float32)  # the last one stands before a text
        self.scale = np.full((s.context, s.dim), 1 / s.context, np.float32)
        self.class_out = np.zeros((s.classes, s.dim), np.float32)
        self.out = np.zeros((s.symbols, s.dim), np.float32)
        smooth = (counts + SMOOTH).reshape(s.classes, s.class_size)
        self.class_share = smooth.sum(1) / smooth.sum()
        self.share = smooth / smooth.sum(1, keepdims=True)
        self.class_bias = np.log(self.class_share).astype(np.float32)
        self.bias = np.log(self.share).reshape(-1).astype(np.float32)

    def pack(self) -> bytes:
        buffer = io.BytesIO()
        for name in self.names:
            buffer.write(getattr(self, name).astype("<f4").tobytes())
        return buffer.getvalue()

    def unpack(self, data: bytes) -> Model:
        at = 0
        for name in self.names:
            old = getattr(self, name)
            setattr(self, name, np.frombuffer(data, "<f4", old.size, at).reshape(old.shape).copy())
            at += old.nbytes
        return self

    def predict(self, padded: np.ndarray, n: int) -> np.ndarray:
        """Predictions for the ``n`` places of ``padded`` after its first CONTEXT ones."""
        vectors = self.input[padded]
        k = self.settings.context
        return sum(self.scale[j - 1] * vectors[k - j:k - j + n] for j in range(1, k + 1))

    def log_probabilities(self, padded: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """Natural log-probabilities, normalised, of the symbols at the ``counted`` places after the first CONTEXT ones."""
        places = np.flatnonzero(counted)
        predicted = self.predict(padded, len(counted))[places]
        target = padded[self.settings.context:][places]
        n, size = len(places), self.settings.class_size
        group = target // size
        out = np.zeros(n)
        for a in range(0, n, CACHED):
            b = min(a + CACHED, n)
            out[a:b] = _log_shares(predicted[a:b], self.class_out, self.class_bias, group[a:b])
        for c, rows in _groups(group):
            block = slice(c * size, (c + 1) * size)
            for a in range(0, len(rows), CACHED):
                some = rows[a:a + CACHED]
                out[some] += _log_shares(predicted[some], self.out[block], self.bias[block], target[some] - c * size)
        return out


def _log_shares(predicted: np.ndarray, vectors: np.ndarray, bias: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probabilities of the targets; places lie along the rows, where numpy is fastest."""
    logits = vectors @ predicted.T + bias[:, None]
    chosen = logits[target, np.arange(len(target))]
    top = logits.max(0)
    logits -= top
    shares = np.exp(logits, out=logits)
    if len(vectors) % 8 or len(vectors) > 128:
        return chosen - (top + np.log(np.ascontiguousarray(shares.T).sum(1)))
    s = shares.reshape(-1, 8, len(target)).sum(0)  # in the order in which numpy adds up a row, so that scores stay the same
    return chosen - (top + np.log(((s[0] + s[1]) + (s[2] + s[3])) + ((s[4] + s[5]) + (s[6] + s[7]))))


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0; small ones are sorted by digits."""
    small = len(values) and values.max() <= np.iinfo(np.uint16).max
    return np.argsort(values.astype(np.uint16) if small else values, kind="stable")


def _groups(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = _order(values)
    ranked = values[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else []
    for a, b in zip(first, [*first[1:], len(ranked)]):
        yield int(ranked[a]), order[a:b]


def _sum_rows(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(at):
        order = _order(at)
        ranked = at[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        out[ranked[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation with AdaGrad, a batch at a time."""

    def __init__(self, model: Model, rng: np.random.Generator):
        self.model, self.rng = model, rng
        self.squares = {name: np.full(getattr(model, name).shape, 1.0, np.float32) for name in model.names}
        self.tokens = 0

    def contrast(self, predicted: np.ndarray, target: np.ndarray, vectors: np.ndarray, bias: np.ndarray, share: np.ndarray):
        """Gradients of telling each target from the same noise: for predictions, vectors and biases."""
        k = self.model.settings.noise
        noise = self.rng.choice(len(share), k, p=share)
        offset = bias - np.log(k * share).astype(np.float32)
        own, other = vectors[target], vectors[noise]
        data = (predicted * own).sum(1) + offset[target]
        pull = 1 / (1 + np.exp(np.clip(data, -30, 30)))  # 1 - P(data)
        push = predicted @ other.T + offset[noise]
        np.clip(push, -30, 30, out=push)
        np.exp(np.negative(push, out=push), out=push)
        push += 1
        np.divide(-1, push, out=push)
        g_predicted = pull[:, None] * own + push @ other
        g_vectors = _sum_rows(target, pull[:, None] * predicted, len(vectors))
        np.add.at(g_vectors, noise, push.T @ predicted)
        g_bias = np.bincount(target, pull, len(vectors)) + np.bincount(noise, push.sum(0), len(vectors))
        return g_predicted, g_vectors, g_bias.astype(np.float32)

    def step(self, padded: np.ndarray, counted: np.ndarray) -> None:
        """One batch; ``counted`` marks the places after the first CONTEXT ones that are targets."""
        m, s = self.model, self.model.settings
        n = len(padded) - s.context
        vectors = m.input[padded]
        predicted = m.predict(padded, n)
        places = np.flatnonzero(counted)
        if not len(places):
            return
        used, target = predicted[places], padded[s.context:][places]
        group = target // s.class_size
        g_used, g_class, g_class_bias = self.contrast(used, group, m.class_out, m.class_bias, m.class_share)
        g_out, g_bias = np.zeros_like(m.out), np.zeros_like(m.bias)
        for c, rows in _groups(group):
            block = slice(c * s.class_size, (c + 1) * s.class_size)
            g, g_out[block], g_bias[block] = self.contrast(
                used[rows], target[rows] - c * s.class_size, m.out[block], m.bias[block], m.share[c])
            g_used[rows] += g
        g_predicted = np.zeros_like(predicted)
        g_predicted[places] = g_used
        g_places = np.zeros_like(vectors)
        g_scale = np.zeros_like(m.scale)
        for j in range(1, s.context + 1):
            a = s.context - j
            g_places[a:a + n] += g_predicted * m.scale[j - 1]
            g_scale[j - 1] = (g_predicted * vectors[a:a + n]).sum(0)
        grads = {
            "input": _sum_rows(padded, g_places, len(m.input)), "scale": g_scale, "class_out": g_class,
            "class_bias": g_class_bias, "out": g_out, "bias": g_bias,
        }
        for name, g in grads.items():
            self.squares[name] += g * g
            getattr(m, name)[...] += s.rate * g / np.sqrt(self.squares[name])
        self.tokens += len(places)


def sequences(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(padded, counted): texts one after another, each behind CONTEXT padding symbols, in pieces of a batch."""
    pad = np.full(settings.context, settings.symbols, np.int64)
    held, marks = pad, np.zeros(settings.context, bool)
    for batch in batches:
        for data in batch.column("symbols").to_pylist():
            symbols = np.frombuffer(data, "<u2").astype(np.int64)
            held = np.concatenate([held, symbols, pad])
            marks = np.concatenate([marks, np.ones(len(symbols), bool), np.zeros(len(pad), bool)])
            while len(held) >= settings.batch + settings.context:
                cut = settings.batch + settings.context
                yield held[:cut], marks[settings.context:cut]
                held, marks = held[settings.batch:], marks[settings.batch:]
    yield held, marks[settings.context:]


def train(encoded: DataFrame, vocab: Vocabulary, stage: Stage) -> bytes:
    """Packed parameters after all rounds over the training texts of a table made by ``encode``."""
    s, counts = vocab.settings, vocab.symbol_counts
    state = Model(s, counts).pack()
    spark = encoded.sparkSession
    for r in range(s.rounds):
        start = spark.sparkContext.broadcast(state)
        share = encoded.where(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(s.rounds)) == r)).select("symbols")

        def run(batches: Iterator[pa.RecordBatch], start=start, r=r) -> Iterator[pa.RecordBatch]:
            part = shared_files.partition()
            trainer = Trainer(Model(s, counts).unpack(start.value), np.random.default_rng([s.seed, r, part]))
            for padded, counted in sequences(batches, s):
                trainer.step(padded, counted)
            if trainer.tokens:
                yield _trained(part, trainer.tokens, trainer.model.pack())

        trained = stage(share.mapInArrow(run, TRAINED), f"round-{r}")
        levels, width = 1, share.rdd.getNumPartitions()
        while width > FAN_IN:
            width, levels = -(-width // FAN_IN), levels + 1
        for _ in range(levels):
            trained = trained.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(_mean, TRAINED)
        found = trained.collect()  # one row of a fixed size
        state = bytes(found[0]["state"]) if found else state
        start.unpersist()
    return state


TRAINED = "part long, tokens long, state binary"


def _trained(part: int, tokens: int, state: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([state], pa.binary())], names=["part", "tokens", "state"])


def _mean(models: pa.Table) -> pa.Table:
    """At most FAN_IN models, weighted by the tokens they saw."""
    total, mean = 0, 0.0
    for tokens, state in zip(models.column("tokens").to_pylist(), models.column("state").to_pylist()):
        total += tokens
        mean = mean + tokens * np.frombuffer(state, "<f4").astype(np.float64)
    packed = (mean / total).astype("<f4").tobytes()
    return pa.Table.from_batches([_trained(models.column("part")[0].as_py(), total, packed)])


def score_symbols(encoded: DataFrame, vocab: Vocabulary, state: bytes) -> DataFrame:
    """Rows of ``encoded`` with ``model``, the log10 probability of the symbols."""
    shared = encoded.sparkSession.sparkContext.broadcast(state)
    s, counts = vocab.settings, vocab.symbol_counts
    columns = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "inside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(s, counts).unpack(shared.value)
        for batch in batches:
            sizes = batch.column("n_tokens").to_numpy()
            sums = np.zeros(batch.num_rows)
            owner, at = np.repeat(np.arange(batch.num_rows), sizes), 0
            for padded, counted in sequences(iter([batch]), s):
                logs = model.log_probabilities(padded, counted)
                sums += np.bincount(owner[at:at + len(logs)], logs, batch.num_rows)
                at += len(logs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [pa.array(sums / np.log(10))], names=[*columns, "model"])

    schema = ENCODED.format(id=encoded.schema["doc_id"].dataType.simpleString()).replace(", symbols binary, rare array<struct<word:binary,n:long>>", ", model double")
    return encoded.select(*columns, "symbols").mapInArrow(run, schema)


def score(docs: DataFrame, stage: Stage, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn(
        "held_out", held_out(F.col("doc_id")))
    counts = stage(count_words(source.where(~F.col("held_out")), "text"), "counts")
    vocab = vocabulary(counts, settings)
    encoded = stage(encode(source.withColumn("row", F.monotonically_increasing_id()), vocab), "encoded")
    state = train(encoded, vocab, stage)

    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    log = F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)
    norms = F.array(*map(F.lit, vocab.bucket_norm))
    inside = log - F.element_at(norms, bucket_column(F.col("word"), settings.buckets) + 1)
    sums = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * (log - vocab.base_norm)).alias("rare_base"), F.sum(F.col("n") * inside).alias("rare_inside"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return score_symbols(encoded, vocab, state).join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("rare_known")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"), (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("model") + F.col("inside") + zero("rare_inside")).alias("score"),
    )
