"""A hidden Markov language model: latent states trained by Baum-Welch, texts scored by the forward recursion.

Words are counted over all training texts. The most frequent become symbols of their own; all others share
one symbol, behind which a word has its smoothed share of that class, so every text has an exact
probability. A further symbol ends a text. Baum-Welch counts, expected under the current model, are
gathered per partition and summed per symbol; what returns to the driver is bounded by states and symbols,
not by data. Training walks through texts in windows of ``WINDOW`` tokens so that many are
stepped at once. A window inside a text starts from the last token of the one before, with a start
distribution of its own, so every token and every step of every training text is counted once. Scoring
runs over whole texts without windows.

Counts of the most frequent words, at most ``KNOWN`` and of bounded length, are sent to all tasks. Any other word is looked
up by a join, so the vocabulary has no limit.

Defined cases: a null or empty text is the end symbol alone; a null id counts as id text ``""``; repeated rows
are counted and scored one by one; without training texts all probabilities come from the smoothing; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netwarden.plans.scale import stage

STATES = 8
SYMBOLS = 1 << 14
ROUNDS = 6
WINDOW = 512
# Words whose counts every task holds, and the longest of them in bytes: at most 24 MB.
KNOWN, KNOWN_BYTES = 1 << 18, 64
# Ranges of hashes that words of about one count are taken by, where not all of them fit.
TIE_RANGES = 4_096
# Weight of the overall word shares in each state's emissions, and of every transition.
PRIOR, STEP_PRIOR = 50.0, 1.0
# Different words a task counts before it hands its counts on, and windows that are stepped together.
HELD_WORDS, TOGETHER = 200_000, 512


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, c)`` of the column ``text`` (binary); tasks add up before anything is shuffled."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update((text.as_py() or b"").lower().split())
                if len(counts) > HELD_WORDS:
                    yield flush(counts)
                    counts.clear()
        yield flush(counts)

    def flush(counts):
        words, numbers = pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())
        return pa.RecordBatch.from_arrays([words, numbers], ["word", "c"])

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The most frequent words of bounded length, at most ``most``.

    Words are counted by the size of their count, in at most a thousand steps, so that no task has to
    rank them. Of the step that does not fit as a whole, those ranges of the words' hash are
    taken that still fit, so that words of one count do not push each other out.
    """
    sized = counts.where(F.octet_length("word") <= KNOWN_BYTES).withColumn(
        "step", F.floor(F.log2("c") * 16).cast("int")
    )
    steps = {r["step"]: r["count"] for r in sized.groupBy("step").count().collect()}
    lowest, left = 1 << 30, most
    wanted = F.lit(False)
    for step in sorted(steps, reverse=True):
        if steps[step] > left:
            place = F.pmod(F.xxhash64("word"), F.lit(TIE_RANGES)).cast("int")
            ranges = sized.where(F.col("step") == step).groupBy(place.alias("place")).count().collect()
            upto = 0
            for r in sorted(ranges):
                if r["count"] > left:
                    break
                left, upto = left - r["count"], r["place"] + 1
            wanted = (F.col("step") == step) & (place < upto)
            break
        lowest, left = step, left - steps[step]
    top = sized.where((F.col("step") >= lowest) | wanted).select("word", "c").toArrow()
    return list(zip(top.column("word").to_pylist(), top.column("c").to_pylist()))


class Vocabulary:
    """What tasks need to turn words into symbols and shares; bounded by ``KNOWN``."""

    def __init__(self, counts: DataFrame, ends: int, symbols: int = SYMBOLS, known: int = KNOWN):
        top = sorted(_frequent(counts, known), key=lambda r: (-r[1], r[0]))
        self.words = [word for word, _ in top]
        self.counts = np.array([c for _, c in top], np.float64)
        whole = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
        self.ends = ends
        self.total = int(whole[1]) + ends
        self.distinct = int(whole[0]) + (ends > 0)
        self.symbols = min(symbols, len(self.words))
        self.other, self.end = self.symbols, self.symbols + 1
        self.other_total = int(whole[1] - self.counts[: self.symbols].sum())
        self.other_distinct = int(whole[0]) - self.symbols
        # log10 of the denominators: of the base score, and inside the class of other words.
        self.base_log = float(np.log10(self.total + self.distinct + 1))
        self.other_log = float(np.log10(self.other_total + self.other_distinct + 1))

    def shares(self) -> np.ndarray:
        """Smoothed share of every symbol."""
        counts = np.concatenate([self.counts[: self.symbols], [self.other_total, self.ends]]) + 1
        return counts / counts.sum()


def encode(docs: DataFrame, vocabulary: Vocabulary, id_type: T.DataType) -> DataFrame:
    """Written once: each text as symbols, its sums over known words, and the words to look up.

    ``docs`` has ``id, held_out, text`` (binary). ``row`` numbers the rows of the table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", id_type),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("base", T.DoubleType()),
            T.StructField("inner", T.DoubleType()),
            T.StructField("symbols", T.BinaryType()),
            T.StructField("others", T.ArrayType(T.BinaryType())),
        ]
    )

    def run(batches):
        v = shared.value
        number = dict(zip(v.words, range(len(v.words))))
        logs = np.log10(v.counts + 1)
        end_log = float(np.log10(v.ends + 1))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(2):
                words = (text.as_py() or b"").lower().split()
                at = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
                known = at[at >= 0]
                inner = known[known >= v.symbols]
                out[0].append(len(words) + 1)
                out[1].append(len(known) + (v.ends > 0))
                out[2].append(float(logs[known].sum() + end_log - (len(known) + 1) * v.base_log))
                out[3].append(float(logs[inner].sum() - len(inner) * v.other_log))
                symbols = np.where((at < 0) | (at >= v.symbols), v.other, at)
                out[4].append(np.append(symbols, v.end).astype("<u2").tobytes())
                out[5].append([words[i] for i in np.flatnonzero(at < 0).tolist()])
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            columns = [pa.array(x, kind) for x, kind in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(1), *columns], schema.names)

    return stage(docs.select("id", "held_out", "text").mapInArrow(run, schema), "symbols")


class Model:
    """Start, step and emission probabilities; ``later`` starts windows inside a text."""

    def __init__(self, start, later, step, emit):
        self.start, self.later, self.step, self.emit = start, later, step, emit


def first_model(shares: np.ndarray, states: int = STATES) -> Model:
    """Overall shares, slightly different in every state, and states that last."""
    draws = np.random.default_rng(42).normal(0, 0.5, (len(shares), states))
    emit = shares[:, None] * np.exp(draws)
    step = np.full((states, states), 0.02 / max(states - 1, 1))
    np.fill_diagonal(step, 0.98)
    even = np.full(states, 1 / states)
    return Model(even, even, step / step.sum(1, keepdims=True), emit / emit.sum(0))


def forward(model: Model, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 likelihood of sequences that lie in ``flat``; exact, rescaled at every token."""
    order = np.argsort(-sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    likelihood = np.zeros(len(sizes))
    alpha = np.tile(model.start, (len(sizes), 1))
    for t in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -t, "left"))
        alpha = (alpha[:n] @ model.step if t else alpha[:n]) * model.emit[flat[begins[:n] + t]]
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        likelihood[:n] += np.log10(scale)
    out = np.empty_like(likelihood)
    out[order] = likelihood
    return out


def windows(symbols: np.ndarray, length: int = WINDOW):
    """``(window, opens)``: ``length`` tokens each and, inside a text, the token before them."""
    for a in range(0, len(symbols), length):
        yield symbols[max(a - 1, 0) : a + length], a == 0


class Expected:
    """Baum-Welch counts of windows under a model, in single precision per window and double in sum.

    The first token of a window that does not open its text was counted by the window before it.
    """

    def __init__(self, model: Model):
        k = len(model.start)
        self.model = model
        self.start, self.later = np.zeros(k), np.zeros(k)
        self.step, self.emit = np.zeros((k, k)), np.zeros(model.emit.shape)
        self.fast = [x.astype(np.float32) for x in (model.start, model.later, model.step, model.emit)]

    def add(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, opens: np.ndarray) -> None:
        start, later, step, emit = self.fast
        order = np.argsort(-sizes, kind="stable")
        begins, sizes, opens = begins[order], sizes[order], opens[order]
        longest, k = int(sizes[0]), len(start)
        active = [int(np.searchsorted(-sizes, -t, "left")) for t in range(longest)]
        alphas, seen, scales, symbols = [], [], [], []
        alpha = np.where(opens[:, None], start, later)
        for t, n in enumerate(active):
            at = flat[begins[:n] + t]
            e = emit[at]
            alpha = (alpha[:n] @ step if t else alpha) * e
            scale = alpha.sum(1, keepdims=True)
            alpha /= scale
            alphas.append(alpha)
            seen.append(e)
            scales.append(scale)
            symbols.append(at)
        gammas = [alphas[-1]] * longest
        steps = np.zeros((k, k))
        beta = np.ones((active[-1], k), np.float32)
        for t in range(longest - 2, -1, -1):
            n, after = active[t], active[t + 1]
            onward = seen[t + 1] * beta / scales[t + 1]
            steps += alphas[t][:after].T @ onward
            beta = np.ones((n, k), np.float32)
            beta[:after] = onward @ step.T
            gammas[t] = alphas[t] * beta
        gamma, symbol = np.concatenate([gammas[0] * opens[:, None], *gammas[1:]]), np.concatenate(symbols)
        for s in range(k):
            self.emit[:, s] += np.bincount(symbol, gamma[:, s], len(self.emit))
        self.step += steps * self.model.step
        self.start += gammas[0][opens].sum(0)
        self.later += gammas[0][~opens].sum(0)


def improved(rows: DataFrame, model: Model, shares: np.ndarray) -> Model:
    """One round of Baum-Welch over ``symbols`` of all ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    k, m = len(model.start), len(model.emit)

    def run(batches):
        expected = Expected(shared.value)
        pieces, opens = [], []

        def work():
            sizes = np.array([len(p) for p in pieces])
            expected.add(np.concatenate(pieces), np.cumsum(sizes) - sizes, sizes, np.array(opens))
            pieces.clear()
            opens.clear()

        for batch in batches:
            for text in batch.column(0):
                symbols = np.frombuffer(text.as_buffer(), "<u2").astype(np.int64)
                for piece, first in windows(symbols):
                    pieces.append(piece)
                    opens.append(first)
                    if len(pieces) == TOGETHER:
                        work()
        if pieces:
            work()
        met = np.flatnonzero(expected.emit.any(axis=1))
        # Symbols, then steps from each state, then the two start distributions.
        places = np.concatenate([met, m + np.arange(k + 2)])
        values = np.concatenate([expected.emit[met], expected.step, [expected.start, expected.later]])
        columns = [pa.array(places)] + [pa.array(values[:, s]) for s in range(k)]
        yield pa.RecordBatch.from_arrays(columns, ["place", *[f"s{s}" for s in range(k)]])

    schema = "place long, " + ", ".join(f"s{s} double" for s in range(k))
    parts = rows.select("symbols").mapInArrow(run, schema)
    # At most a row per symbol and state.
    summed = parts.groupBy("place").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)]).toArrow()
    counts = np.zeros((m + k + 2, k))
    counts[summed.column("place").to_numpy()] = np.stack([summed.column(f"s{s}").to_numpy() for s in range(k)], 1)
    emit = counts[:m] + PRIOR * shares[:, None]
    step, ends = counts[m : m + k] + STEP_PRIOR, counts[m + k :] + STEP_PRIOR
    start, later = ends / ends.sum(1, keepdims=True)
    return Model(start, later, step / step.sum(1, keepdims=True), emit / emit.sum(0))


def train(rows: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    shares = vocabulary.shares()
    model = first_model(shares, states)
    for _ in range(rounds):
        model = improved(rows, model, shares)
    return model


def _likelihoods(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` without ``symbols``, with their log10 likelihood as ``path``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c not in ("symbols", "others")]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("path", T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = [np.frombuffer(t.as_buffer(), "<u2") for t in batch.column(len(kept))]
            if not texts:
                continue
            sizes = np.array([len(t) for t in texts])
            path = forward(shared.value, np.concatenate(texts), np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(path)], schema.names)

    return rows.select(*kept, "symbols").mapInArrow(run, schema)


def score(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS
) -> DataFrame:
    """Learn from the rows whose ``crc32(id) mod 7`` is not 2 and score all rows."""
    held_out = F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = docs.select(
        F.col(row_id).alias("id"), held_out.alias("held_out"), F.col(text).cast("binary").alias("text")
    )
    learning = rows.where(~F.col("held_out"))
    counts = stage(count_words(learning.select("text")), "words")
    vocabulary = Vocabulary(counts, learning.select("id").count())
    symbols = encode(rows, vocabulary, docs.schema[row_id].dataType)
    model = train(symbols.where(~F.col("held_out")), vocabulary, states, rounds)
    scored = _likelihoods(symbols, model)
    words = symbols.select("row", F.explode("others").alias("word"))
    c = F.coalesce(F.col("c"), F.lit(0))
    looked_up = (
        words.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(c > 0, 1).otherwise(0)).alias("more_known"),
            F.sum(F.log10(c + 1) - F.lit(vocabulary.base_log)).alias("more_base"),
            F.sum(F.log10(c + 1) - F.lit(vocabulary.other_log)).alias("more_inner"),
        )
    )
    zero = F.lit(0.0)
    return scored.join(looked_up, "row", "left").select(
        F.col("id").alias(row_id),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("path") + F.col("inner") + F.coalesce("more_inner", zero)).alias("score"),
    )
