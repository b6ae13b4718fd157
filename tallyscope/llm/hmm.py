"""A hidden Markov language model over words, trained by Baum-Welch on all training texts.

Words fall into ``CLASSES`` classes by checksum.  A state emits classes, and a class emits its words in
proportion to their counts in the whole training corpus, so the vocabulary has no bound while the
model that every task needs has one.  Unseen words share one mass, the share of words seen once.

Texts are staged once as blocks: local word numbers, and the block's distinct words.  Counting and
looking up move a block's distinct words only.  An iteration reads the blocks where they lie; each
task sends its expected counts, at most one row for each class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyscope.llm.common import freed, staged, text_slices

CLASSES = 1 << 16
#: Text bytes of a block, and tokens of a training sequence (a longer text is trained on in parts).
BLOCK_BYTES, SEQUENCE = 4 << 20, 256
#: The end of a text as a token: no word holds white space.
END = b"\n"


def words(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words of a text and the end token; white space is space and tab to carriage return."""
    return [*(text or "").encode().lower().split(), END]


def _blocks(docs: DataFrame, id_col: str, text_col: str, training: Column) -> DataFrame:
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), training.alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1, BLOCK_BYTES):
            tokens, sizes = [], []
            for text in part.column(1).to_pylist():
                found = words(text)
                tokens += found
                sizes.append(len(found))
            coded = pa.array(tokens, pa.binary()).dictionary_encode()
            del tokens
            numbers, vocabulary = coded.indices.to_numpy().astype(np.int32), coded.dictionary
            train = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(numbers[np.repeat(train, sizes)], minlength=len(vocabulary))
            classes = np.array([zlib.crc32(w) % CLASSES for w in vocabulary.to_pylist()], np.int32)
            one = lambda values, t: pa.array([values], pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays([0, part.num_rows], part.column(0)), one(sizes, pa.int32()), one(train, pa.bool_()),
                    pa.array([numbers.tobytes()], pa.binary()), pa.array([classes.tobytes()], pa.binary()),
                    pa.ListArray.from_arrays([0, len(vocabulary)], vocabulary), one(counts, pa.int64()),
                ],
                names=["ids", "sizes", "train", "numbers", "classes", "vocabulary", "counts"],
            )

    schema = f"ids array<{kind.simpleString()}>, sizes array<int>, train array<boolean>, numbers binary, classes binary, vocabulary array<binary>, counts array<bigint>"
    return staged(source.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "blocks")


class Model(NamedTuple):
    start: np.ndarray  # probability of each state at the beginning
    moves: np.ndarray  # row: state, column: next state
    emits: np.ndarray  # row: class, and a last row of ones for unseen words; column: state


def _first_model(class_counts: np.ndarray, states: int, seed: int) -> Model:
    """Nearly uniform: states that last, and class shares disturbed by a seeded noise."""
    noise = np.exp(np.random.default_rng(seed).normal(0, 0.5, (CLASSES, states)))
    emits = class_counts[:, None] * noise
    moves = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(moves, 0.9)
    emits = emits / np.maximum(emits.sum(axis=0), 1e-300)
    return Model(np.full(states, 1 / states), moves, np.vstack([emits, np.ones(states)]))


def _parts(sizes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the training sequences of a block, and whether a text begins there."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[train]
    pieces = -(-sizes[train] // SEQUENCE)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(starts, pieces) + nth * SEQUENCE, np.minimum(SEQUENCE, np.repeat(sizes[train], pieces) - nth * SEQUENCE), nth == 0


def _long_run(moves: np.ndarray) -> np.ndarray:
    """The share of each state far inside a text: the limit of the moves, by repeated squaring."""
    power = moves
    for _ in range(30):
        power = power @ power
        power = power / power.sum(axis=1, keepdims=True)
    return power.mean(axis=0)


def expected(model: Model, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, opens: np.ndarray):
    """Expected counts (first states, moves, class emissions) and log likelihood of the sequences, all
    stepped together, the longer ones first so that those still running are a prefix.  Sequences that
    do not open a text begin with the long-run shares of the states, and do not count as first."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, opens = starts[order], sizes[order], opens[order]
    k, longest = len(model.start), int(sizes.max(initial=0))
    running = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences longer than t
    emits, moves = model.emits.astype(np.float32), model.moves.astype(np.float32)
    alphas, scales, likelihood = [], [], 0.0
    alpha = np.where(opens[:, None], model.start, _long_run(model.moves)).astype(np.float32)
    for t in range(longest):
        n = running[t]
        alpha = (alpha[:n] @ moves if t else alpha) * emits[classes[starts[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        alphas.append(alpha)
        scales.append(scale)
        likelihood += float(np.log(scale, dtype=np.float64).sum())
    first, pairs = np.zeros(k), np.zeros((k, k))
    seen, weights = [], []
    beta = np.ones((0, k), np.float32)
    for t in reversed(range(longest)):
        n = running[t]
        if len(beta) < n:  # sequences that end here
            beta = np.vstack([beta, np.ones((n - len(beta), k), np.float32)])
        gamma = alphas[t] * beta
        which = classes[starts[:n] + t]
        seen.append(which)
        weights.append(gamma)
        back = emits[which] * beta / scales[t][:, None]
        if t:
            pairs += alphas[t - 1][:n].T @ back
            beta = back @ moves.T
        else:
            first = gamma[opens[:n]].sum(axis=0, dtype=np.float64)
    emitted = np.zeros((CLASSES, k))
    if seen:
        where, gammas = np.concatenate(seen), np.concatenate(weights)
        for state in range(k):
            emitted[:, state] = np.bincount(where, gammas[:, state], minlength=CLASSES)
    return first, pairs * moves, emitted, likelihood


def _iterate(blocks: DataFrame, model: Model, shares: np.ndarray, prior: float) -> Model:
    """One round of Baum-Welch: expected counts of all tasks, summed by class, make the next model."""
    states = len(model.start)
    sums = [f"s{i}" for i in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted, others = np.zeros((CLASSES, states)), np.zeros((states + 1, states))
        for batch in batches:
            for row in range(batch.num_rows):
                numbers = np.frombuffer(batch.column(0)[row].as_buffer(), np.int32)
                classes = np.frombuffer(batch.column(1)[row].as_buffer(), np.int32)[numbers]
                sizes = batch.column(2)[row].values.to_numpy().astype(np.int64)
                train = batch.column(3)[row].values.to_numpy(zero_copy_only=False).astype(bool)
                first, pairs, counts, _ = expected(model, classes, *_parts(sizes, train))
                emitted += counts
                others[0] += first
                others[1:] += pairs
        # classes that occurred, and below zero the first states and the moves
        met = np.flatnonzero(emitted.any(axis=1))
        keys = np.concatenate([met, -1 - np.arange(states + 1)])
        values = np.vstack([emitted[met], others])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(v) for v in values.T]], names=["key", *sums])

    sent = blocks.select("numbers", "classes", "sizes", "train").mapInArrow(run, "key int, " + ", ".join(f"{s} double" for s in sums))
    rows = sent.groupBy("key").agg(*[F.sum(s).alias(s) for s in sums]).toPandas()  # at most CLASSES + states + 1
    keys, values = rows["key"].to_numpy(), rows[sums].to_numpy(float)
    emitted, others = np.zeros((CLASSES, states)), np.zeros((states + 1, states))
    emitted[keys[keys >= 0]] = values[keys >= 0]
    others[-1 - keys[keys < 0]] = values[keys < 0]
    start = (others[0] + 1) / (others[0] + 1).sum()
    moves = (others[1:] + 1) / (others[1:] + 1).sum(axis=1, keepdims=True)
    emits = (emitted + prior * shares[:, None]) / (emitted.sum(axis=0) + prior)
    return Model(start, moves, np.vstack([emits, np.ones(states)]))


def log_forward(model: Model, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each text by the scaled forward recursion, over all of its tokens."""
    order = np.argsort(-sizes, kind="stable")
    starts, longest = (np.cumsum(sizes) - sizes)[order], int(sizes.max(initial=0))
    running = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    total = np.zeros(len(sizes))
    alpha = np.tile(model.start, (len(sizes), 1))
    for t in range(longest):
        n = running[t]
        alpha = (alpha[:n] @ model.moves if t else alpha) * model.emits[classes[starts[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha = alpha / scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(sizes))
    out[order] = total
    return out


def score(docs: DataFrame, training: Column, states: int = 8, rounds: int = 6, prior: float = 100.0, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text, learned from the
    rows where ``training`` holds.  Scores are log10 probabilities; the base is a smoothed unigram.

    A null or empty text is its end token alone; null ids are kept; repeated rows are learned from as
    often as they occur and get equal scores; an empty table gives no rows; without training rows all
    tokens are unseen and both scores are 0.  Only the named columns and those of ``training`` are read.
    Training cuts longer texts every ``SEQUENCE`` tokens, and only the first part of a text counts for
    its first state; scoring follows each text from end to end.
    """
    kind = docs.schema[id_col].dataType
    blocks = _blocks(docs, id_col, text_col, training)
    pairs = blocks.select(F.explode(F.arrays_zip("vocabulary", "counts")).alias("e")).select(F.col("e.vocabulary").alias("word"), F.col("e.counts").alias("n"))
    counts = staged(pairs.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "words")
    freed(docs.sparkSession)
    # the blocks' words meet the counts once, before the rounds: the shuffles behind them are dropped by then
    places = blocks.select("block", F.posexplode("vocabulary").alias("place", "word"))
    known = staged(places.join(counts, "word").groupBy("block").agg(F.collect_list(F.struct("place", "n")).alias("known")), "known")
    freed(docs.sparkSession)
    n, v, once = (x or 0 for x in counts.agg(F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first())
    by_class = counts.groupBy((F.crc32("word") % CLASSES).cast("int").alias("class")).agg(F.sum("n").alias("n")).toPandas()
    class_counts = np.zeros(CLASSES)
    class_counts[by_class["class"].to_numpy()] = by_class["n"].to_numpy()
    shares = class_counts / max(n, 1)
    unseen = (once + 1) / (n + 2) if n else 1.0
    model = _first_model(class_counts, states, seed)
    for _ in range(rounds if n else 0):
        model = _iterate(blocks, model, shares, prior)
        freed(docs.sparkSession)

    joined = blocks.select("block", "ids", "sizes", "numbers", "classes").join(known, "block", "left").drop("block")
    floor = np.log10(n + 0.1 * (v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes = batch.column(1)[row].values.to_numpy().astype(np.int64)
                numbers = np.frombuffer(batch.column(2)[row].as_buffer(), np.int32)
                classes = np.frombuffer(batch.column(3)[row].as_buffer(), np.int32).copy()
                count = np.zeros(len(classes))
                if batch.column(4)[row].is_valid:
                    found = batch.column(4)[row].values
                    count[found.field("place").to_numpy()] = found.field("n").to_numpy()
                base = np.log10(count + 0.1) - floor
                is_known = count > 0
                within = np.full(len(classes), np.log10(unseen))
                within[is_known] = np.log10((1 - unseen) * count[is_known] / class_counts[classes[is_known]])
                classes[~is_known] = CLASSES
                firsts = np.cumsum(sizes) - sizes
                total = lambda x: np.add.reduceat(x[numbers], firsts)  # noqa: B023, E731
                forward = log_forward(model, classes[numbers], sizes) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[row].values.cast(to_arrow_type(kind)), pa.array(sizes), pa.array(total(is_known.astype(np.int64))),
                        pa.array(total(base)), pa.array(total(within) + forward),
                    ],
                    names=["id", "n_tokens", "n_known", "base_score", "score"],
                )

    scored = joined.select("ids", "sizes", "numbers", "classes", "known").mapInArrow(
        run, f"id {kind.simpleString()}, n_tokens bigint, n_known bigint, base_score double, score double"
    )
    return scored.select("id", "n_tokens", "n_known", F.lit(int(n)).cast("bigint").alias("train_tokens"), "base_score", "score")
