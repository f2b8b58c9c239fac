"""Texts scored by a hidden Markov language model over word classes.

A text is its words (ASCII letters lower-cased, ``[^\\x20\\x09-\\x0D]+``) and one end. A word's class is a hash of its
last ``SUFFIX`` bytes, of ``CLASSES``; the end has a class of its own. The model draws a latent state for each
token, from it a class, and from the class the word: P(word | class) is (c + 1) / (N_k + V_k + 1), with c the
word's count, N_k and V_k the tokens and distinct words of its class in training, so that all words never seen share
one unit of each class.

States are trained by Baum-Welch on every training text, whole: tasks add up expected counts of starts, moves and
emissions of what they read, Spark sums them, and the driver, which holds states x classes numbers whatever the
input, makes the next model. Texts are swept side by side, token by token; one of over ``LONG`` tokens is swept as
runs of ``RUN`` tokens side by side, whose first and last states come from the product of the runs' operators. A text's score is its exact log10 likelihood by the scaled forward
recursion over the whole text, plus that of its words given their classes.

Word counts cover the whole vocabulary: tasks number the words of chunks of about ``CHUNK`` tokens and emit each
once with its count there; a window over the word adds up the counts, and each chunk gets its words' totals back.
So what is shuffled by word is a chunk's vocabulary, not its tokens, and a common word is one row a chunk.

Defined results: a null text counts as empty (one token, the end); a null doc_id is not held out; repeated rows stay,
and count each time; with no training text every word is unseen; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.arrow import cut, held_out, read_table, slices

STATES, CLASSES, SUFFIX, ROUNDS = 8, 2048, 4, 6
RUN, LONG, TOKENS, HELD = 128, 2048, 500_000, 4_000_000
CHUNK, SEED = 1_000_000, 20_090
END, END_CLASS = b"\n", CLASSES - 1
MODULUS, REMAINDER = 7, 2


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def class_of(word: bytes) -> int:
    return END_CLASS if word == END else zlib.crc32(word[-SUFFIX:]) % END_CLASS


NUMBERED = "chunk long, doc_id long, held boolean, ids binary, classes binary, word binary, number int, class int, n long"


def numbered(docs: DataFrame, most: int = CHUNK) -> DataFrame:
    """Two kinds of rows: a document's words as numbers of its chunk and as classes, or a word of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size = TaskContext.get().partitionId() << 32, 0
        place, counts, kinds = defaultdict(), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        place.default_factory = place.__len__
        none = lambda n, t: pa.nulls(n, t)

        def grow() -> None:
            nonlocal counts, kinds
            more = len(place) - len(kinds)
            if more > 0:
                new = list(place)[-more:] if more < len(place) else list(place)
                kinds = np.append(kinds, np.array([class_of(w) for w in new], np.uint16))
                counts = np.append(counts, np.zeros(more, np.int64))

        def words() -> Iterator[pa.RecordBatch]:
            every = list(place)
            for at in range(0, len(every), 10_000):
                own = every[at : at + 10_000]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * n, pa.int64()), none(n, pa.int64()), none(n, pa.bool_()), none(n, pa.binary()), none(n, pa.binary()), pa.array(own, pa.binary()),
                     pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(kinds[at : at + n].astype(np.int32)), pa.array(counts[at : at + n])], names=NAMES)

        for batch in batches:
            for part in slices(batch, 256, 2_000_000):
                held = part.column(2).to_pylist()
                ids = []
                for text in part.column(1):
                    tokens = (text.as_py() or b"").lower().split()
                    tokens.append(END)
                    ids.append(np.array(list(map(place.__getitem__, tokens)), np.int32))
                grow()
                train = [x for x, h in zip(ids, held, strict=True) if not h]
                if train:
                    counts += np.bincount(np.concatenate(train), minlength=len(counts))
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * n, pa.int64()), part.column(0), pa.array(held, pa.bool_()), pa.array([pack(x) for x in ids], pa.binary()), pa.array([pack(kinds[x]) for x in ids], pa.binary()),
                     none(n, pa.binary()), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.int64())], names=NAMES)
                size += sum(map(len, ids))
                if size >= most:
                    yield from words()
                    chunk, size = chunk + 1, 0
                    place.clear()
                    counts, kinds = np.zeros(0, np.int64), np.zeros(0, np.uint16)
        yield from words()

    NAMES = [c.split()[0] for c in NUMBERED.split(", ")]
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(held_out("doc_id", MODULUS, REMAINDER), F.lit(False)).alias("held"))
    return raw.mapInArrow(run, NUMBERED)


class Model:
    """Start, moves and emissions: (S), (S, S) and (classes, S)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def first(totals: np.ndarray) -> Model:
        """States near the classes' frequencies, told apart by seeded noise, that mostly stay."""
        noise = np.random.Generator(np.random.PCG64(SEED)).uniform(0.5, 1.5, (CLASSES, STATES))
        emit = (totals[:, None] + 0.1) * noise
        move = np.full((STATES, STATES), 0.05 / (STATES - 1)) + np.eye(STATES) * (0.95 - 0.05 / (STATES - 1))
        return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + 0.1, move + 0.1, emit + 0.01
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def in_time(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of all sequences by time, bounds of each time in it, the sequence of each); the sequences come from the longest to the shortest."""
    size = np.array([len(s) for s in seqs])
    ends = np.cumsum(size)
    time = (np.arange(ends[-1]) - np.repeat(ends - size, size)).astype(np.int16 if size[0] < 1 << 15 else np.int64)
    order = np.argsort(time, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(time))])
    return np.concatenate(seqs)[order].astype(np.int64), at, np.arange(ends[-1]) - np.repeat(at[:-1], np.diff(at))


def forward(move: np.ndarray, e: np.ndarray, at: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Replaces ``e`` [state, token], likelihoods of the tokens by time, by the states' probabilities so far; returns the scales."""
    scale, back, last = np.empty(e.shape[1], e.dtype), np.ascontiguousarray(move.T), prior
    for s, t in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        a = e[:, s:t]
        a *= last[:, : t - s]
        total = scale[s:t]
        a.sum(0, out=total)
        a /= total
        last = back @ a
    return scale


def sweep(model: Model, seqs: list[np.ndarray], prior: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward over sequences, from the longest: (states at first tokens, moves, emissions).

    Columns of each sequence: ``prior``, of its first state; ``before``, of the state before it, zeros at the begin of a
    text; ``after``, the likelihood of what follows given its last state, up to a factor.
    """
    emit, move = np.ascontiguousarray(model.emit.T.astype(np.float32)), model.move.astype(np.float32)
    x, at, _ = in_time(seqs)
    e = emit[:, x]
    alpha = e.copy()
    scale = forward(move, alpha, at, prior)
    size = np.array([len(q) for q in seqs])
    last = at[size - 1] + np.arange(len(seqs))
    beta = after / (alpha[:, last] * after).sum(0)
    moves, right, bounds = np.zeros((len(move), len(move)), np.float64), None, at.tolist()
    for t in range(len(bounds) - 2, -1, -1):
        s, n = bounds[t], bounds[t + 1] - bounds[t]
        if right is not None:
            beta[:, : right.shape[1]] = move @ right
        right = e[:, s : s + n]
        right *= beta[:, :n]
        right /= scale[s : s + n]
        moves += (alpha[:, bounds[t - 1] : bounds[t - 1] + n] if t else before) @ right.T
        gamma = alpha[:, s : s + n]
        gamma *= beta[:, :n]
    emits = np.stack([np.bincount(x, alpha[k], len(model.emit)) for k in range(len(move))])
    return alpha[:, : at[1]], moves * model.move, emits


def operators(model: Model, runs: list[np.ndarray], leads: np.ndarray) -> np.ndarray:
    """[run, from, to]: what a run makes of the state before it, up to a factor; ``leads``: the begin of a text, whatever is before."""
    emit, move = model.emit.astype(np.float32), model.move.astype(np.float32)
    emit = np.ascontiguousarray(emit / emit.max(1, keepdims=True))
    order = np.argsort([-len(r) for r in runs], kind="stable")
    x, at, _ = in_time([runs[i] for i in order])
    made = np.empty((len(runs), len(move), len(move)), np.float32)
    made[:] = np.where(leads[order, None, None], model.start.astype(np.float32), move)
    for t, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        step = made[: e - s]
        if t:
            step[:] = (step.reshape(-1, len(move)) @ move).reshape(step.shape)
        step *= emit[x[s:e], None, :]
        if t % 8 == 7:
            step /= step.sum((1, 2), keepdims=True)
    out = np.empty_like(made)
    out[order] = made / made.sum((1, 2), keepdims=True)
    return out


def long_texts(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``expected``, for long texts: a run's operator carries the states over it, so that all runs are swept at once."""
    runs = [q[i : i + RUN] for q in seqs for i in range(0, len(q), RUN)]
    many = np.array([-(-len(q) // RUN) for q in seqs])
    lead = np.cumsum(many) - many
    leads, s = np.isin(np.arange(len(runs)), lead), len(model.start)
    step = max(1, TOKENS // RUN)
    parts = [slice(i, i + step) for i in range(0, len(runs), step)]
    made, move = np.concatenate([operators(model, runs[p], leads[p]) for p in parts]), model.move.astype(np.float32)
    before, after = np.zeros((len(runs), s), np.float32), np.ones((len(runs), s), np.float32)
    left = np.full((len(seqs), s), 1 / s, np.float32)
    for t in range(int(many.max()) - 1):  # the state before each next run
        own = np.flatnonzero(many > t + 1)
        here = (left[own, None, :] @ made[lead[own] + t])[:, 0]
        left[own] = before[lead[own] + t + 1] = here / here.sum(1, keepdims=True)
    for t in range(int(many.max()) - 1, 0, -1):  # the likelihood of what follows each run before
        own = np.flatnonzero(many > t)
        here = (made[lead[own] + t] @ after[lead[own] + t][:, :, None])[:, :, 0]
        after[lead[own] + t - 1] = here / here.sum(1, keepdims=True)
    prior = np.where(leads[:, None], model.start.astype(np.float32), before @ move)
    total = [np.zeros(s), np.zeros((s, s)), np.zeros(model.emit.T.shape)]
    for p in parts:
        order = np.argsort([-len(r) for r in runs[p]], kind="stable")
        first, moves, emits = sweep(model, [runs[p][i] for i in order], prior[p][order].T, before[p][order].T, after[p][order].T)
        for t, more in zip(total, (first[:, leads[p][order]].sum(1, dtype=np.float64), moves, emits), strict=True):
            t += more
    return total[0], total[1], total[2]


def expected(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions (states x classes) over whole texts of classes."""
    total = [np.zeros(len(model.start)), np.zeros_like(model.move), np.zeros(model.emit.T.shape)]
    seqs = sorted(seqs, key=len, reverse=True)
    start = 0
    while start < len(seqs):
        long, stop, tokens = len(seqs[start]) > LONG, start, 0
        while stop < len(seqs) and (stop == start or tokens + len(seqs[stop]) <= TOKENS) and (len(seqs[stop]) > LONG) == long:
            tokens += len(seqs[stop])
            stop += 1
        own = seqs[start:stop]
        if long:
            found = long_texts(model, own)
        else:
            n, s = len(own), len(model.start)
            first, moves, emits = sweep(model, own, np.repeat(model.start.astype(np.float32)[:, None], n, 1), np.zeros((s, n), np.float32), np.ones((s, n), np.float32))
            found = first.sum(1, dtype=np.float64), moves, emits
        for t, more in zip(total, found, strict=True):
            t += more
        start = stop
    return total[0], total[1], total[2]


def baum_welch(numbers: DataFrame, model: Model) -> Model:
    """One round over all training documents."""
    states, classes = len(model.start), len(model.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
        held: list[np.ndarray] = []
        tokens = 0

        def add() -> None:
            for total, more in zip((start, move, emit), expected(model, held), strict=True):
                total += more
            held.clear()

        for batch in batches:
            for blob in batch.column(0):
                held.append(unpack(blob.as_py(), np.uint16))
                tokens += len(held[-1])
                if tokens >= HELD:
                    add()
                    tokens = 0
        if held:
            add()
        i, j = np.indices((states, 1 + states + classes)).reshape(2, -1)
        v = np.hstack([start[:, None], move, emit]).ravel()
        some = v > 0
        yield pa.RecordBatch.from_pydict({"i": pa.array(i[some].astype(np.int32)), "j": pa.array(j[some].astype(np.int32)), "v": v[some]})

    counts = np.zeros((states, 1 + states + classes))
    train = numbers.where("classes IS NOT NULL AND NOT held").select("classes")
    for i, j, v in train.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        counts[i, j] = v
    return Model.of_counts(counts[:, 0], counts[:, 1 : 1 + states], counts[:, 1 + states :].T)


def log10_likelihoods(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of each sequence of classes, by the scaled forward recursion."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    x, at, lane = in_time([seqs[i] for i in order])
    scale = forward(model.move, np.ascontiguousarray(model.emit.T)[:, x], at, np.repeat(model.start[:, None], len(seqs), 1))
    out = np.empty(len(seqs))
    out[order] = np.bincount(lane, np.log10(scale), len(seqs))
    return out


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, rounds: int = ROUNDS, chunk: int = CHUNK) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text) by a model of those that are not held out."""
    numbers = cut(numbered(docs, chunk))
    own = Window.partitionBy("word")
    counted = numbers.where("word IS NOT NULL").select("chunk", "number", "class", F.sum("n").over(own).alias("c"), (F.row_number().over(own.orderBy("chunk")) == 1).alias("once"))
    words = cut(counted)
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, n, v in words.where("once AND c > 0").groupBy("class").agg(F.sum("c"), F.count("*")).collect():
        tokens[k], distinct[k] = n, v
    model = Model.first(tokens)
    for _ in range(rounds if tokens.any() else 0):
        model = baum_welch(numbers, model)
    whole, kinds = int(tokens.sum()), int(distinct.sum())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("number").to_numpy()
        c = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
        c[number] = right.column("c").to_numpy()
        ids = [unpack(b, np.int32) for b in left.column("ids").to_pylist()]
        classes = [unpack(b, np.uint16) for b in left.column("classes").to_pylist()]
        log = np.log10(c + 1.0)
        scores = log10_likelihoods(model, classes) if classes else np.zeros(0)
        room = np.log10(tokens + distinct + 1)
        sums = [float(log[x].sum()) for x in ids]
        n = [len(x) for x in ids]
        return pa.table(
            {
                "doc_id": left.column("doc_id"), "held_out": left.column("held"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array([int((c[x] > 0).sum()) for x in ids], pa.int64()),
                "train_tokens": pa.array([whole] * len(n), pa.int64()), "base_score": pa.array([s - k * float(np.log10(whole + kinds + 1)) for s, k in zip(sums, n, strict=True)], pa.float64()),
                "score": pa.array([float(f) + s - float(room[k].sum()) for f, s, k in zip(scores, sums, classes, strict=True)], pa.float64()),
            }
        )

    texts = numbers.where("ids IS NOT NULL").select(F.col("chunk").alias("of"), "doc_id", "held", "ids", "classes")
    return texts.groupBy("of").cogroup(words.select("chunk", "number", "c").groupBy("chunk")).applyInArrow(run, SCORED)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
