"""Operator 8: a hidden Markov language model.

States emit classes of words: each of the commonest tokens is a class of its own, the others share classes by their last two
bytes, within which they are as likely as their counts. Baum-Welch trains the states: every task adds up expected counts
over its training documents, the sums over the tasks give the next model. The scaled forward recursion gives the exact
chance of a document's classes; with the chances of its tokens within the classes that is the chance of the document.

Counts of rare tokens are never gathered: the documents' rare tokens join the counts by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remainder, slices, text_or_empty, utf8, written
from .words import LOWER, hashes, mixed, spans

END = np.uint64(0xE5D0F7E3D0C0FFEE)  # the hash of the token after the last word
BLOCK = 1024
#: Tokens that one pass over a batch holds at once.
BATCH = 500_000


@dataclass
class Hmm:
    start: np.ndarray  # K
    moves: np.ndarray  # K x K
    emits: np.ndarray  # classes x K


@dataclass
class Classes:
    """Frequent tokens by sorted hash with their counts; then `shared` classes with the size of their tokens."""

    tokens: np.ndarray
    counts: np.ndarray
    shared: int
    total: np.ndarray  # log10(N of the class + 0.5 * (V of the class + 1))

    @property
    def many(self) -> int:
        return len(self.tokens) + self.shared


def tokens_of(data: np.ndarray, at: np.ndarray, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, each document's words and then its end; the shared class each could have; tokens before a document."""
    low = LOWER[data]
    s, e, before = spans(low, at)
    docs = len(at) - 1
    whole = before + np.arange(docs + 1)
    h, tail = np.empty(whole[-1], np.uint64), np.zeros(whole[-1], np.int64)
    ends = whole[1:] - 1
    word = np.ones(len(h), bool)
    word[ends] = False
    h[ends] = END
    h[word] = hashes(low, s, e)
    last = low[e - 1].astype(np.uint64) if len(e) else np.zeros(0, np.uint64)
    second = np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0).astype(np.uint64) if len(e) else last
    tail[word] = (mixed(last * np.uint64(256) + second + np.uint64(1)) % np.uint64(shared)).astype(np.int64)
    return h, tail, whole


def token_counts(docs: DataFrame, shared: int) -> DataFrame:
    """(h, tail, c): count of every distinct token of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        held, size = [], 0

        def added():
            h, t, c = (np.concatenate(x) for x in zip(known, *held))
            order = np.argsort(h, kind="stable")
            h, t, c = h[order], t[order], c[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            return h[first], t[first], np.add.reduceat(c, first) if len(first) else c[:0]

        for batch in slices(batches):
            h, tail, _ = tokens_of(*utf8(batch.column("text")), shared)
            h, at, c = np.unique(h, return_index=True, return_counts=True)
            held.append((h, tail[at], c))
            size += len(h)
            if size > 1_000_000:
                known, held, size = added(), [], 0
        h, t, c = added()
        for i in range(0, len(h), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[j].view(np.int64)), pa.array(t[j]), pa.array(c[j])], ["h", "tail", "c"])

    return docs.select("text").mapInArrow(count, "h long, tail long, c long").groupBy("h").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def fit_classes(counts: DataFrame, frequent: int, shared: int) -> Classes:
    """The commonest tokens, at most `frequent`: all above a count, on a logarithmic scale of at most some thousand steps."""
    step = F.floor(F.log2("c") * 32).cast("int")
    least, many = 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        many += r.n
        if many > frequent:
            break
        least = r.step
    top = counts.where(step >= least).select("h", "c", "tail").toPandas()
    h = top.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    n, v = np.zeros(shared), np.zeros(shared)
    for r in counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # at most `shared` rows
        n[r["tail"]], v[r["tail"]] = r.n, r.v
    np.subtract.at(n, top["tail"].to_numpy(np.int64), top.c.to_numpy())
    np.subtract.at(v, top["tail"].to_numpy(np.int64), 1)
    return Classes(h[order], top.c.to_numpy(np.int64)[order], shared, np.log10(n + 0.5 * (v + 1)))


ENCODED = "row long, doc_id {}, held_out boolean, n_tokens long, n_common long, base double, share double, classes binary, rare array<long>"


def encode(docs: DataFrame, classes, kind: str) -> DataFrame:
    """For each text its classes in order, the rare tokens' hashes, and the sums over tokens that need no join."""
    names = ["row", "doc_id", "held_out", "n_tokens", "n_common", "base", "share", "classes", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = classes.value
        row = TaskContext.get().partitionId() << 36
        logs = np.log10(m.counts + 0.5)
        for batch in slices(batches):
            h, tail, at = tokens_of(*utf8(batch.column("text")), m.shared)
            k = np.minimum(np.searchsorted(m.tokens, h), max(len(m.tokens) - 1, 0))
            common = m.tokens[k] == h if len(m.tokens) else np.zeros(len(h), bool)
            ids = np.where(common, k, len(m.tokens) + tail).astype(np.uint16)
            base = np.add.reduceat(np.where(common, logs[k] if len(logs) else 0.0, 0.0), at[:-1])
            share = np.add.reduceat(np.where(common, 0.0, -m.total[tail]), at[:-1])
            number = np.add.reduceat(common.astype(np.int64), at[:-1])
            rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.diff(at) - number)).astype(np.int32)), pa.array(h[~common].view(np.int64)))
            texts = pa.array([ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            rows = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            columns = [pa.array(rows), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(at)), pa.array(number), pa.array(base), pa.array(share), texts, rare]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, ENCODED.format(kind))


def batches_of(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents by falling length: their order, starts in the flat classes, lengths; cut where a batch holds enough."""
    sizes = np.array([len(x) for x in column], np.int64)
    order = np.argsort(-sizes, kind="stable")
    total, start = np.cumsum(sizes[order]), 0
    while start < len(order):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + BATCH, side="right")))
        part = order[start:end]
        flat = np.concatenate([column[i] for i in part])
        yield part, flat, sizes[part]
        start = end


def forward(m: Hmm, flat: np.ndarray, sizes: np.ndarray, keep: bool = False):
    """log10 chance of each sequence; with `keep` also the scaled forward values, emissions and scales of every step."""
    begin = np.cumsum(sizes) - sizes
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    total, steps, a = np.zeros(len(sizes)), [], None
    for t, n in enumerate(active):
        emitted = m.emits[flat[begin[:n] + t]]
        a = (m.start if t == 0 else a[:n] @ m.moves) * emitted
        scale = a.sum(axis=1)
        a = a / scale[:, None]
        total[:n] += np.log10(scale)
        if keep:
            steps.append((a, emitted, scale))
    return (total, steps, begin, active) if keep else total


def expected(m: Hmm, flat: np.ndarray, sizes: np.ndarray, sums: Hmm) -> None:
    """Add the expected counts of the sequences under the model to the sums."""
    _, steps, begin, active = forward(m, flat, sizes, keep=True)
    k = len(m.start)
    gamma, order, filled = np.empty((len(flat), k)), np.empty(len(flat), np.int64), len(flat)
    after = np.zeros((0, k))
    for t in range(len(steps) - 1, -1, -1):
        a, n = steps[t][0], active[t]
        beta = np.ones((n, k))
        if len(after):
            sums.moves += (a[: len(after)].T @ after) * m.moves
            beta[: len(after)] = after @ m.moves.T
        g = a * beta
        gamma[filled - n : filled], order[filled - n : filled] = g, begin[:n] + t
        filled -= n
        after = steps[t][1] * beta / steps[t][2][:, None]
    sums.start += gamma[: active[0]].sum(axis=0)
    seen = flat[order]
    for s in range(k):
        sums.emits[:, s] += np.bincount(seen, gamma[:, s], minlength=len(sums.emits))


def held_classes(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Columns and class arrays of some millions of tokens together, so that sequences of like length share a pass."""
    rows, texts, size = [[] for _ in columns], [], 0
    for batch in batches:
        for i, c in enumerate(columns):
            rows[i] += batch.column(c).to_pylist()
        new = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("classes")]
        texts += new
        size += sum(map(len, new))
        if size > 8 * BATCH:
            yield rows, texts
            rows, texts, size = [[] for _ in columns], [], 0
    if texts:
        yield rows, texts


def baum_welch(encoded: DataFrame, m: Hmm, smoothing: float) -> Hmm:
    """One round: expected counts of all sequences, added up across the tasks."""
    shared = encoded.sparkSession.sparkContext.broadcast(m)
    k = len(m.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sums = Hmm(np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emits))
        some = False
        for _, texts in held_classes(batches, []):
            for _, flat, sizes in batches_of(texts):
                expected(model, flat, sizes, sums)
                some = True
        if some:
            flat = np.concatenate([sums.start, sums.moves.ravel(), sums.emits.ravel()])
            flat = np.append(flat, np.zeros(-len(flat) % BLOCK)).reshape(-1, BLOCK)
            for i, block in enumerate(flat):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block], pa.list_(pa.float64()))], ["block", "x"])

    parts = encoded.select("classes").mapInArrow(run, "block int, x array<double>")
    added = parts.groupBy("block").agg(Summarizer.sum(array_to_vector("x")).alias("x")).select("block", vector_to_array("x").alias("x"))
    rows = sorted(added.collect())  # as many as the model has blocks
    if not rows:
        return m
    flat = np.concatenate([r.x for r in rows])
    start, moves, emits = flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :][: m.emits.size].reshape(m.emits.shape)
    return normal(start + 1, moves + 1, emits + smoothing)


def normal(start: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Hmm:
    return Hmm(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0))


def first_model(classes: Classes, states: int, seed: int) -> Hmm:
    """Sticky states whose emissions are the class rates times random factors."""
    random = np.random.default_rng(seed)
    rate = np.append(classes.counts, 10**classes.total).astype(float)
    emits = rate[:, None] * np.exp(random.normal(size=(classes.many, states)))
    moves = np.full((states, states), 0.02 / max(1, states - 1)) + np.eye(states) * 0.98
    return normal(np.ones(states), moves, emits)


def language_scores(
    docs: DataFrame, states: int = 8, rounds: int = 3, frequent: int = 40_000, shared: int = 512, smoothing: float = 0.01, seed: int = 5, fold: int = 1
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of (doc_id, text).

    Rows whose crc32 of the id, modulo 5, is `fold` are held out; all others train. A null or empty text has one token, its
    end. Without training rows every token is unknown. Repeated rows are rows of their own. An empty table gives no rows.
    At most `frequent` + `shared` classes (under 65536) are broadcast.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", (remainder() == fold).alias("held_out"), text_or_empty().alias("text"))
    counts = written(token_counts(rows.where("not held_out"), shared), "counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    classes = fit_classes(counts, frequent, shared)
    encoded = written(encode(rows, spark.sparkContext.broadcast(classes), dict(docs.dtypes)["doc_id"]), "encoded")

    model = first_model(classes, states, seed)
    for _ in range(rounds):
        model = baum_welch(encoded.where("not held_out"), model, smoothing)

    shared_model = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (rows,), texts in held_classes(batches, ["row"]):
            chance = np.zeros(len(texts))
            for part, flat, sizes in batches_of(texts):
                chance[part] = forward(shared_model.value, flat, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(chance)], ["row", "chance"])

    chances = encoded.select("row", "classes").mapInArrow(run, "row long, chance double")
    rare = encoded.select("row", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h", "left")
    rare = rare.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"))
    whole = encoded.drop("classes", "rare").join(chances, "row").join(rare, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    base = F.col("base") + logs - F.col("n_tokens") * F.lit(float(np.log10(size.n + 0.5 * (size.v + 1))))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(size.n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("chance") + logs + F.col("share")).alias("score"),
    )
