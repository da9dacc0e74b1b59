"""Operator 2: toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence with the words S has the chance sigmoid(bias + sum of the weights in S); the
document's is the leaky noisy-or of its sentences, 1 - (1 - leak) * product(1 - p). The weights are learned from document
labels alone, then point out the offending sentences. The leak is the rate of label 1 that no sentence explains; without it
long clean documents would gather chance from their many sentences.

Training: iterative parameter mixing. Each round is a Spark job in which every task starts from the broadcast weights, makes
some passes of AdaGrad over its share, and returns its weights; their mean, by the documents of a share that hold the word,
starts the next round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, text_or_empty, written

SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Longer sentences (tables, word lists) are cut into runs of so many words.
RUN = 60


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of every sentence that has words; all words of the text are covered."""
    start = 0
    for m in SENTENCE_END.finditer(text):
        yield from _runs(text, start, m.start())
        start = m.end()
    yield from _runs(text, start, len(text))


def _runs(text: str, start: int, end: int) -> Iterator[tuple[int, int, list[str]]]:
    words = WORD.findall(text[start:end].lower())
    if len(words) <= RUN:
        if words:
            yield start, end, words
        return
    found = [(m.start() + start, m.end() + start) for m in WORD.finditer(text[start:end])]
    for i in range(0, len(found), RUN):
        part = found[i : i + RUN]
        yield part[0][0], part[-1][1], [text[a:b].lower() for a, b in part]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class ToxicModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    leak: float = -3.0  # on the log-odds scale

    def bag(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, chance) of each sentence in which a word has a weight, and one entry for all others together."""
        get, rest, out = self.weights.get, 0, []
        for start, end, words in sentences(text):
            known = [w for w in set(words) if w in self.weights]
            if known:
                out.append((start, end, float(sigmoid(np.float64(self.bias + sum(map(get, known)))))))
            else:
                rest += 1
        base = float(sigmoid(np.float64(self.bias)))
        return [*out, (-1, -1, 1 - (1 - base) ** rest)]

    def score(self, bag: list[tuple[int, int, float]]) -> float:
        clean = 1 - float(sigmoid(np.float64(self.leak)))
        for _, _, p in bag:
            clean *= 1 - p
        return 1 - clean


def _encode(texts: list[str], index: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each text: word numbers, the sentence each is in, number of sentences."""
    out = []
    for text in texts:
        words, at, n = [], [], 0
        for _, _, found in sentences(text):
            ids = {index[w] for w in found if w in index}
            words += ids
            at += [n] * len(ids)
            n += 1
        out.append((np.array(words, np.int64), np.array(at, np.int64), n))
    return out


def _passes(bags, labels, w: np.ndarray, passes: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """AdaGrad over the bags; w holds the word weights, then bias, then leak."""
    w, grown, order = w.copy(), np.full(len(w), 1e-2), np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(bags)):
            words, at, n = bags[i]
            z = np.bincount(at, w[words], minlength=n) + w[-2] if len(words) else np.full(n, w[-2])
            p, leak = sigmoid(z), sigmoid(w[-1])
            clean = np.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()) * (1 - leak)
            scale = 1.0 if not labels[i] else -clean / max(1 - clean, 1e-6)
            g = scale * p
            if len(words):
                gw = g[at]
                np.add.at(grown, words, gw * gw)
                np.add.at(w, words, -rate * gw / np.sqrt(grown[words]))
            for k, gk in ((-2, float(g.sum())), (-1, scale * leak)):
                gk = max(-1.0, min(1.0, gk))
                grown[k] += gk * gk
                w[k] -= 0.3 * rate * gk / np.sqrt(grown[k])
        w[:-2] = np.sign(w[:-2]) * np.maximum(np.abs(w[:-2]) - decay, 0)
    return w


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    max_docs: int = 10_000,
    min_docs: int = 5,
    min_share: float = 0.01,
    max_words: int = 20_000,
    chance: float = 0.01,
    rounds: int = 4,
    passes: int = 3,
    rate: float = 0.5,
    decay: float = 0.01,
    margin: float = 2.0,
    shares: int = 6,
    label: str = "toxic",
) -> ToxicModel:
    """Learn from at most `max_docs` labelled rows of (doc_id, text) and (doc_id, label), chosen by a hash of the id.

    A weight goes to words of the share `min_share` of the sample, and to rarer ones of at least `min_docs` toxic documents that
    are toxic beyond label noise: by Chernoff's bound, with a chance of at most `chance` for any of the words tested. Support is
    counted in different texts, so that no copied document is learned by heart. If there are more than `max_words`, the clearest
    of the rare words come first, then the commonest. Rows with a null id, label or unlabelled rows teach nothing; without any
    labelled row the model has no weights.
    """
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.select("y", "text", F.xxhash64("text").alias("h")).repartition(shares, F.xxhash64("doc_id"))
    sample = written(sample.withColumn("k", F.monotonically_increasing_id()), "toxic-sample")
    firsts = sample.groupBy("h", "y").agg(F.min("k").alias("k"))
    different = sample.join(F.broadcast(firsts.select("k")), "k", "left_semi").select("y", "text")

    sizes = {r.y: r.n for r in firsts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    least = max(min_docs, min_share * sum(sizes.values()))

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                for w in {w for _, _, s in sentences(text) for w in s}:
                    seen.setdefault(w, [0, 0])[y] += 1
            columns = [pa.array(list(seen), pa.string()), *(pa.array([n[k] for n in seen.values()], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "clean", "toxic"])

    words = written(
        different.mapInArrow(vocabulary, "word string, clean long, toxic long")
        .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .withColumn("n", F.col("clean") + F.col("toxic")).where((F.col("n") >= least) | (F.col("toxic") >= min_docs)),
        "toxic-words",
    )
    tested = words.where(F.col("toxic") >= min_docs).count()
    share = F.col("toxic") / F.col("n")
    # n times the divergence of the word's toxic share from that of all texts
    against = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    words = words.withColumn("rare", F.when(F.col("n") < least, F.when(share > base, against).otherwise(0.0)))
    words = words.where(F.col("rare").isNull() | (F.col("rare") >= float(np.log(max(tested, 1) / chance))))
    found = words.orderBy(F.desc_nulls_last("rare"), F.desc("n"), "word").limit(max_words).collect()
    names = [r.word for r in found]
    index = {w: i for i, w in enumerate(names)}
    shared_index = spark.sparkContext.broadcast(index)
    weights = np.zeros(len(names) + 2)
    # start at the log-odds of a word between documents of either label, less `margin` where no test has ruled noise out
    odds = np.array([np.log((r.toxic + 0.5) / (sizes.get(1, 0) + 1)) - np.log((r.clean + 0.5) / (sizes.get(0, 0) + 1)) for r in found])
    weights[: len(names)] = np.sign(odds) * np.maximum(np.abs(odds) - np.array([margin if r.rare is None else 0.0 for r in found]), 0)
    weights[-2:] = ToxicModel.bias, ToxicModel.leak
    for k in range(rounds):
        start = spark.sparkContext.broadcast(weights)

        def improve(batches: Iterator[pa.RecordBatch], start=start, k=k) -> Iterator[pa.RecordBatch]:
            bags, y = [], []
            for batch in batches:
                bags += _encode(batch.column("text").to_pylist(), shared_index.value)
                y += batch.column("y").to_pylist()
            if bags:
                got = _passes(bags, y, start.value, passes, rate / (1 + k), decay, seed=k)
                seen = np.full(len(got), len(bags), np.int64)
                seen[:-2] = np.bincount(np.concatenate([np.unique(words) for words, _, _ in bags]), minlength=len(got) - 2)
                yield pa.RecordBatch.from_arrays([pa.array([seen.tolist()], pa.list_(pa.int64())), pa.array([got.tolist()], pa.list_(pa.float64()))], ["n", "w"])

        parts = sample.select("y", "text").mapInArrow(improve, "n array<long>, w array<double>").collect()
        if not parts:
            break
        # a share without a word says nothing of its weight: else those of rare words would stay near their start
        seen = np.array([r.n for r in parts], float)
        weights = np.where(seen.sum(0) > 0, (seen * [r.w for r in parts]).sum(0) / np.maximum(seen.sum(0), 1), weights)
    return ToxicModel({w: float(x) for w, x in zip(names, weights) if abs(x) > 0.02}, float(weights[-2]), float(weights[-1]))


def score_toxicity(docs: DataFrame, model: ToxicModel, sentence_threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted, offending) and the columns in `keep` for each row of (doc_id, text).

    `offending` lists start, end (code points) and chance of the sentences of at least `sentence_threshold`. A null or empty
    text has only the leak as its score. Repeated rows give repeated results; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", *keep, text_or_empty().alias("_text"))
    kinds = dict(rows.dtypes)
    kept = ["doc_id", *keep]
    spot = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "_text"):
            bags = [m.bag(t) for t in batch.column("_text").to_pylist()]
            scores = [m.score(b) for b in bags]
            bad = [[{"start": a, "end": e, "chance": p} for a, e, p in b if p >= sentence_threshold and a >= 0] for b in bags]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(bad, spot)],
                [*kept, "score", "predicted", "offending"],
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return rows.mapInArrow(score, f"{schema}, score double, predicted int, offending array<struct<start:long,end:long,chance:double>>")
