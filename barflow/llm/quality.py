"""Operator 6: quality by Bradley-Terry ranking.

Pairs of a good and a bad document are preferences. Under Bradley-Terry the good one wins with the chance sigmoid(s(good) -
s(bad)); with a linear score that is a logistic regression without intercept on the differences of the features. A quantile
of the training documents' scores, at the rate of bad labels, is the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, text_or_empty, utf8, written
from .words import SPACE, hashes, spans

CUT = 0.3  # the score at the threshold

FEATURES = [
    "log_bytes", "upper", "digit", "punctuation", "symbol", "non_ascii", "space", "line_break", "bar", "exclamation", "word_length",
    "word_length_spread", "distinct_words", "distinct_pairs", "distinct_triples", "repeats_in_a_row", "ends_in_mark", "mark_runs", "one_letter", "long_words",
    "distinct_lines", "longest_word", "commonest_word",
]

_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+<=>@^_`|~{}[]\\/"]] = True


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text. Shares are of the bytes or words of the text; a text without words has zeros."""
    out = np.zeros((len(at) - 1, len(FEATURES)))
    s, e, before = spans(data, at)
    h, size = hashes(data, s, e), e - s
    marked = _MARKS[data]
    runs = marked.copy()
    runs[1:] &= marked[:-1]
    ends = marked[e - 1] if len(e) else np.zeros(0, bool)
    for i in range(len(out)):
        a, b = at[i], at[i + 1]
        w, n = slice(before[i], before[i + 1]), before[i + 1] - before[i]
        if n == 0:
            continue
        text, words, lengths = data[a:b], h[w], size[w]
        count = np.bincount(text, minlength=256)
        total = float(b - a)
        pairs = words[1:] * np.uint64(31) + words[:-1]
        triples = pairs[1:] * np.uint64(31) + words[:-2]
        _, often = np.unique(words, return_counts=True)
        lines = bytes(text).split(b"\n")
        out[i] = [
            math.log1p(total), count[65:91].sum() / total, count[48:58].sum() / total, count[_MARKS].sum() / total, count[_SYMBOLS].sum() / total,
            count[128:].sum() / total, count[SPACE].sum() / total, count[10] / total, count[124] / n, count[33] / n, lengths.mean(), lengths.std(),
            len(often) / n, len(np.unique(pairs)) / n, len(np.unique(triples)) / n, (words[1:] == words[:-1]).sum() / n, ends[w].sum() / n,
            runs[a:b].sum() / n, (lengths == 1).sum() / n, (lengths > 20).sum() / n, len(set(lines)) / len(lines), math.log1p(lengths.max()), often.max() / n,
        ]
    return out


def with_features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and `features` (array of double) of each row; the text is in column _text."""
    kinds = dict(rows.dtypes)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            x = features(*utf8(batch.column("_text")))
            rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), rows], [*keep, "features"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return rows.select(*keep, "_text").mapInArrow(measure, f"{schema}, features array<double>")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of each row of (doc_id, text), written once; learning and scoring from it move no text."""
    return written(with_features(docs.select("doc_id", text_or_empty().alias("_text")), ["doc_id"]), "quality-features")


@dataclass
class QualityModel:
    weights: list[float]
    threshold: float
    scale: float

    def column(self):
        """Score of the array column `features`: CUT at the threshold, rising with the ranking score."""
        s = sum((F.col("features")[i] * F.lit(w) for i, w in enumerate(self.weights)), F.lit(0.0))
        z = (s - F.lit(self.threshold)) * F.lit(self.scale) + F.lit(math.log(CUT / (1 - CUT)))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


BINS = 4096


def quantiles(values: DataFrame, shares: list[float]) -> list[float]:
    """Exact quantiles of the column `s`, interpolated: counts of equal bins first, then the order within the bins asked for."""
    low, high, n = values.agg(F.min("s"), F.max("s"), F.count("s")).first()
    width = (high - low) / BINS
    place = F.least(F.floor((F.col("s") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
    binned = values.where("s is not null").select("s", place.cast("int").alias("bin"))
    counts = sorted((r.bin, r.n) for r in binned.groupBy("bin").agg(F.count("*").alias("n")).collect())  # at most BINS rows

    def at(rank: int) -> float:
        for place, inside in counts:
            if rank < inside:
                break
            rank -= inside
        upto = F.sum("n").over(Window.orderBy("s"))
        same = binned.where(F.col("bin") == place).groupBy("s").agg(F.count("*").alias("n"))
        return same.select("s", upto.alias("upto")).where(F.col("upto") > rank).agg(F.min("s")).first()[0]

    out = []
    for share in shares:
        place = share * (n - 1)
        lower, upper = math.floor(place), math.ceil(place)
        first = at(lower)
        out.append(first if lower == upper else (upper - place) * first + (place - lower) * at(upper))
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, pairs: int = 40_000, label: str = "quality") -> QualityModel | None:
    """Learn from all labelled rows, each in one preference pair at least, with `pairs` pairs at least.

    `docs` are rows of (doc_id, text), or those that `measured` gives. The features are joined with the labels by an exchange
    of both: labels grow with the documents, so neither side is broadcast, and the texts stay where they are read. Pair i joins row i of the good ones with row i of the bad ones, both counted around as often as needed with a shift, so
    no pair comes of a join over all. The threshold is an exact quantile of all labelled rows' scores. Null ids and labels
    are set aside; None where either class is missing.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    rows = docs if "features" in docs.columns else measured(docs)
    known = written(rows.select("doc_id", "features").join(chosen.hint("merge"), "doc_id").select("doc_id", "y", "features"), "quality-known")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    spark = docs.sparkSession
    # rows are numbered by the order of their hashes within each class: ranges of hashes first, then within the range
    hashed = known.select("*", F.xxhash64("doc_id").alias("_hash"))
    ranged = hashed.select("*", F.shiftright("_hash", 52).alias("_range"))
    earlier = Window.partitionBy("y").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("y", "_range").agg(F.count("*").alias("n"))  # at most 4096 a class
    ranges = ranges.select("y", "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("y", "_range").orderBy("_hash", "doc_id", "features")) - 1
    numbered = ranged.select("y", "features", "_range", inside.alias("_inside")).join(F.broadcast(ranges), ["y", "_range"])
    numbered = written(numbered.select("y", "features", (F.col("_before") + F.col("_inside")).alias("k")), "quality-numbered")
    many = max(pairs, sizes[0], sizes[1])
    pick = spark.range(many).select(
        (F.col("id") % sizes[1]).alias("good"), ((F.col("id") + F.floor(F.col("id") / F.lit(math.lcm(sizes[0], sizes[1])))) % sizes[0]).cast("long").alias("bad"), "id"
    )
    good = numbered.where("y = 1").select(F.col("k").alias("good"), F.col("features").alias("x"))
    bad = numbered.where("y = 0").select(F.col("k").alias("bad"), F.col("features").alias("z"))
    both = pick.join(good, "good").join(bad, "bad")
    sign = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)
    train = written(
        both.select(F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0).alias("label"), F.zip_with("x", "z", lambda x, z: (x - z) * sign).alias("d")), "quality-pairs"
    ).select("label", array_to_vector("d").alias("features"))
    fit = LogisticRegression(fitIntercept=False, standardization=True, regParam=1e-3, maxIter=60).fit(train)
    weights = [float(w) for w in fit.coefficients]
    score = sum((F.col("features")[i] * F.lit(w) for i, w in enumerate(weights)), F.lit(0.0))
    share = sizes[0] / (sizes[0] + sizes[1])
    low, cut = quantiles(known.select(score.alias("s")), [share / 2, share])
    return QualityModel(weights, float(cut), 1.0 if cut <= low else 1.0 / max(cut - low, 1e-9))


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """(doc_id, score, predicted) for each row of (doc_id, text), or of those that `measured` gives.

    Null and empty texts are scored by zeros for all features. Without a model every row gets the score CUT. Repeated rows
    give repeated results; an empty table gives none.
    """
    if model is None:
        scored = docs.select("doc_id", F.lit(CUT).alias("score"))
    elif "features" in docs.columns:
        scored = docs.select("doc_id", model.column().alias("score"))
    else:
        rows = with_features(docs.select("doc_id", text_or_empty().alias("_text")), ["doc_id"])
        scored = rows.select("doc_id", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
