"""Operator 12: periodic runs of words by block convolution at dyadic scales.

A run is a maximal stretch of words with smallest period q that has at least `least` words and `times` periods. It holds equal
words at distance q throughout. Cut at multiples of B, a power of two, its first words contain a whole block of B if
2 * B - 1 <= length - q; with B the largest power of two up to (3 * q + 1) / 2 this holds for every run of four periods. Hence
scale B answers for the periods (2 * B - 1) / 3 <= q < (4 * B - 1) / 3 and needs, for each block, the places in the window of
2 * B words after it where the block occurs again at such a distance.

These are the zeros of the sum of squared differences of block and window. It is computed exactly modulo a prime for all
shifts at once by number-theoretic transforms of length 2 * B, many blocks at a time; a zero that the modulus could have made
is told apart by comparing the words. Each zero seeds an extension to both sides that ends at the first mismatch.

Two exact rules keep the transforms few: a block with a word that does not occur again within the largest distance of its scale
has no zero, and of a block in a run already known only distances beyond the run's end can be new (Fine and Wilf).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import slices, text_or_empty, utf8
from .words import hashes, spans

#: Prime of the transforms, 119 * 2**23 + 1, and a generator of its multiplicative group.
PRIME = np.uint64(998244353)
ROOT = 3
#: Elements of one batch of transforms.
BATCH = 1 << 19


def _powers(size: int, inverse: bool) -> np.ndarray:
    """The first size / 2 powers of a root of unity of order `size`."""
    w = pow(ROOT, (int(PRIME) - 1) // size, int(PRIME))
    if inverse:
        w = pow(w, int(PRIME) - 2, int(PRIME))
    out = np.ones(max(1, size // 2), np.uint64)
    filled = 1
    while filled < len(out):
        step = np.uint64(pow(w, filled, int(PRIME)))
        more = min(filled, len(out) - filled)
        out[filled : filled + more] = out[:more] * step % PRIME
        filled += more
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row (length a power of two), in bit-reversed order."""
    a, size = rows % PRIME, rows.shape[1]
    width = size
    while width > 1:
        half = width // 2
        a = a.reshape(len(rows), size // width, width)
        left, right = a[:, :, :half], a[:, :, half:]
        a = np.concatenate([(left + right) % PRIME, (left + PRIME - right) % PRIME * _powers(width, False) % PRIME], axis=2)
        width = half
    return a.reshape(len(rows), size)


def inverse(rows: np.ndarray) -> np.ndarray:
    """Rows whose `transform` this is."""
    a, size = rows, rows.shape[1]
    width = 2
    while width <= size:
        half = width // 2
        a = a.reshape(len(rows), size // width, width)
        left, right = a[:, :, :half], a[:, :, half:] * _powers(width, True) % PRIME
        a = np.concatenate([(left + right) % PRIME, (left + PRIME - right) % PRIME], axis=2)
        width *= 2
    return a.reshape(len(rows), size) * np.uint64(pow(size, int(PRIME) - 2, int(PRIME))) % PRIME


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of each block of B numbers and its window of 2 * B, the sum of squared differences modulo the prime at shifts 0 to B."""
    size = blocks.shape[1]
    squares = np.zeros((len(windows), 2 * size + 1), np.uint64)
    np.cumsum(windows * windows % PRIME, axis=1, out=squares[:, 1:])
    fixed = (blocks * blocks % PRIME).sum(axis=1, dtype=np.uint64)[:, None]
    turned = np.zeros_like(windows)
    turned[:, 0] = blocks[:, 0]
    turned[:, size + 1 :] = blocks[:, :0:-1]  # index -i holds word i
    products = inverse(transform(turned) * transform(windows) % PRIME)[:, : size + 1]
    return (fixed + squares[:, size:] - squares[:, : size + 1] + np.uint64(2) * (PRIME - products)) % PRIME


def next_gap(words: np.ndarray) -> np.ndarray:
    """Distance of each word to its next occurrence; a large number at the last one."""
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    gap = np.full(len(words), np.iinfo(np.int64).max, np.int64)
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gap


def _agreeing(words: np.ndarray, a: int, b: int, way: int) -> int:
    """How far words[a + way * i] and words[b + way * i] agree from i = 0 on, by doubling steps."""
    done, step = 0, 64
    most = min(len(words) - b, len(words) - a) if way > 0 else min(a, b) + 1
    while done < most:
        size = min(step, most - done)
        if way > 0:
            x, y = words[a + done : a + done + size], words[b + done : b + done + size]
        else:
            x, y = words[a - done - size + 1 : a - done + 1][::-1], words[b - done - size + 1 : b - done + 1][::-1]
        differ = x != y
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + size, min(2 * step, 1 << 16)
    return most


def find_runs(words: np.ndarray, longest: int | None = None, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a row of 32-bit numbers, by start and period.

    `longest` bounds the length of a run (of the texts that are strung together); `times` must be 4 at least.
    """
    if times < 4:
        raise ValueError("the scales are cut for runs of four periods at least")
    n = len(words)
    longest = n if longest is None else longest
    gap = next_gap(words)
    covered = np.zeros(n, np.int64)  # the furthest end of a known run that holds the word
    found: set[tuple[int, int, int]] = set()
    size = 2
    while True:
        low, high = -(-(2 * size - 1) // 3), -(-(4 * size - 1) // 3) - 1
        if low * times > longest or size > n:
            break
        starts = np.arange(0, n - size + 1, size)
        blocks = gap[: len(starts) * size].reshape(len(starts), size)
        starts = starts[blocks.max(axis=1) <= high]
        starts = starts[covered[starts] < starts + size + high]
        step = max(1, BATCH // (2 * size))
        for k in range(0, len(starts), step):
            _scale(words, starts[k : k + step], size, low, high, covered, found, max(least, 1), times)
        size *= 2
    return sorted((s, length, q) for q, s, length in found)


def _scale(words, starts, size, low, high, covered, found, least, times) -> None:
    """Add the runs that the blocks of one scale at `starts` seed."""
    n = len(words)
    at = starts[:, None]
    blocks = words[at + np.arange(size)].astype(np.uint64)
    inside = at + low + np.arange(2 * size)
    windows = np.where(inside < n, words[np.minimum(inside, n - 1)], np.uint32(0)).astype(np.uint64)
    zero = squared_differences(blocks, windows)[:, : high - low + 1] == 0
    row, shift = np.nonzero(zero)
    distance, place = shift + low, starts[row]
    fits = place + distance + size <= n
    distance, place = distance[fits], place[fits]
    ended: dict[int, int] = {}
    for k in np.lexsort((place, distance)):
        p, q = int(place[k]), int(distance[k])
        if p + q + size <= covered[p] or p < ended.get(q, 0):
            continue
        if not np.array_equal(words[p : p + size], words[p + q : p + q + size]):
            continue
        end = p + size + _agreeing(words, p + size, p + size + q, 1) if p + size + q < n else p + size
        start = p - (_agreeing(words, p - 1, p - 1 + q, -1) if p else 0)
        ended[q] = end
        length = end + q - start
        if length >= max(least, times * q):
            found.add((q, start, length))
            part = covered[start : start + length]
            np.maximum(part, start + length, out=part)


def in_texts(words: np.ndarray, before: np.ndarray, least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts, whose words are `words[before[i]:before[i + 1]]`, given as 64-bit hashes."""
    sizes = np.diff(before)
    _, ids = np.unique(words, return_inverse=True)
    # after each text a number of its own, so that nothing matches across texts
    strung = np.empty(len(words) + len(sizes), np.uint32)
    first = before[:-1] + np.arange(len(sizes))
    strung[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    strung[first + sizes] = np.arange(len(sizes), dtype=np.uint32) + np.uint32(len(words))
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for start, length, period in find_runs(strung, int(sizes.max(initial=0)), least, times):
        text = int(np.searchsorted(first, start, side="right")) - 1
        out[text].append((start - int(first[text]), length, period))
    return out


def left_over(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if every run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = (), least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, *keep, n_words, runs, collapsed) for each row of (doc_id, text); runs: array of (start, length, period) in words.

    `collapsed` is the text without the words that repeat a run's first period, joined by single blanks; a text without runs
    has only its white space changed. Words are 64-bit hashes within a text. A null text is an empty one; empty and blank texts
    have no words and runs; repeated rows and null ids come out as they come in. An empty table gives no rows. A task holds
    some 2 MB of text at once, or one longer document.
    """

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", most=1_000_000):
            data, at = utf8(batch.column("_text"))
            start, end, before = spans(data, at)
            found = in_texts(hashes(data, start, end), before, least, times)
            raw = data.tobytes()
            texts = []
            for i, runs in enumerate(found):
                a, b = before[i], before[i + 1]
                if runs:
                    stays = left_over(b - a, runs)
                    words = (raw[s:e] for s, e in zip(start[a:b][stays].tolist(), end[a:b][stays].tolist()))
                    texts.append(b" ".join(words))
                else:
                    texts.append(b" ".join(raw[at[i] : at[i + 1]].split()))
            flat = [r for runs in found for r in runs]
            fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            offsets = pa.array(np.cumsum([0] + [len(r) for r in found]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            columns = [*(batch.column(c) for c in ("doc_id", *keep)), pa.array(np.diff(before)), lists, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "n_words", "runs", "collapsed"])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in ("doc_id", *keep)), "n_words long", "runs array<struct<start: long, length: long, period: long>>", "collapsed string"])
    return docs.select("doc_id", *keep, text_or_empty().alias("_text")).mapInArrow(runs_of, schema)
