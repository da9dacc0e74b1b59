"""Operator 10: repeated passages by prefix-free parsing.

Every window of `width` bytes contains a trigger: the `gram`-byte string with the smallest rolling hash in the window
(leftmost of equals), which depends on the window's bytes alone. The triggers parse a document into phrases: a phrase is a
trigger with all the windows that it is the trigger of. The distinct phrases are the dictionary, the phrases of the
documents in order are the parse.

Where a phrase of the parse is not the first of its kind in the corpus, all its windows start earlier too. Windows of
different phrases can be equal only if the phrases share the trigger. Only for such dictionary entries the windows are
compared one by one, as the suffixes of the dictionary cut at `width` bytes: of equal neighbours in their order all but the
first in the corpus start earlier. Full suffixes are never ordered, since nothing beyond `width` bytes decides a removal.

Each task reduces the phrases it sees often to their first occurrence before any shuffle, and spreads the phrases of a
trigger that it sees with several contexts, so text repeated in many documents makes no hot partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, release, slices, text_or_empty, utf8, written
from .words import BYTES, mixed

POWER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes parsed at once (few enough for the processor's cache); a longer text is parsed in parts that overlap by a window less one byte.
PART = 150_000
#: A place is (number among the rows of one repeated id) << SHIFT | byte offset.
SHIFT = 40


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` bytes, put together from runs of 1, 2, 4, ... bytes."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, h, have, out, done = POWER, BYTES[data], 1, None, 0
        while True:
            if size & have:
                if out is None:
                    out = h
                else:
                    m = len(h) - done
                    out = out[:m] * power + h[done : done + m]
                done += have
            if have * 2 > size:
                return mixed(out)
            h = h[:-have] * power + h[have:]
            power, have = power * power, have * 2


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every `size` neighbours."""
    step = 1
    while step * 2 <= size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (size - step)], x[size - step :]) if size > step else x


def phrases(data: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each phrase: document number, first window start, number of windows, trigger hash, content hash, trigger's offset."""
    n = len(data) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    g, whole = rolling(data, gram), rolling(data, width)
    packed = (g & ~np.uint64(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
    trigger = (sliding_least(packed, width - gram + 1)[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    inside = np.arange(n) + width <= at[owner + 1]
    new = np.ones(n, bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])
    stop = np.ones(n, bool)
    stop[:-1] = new[1:] | ~inside[1:]
    first, last = np.flatnonzero(new & inside), np.flatnonzero(stop & inside)
    count = last - first + 1
    # the first and the last window of a phrase overlap, so together they are its bytes
    with np.errstate(over="ignore"):
        u = mixed(whole[first] * POWER + whole[last] + (count * 256 + trigger[first] - first).astype(np.uint64))
    return owner[first], first, count, g[trigger[first]], u, trigger[first] - first


def parts(data: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, document numbers and places of what is parsed at once."""
    if len(data) <= PART:
        yield data, at, np.arange(len(at) - 1), np.zeros(len(at) - 1, np.int64)
        return
    for i in range(len(at) - 1):
        for start in range(at[i], max(at[i] + 1, at[i + 1] - width + 1), PART - width + 1):
            piece = data[start : min(start + PART, at[i + 1])]
            yield piece, np.array([0, len(piece)]), np.array([i]), np.array([start - at[i]])


FIELDS = ["kind", "home", "u", "n", "doc_id", "pos"]
SCHEMA = "kind int, home long, u long, n long, doc_id long, pos long"
REPEAT, ENTRY, AMBIGUOUS = 0, 1, 2


def ids_and_places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "sub"))


def parse(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Phrases of (doc_id, sub, text).

    REPEAT: a run of windows that the task has seen earlier in the corpus. ENTRY: the first of its kind in the task, at home
    with its trigger. AMBIGUOUS: likewise, but the task knows that its trigger has several contexts; all of these but one are
    at home by themselves. `kind` is one of these plus four times the trigger's offset in the phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in slices(batches, most=PART):
            data, at = utf8(batch.column("text"))
            ids, subs = ids_and_places(batch)
            for piece, offsets, numbers, places in parts(data, at, width):
                owner, first, n, g, u, off = phrases(piece, offsets, width, gram)
                if len(first):
                    row = numbers[owner]
                    held.append((g, u, n, off.astype(np.int32), ids[row], (subs[row] << SHIFT) + first - offsets[owner] + places[owner]))
        if not held:
            return
        g, u, n, off, doc, pos = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((pos, doc, u, g))
        g, u, n, off, doc, pos = (x[order] for x in (g, u, n, off, doc, pos))
        again, other = np.zeros(len(g), bool), np.zeros(len(g), bool)
        same = g[1:] == g[:-1]
        again[1:] = same & (u[1:] == u[:-1])
        other[1:] = same & (u[1:] != u[:-1])  # a further context of the trigger before it
        start = np.flatnonzero(np.append(True, ~same))
        several = np.repeat(np.logical_or.reduceat(other, start), np.diff(np.append(start, len(g))))
        lead = np.zeros(len(g), bool)
        lead[start] = True
        entry = np.flatnonzero(~again)
        kind = np.where(several[entry], AMBIGUOUS, ENTRY).astype(np.int32) + off[entry] * 4
        home = np.where(several[entry] & ~lead[entry], mixed(g[entry] ^ u[entry]), g[entry])
        yield from _cut(kind, home, u[entry], n[entry], doc[entry], pos[entry])
        del kind, home, entry, start, several, lead, other, g, u
        n, doc, pos = n[again], doc[again], pos[again]
        order = np.lexsort((pos, doc))
        n, doc, pos = n[order], doc[order], pos[order]
        if len(n):  # neighbours form one run
            new = np.ones(len(n), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + n[:-1])
            first = np.flatnonzero(new)
            n, doc, pos = np.add.reduceat(n, first), doc[first], pos[first]
            random = mixed(doc.view(np.uint64) ^ mixed(pos.view(np.uint64)))
            yield from _cut(np.zeros(len(n), np.int32), random, random, n, doc, pos)

    return docs.mapInArrow(run, SCHEMA)


def _cut(kind, home, u, *rest) -> Iterator[pa.RecordBatch]:
    columns = [kind, home.view(np.int64), u.view(np.int64), *rest]
    for i in range(0, len(kind), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in columns], FIELDS)


def repeated_runs(docs: DataFrame, width: int, gram: int, paths: list[str]) -> DataFrame:
    """(doc_id, pos, n): runs of n window starts, from place pos on, whose windows also start earlier in the corpus.

    `docs` has doc_id and sub (distinct together, not null) and text (not null); earlier is by doc_id, sub, offset.
    The paths of its intermediate tables are added to `paths`.
    """
    order = Window.partitionBy("home").orderBy("u", "doc_id", "pos")
    group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    again = (F.col("kind") % 4 == REPEAT) | F.coalesce(F.lag("u").over(order) == F.col("u"), F.lit(False))
    unclear = (F.first("u").over(group) != F.last("u").over(group)) | (F.max(F.col("kind") % 4).over(group) == AMBIGUOUS)
    found = parse(docs, width, gram).withColumn("again", again).withColumn("unclear", unclear)
    off = F.floor(F.col("kind") / 4).cast("long").alias("off")
    found = written(found.where("again or unclear").select("again", "n", off, "doc_id", "pos"), "phrases", paths)

    # dictionary entries that share a trigger, in two sides: windows with at least `half` bytes before the trigger, and others
    entries = found.where("not again").withColumn("sub", F.shiftright("pos", SHIFT).cast("int"))
    entries = entries.groupBy("doc_id", "sub").agg(*(F.collect_list(c).alias(c) for c in ("pos", "n", "off")))
    sides = docs.join(entries, ["doc_id", "sub"]).select("doc_id", "sub", "text", "pos", "n", "off")
    sides = written(sides.mapInArrow(entry_sides(width, gram), "key long, doc_id long, pos long, bytes binary"), "sides", paths)
    release(docs.sparkSession)
    shared = sides.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    each = written(sides.join(shared, "key").select("doc_id", "pos", "bytes").mapInArrow(windows_of(width), "h long, doc_id long, pos long"), "windows", paths)
    first = each.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("c")).where("c > 1").select("h", "first")
    later = each.join(first, "h").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos")))
    return found.where("again").select("doc_id", "pos", "n").union(later.select("doc_id", "pos", F.lit(1).cast("long").alias("n")))


def entry_sides(width: int, gram: int):
    """(key, doc_id, pos, bytes) for both sides of the entries of a text: only sides of equal keys can share windows.

    A window has width - gram bytes besides its trigger, so at least half of them before it or at least half after it. The
    key is the trigger with that half; the bytes are those of the side's windows, of which the first starts at pos.
    """
    half = (width - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=PART):
            data, at = utf8(batch.column("text"))
            ids, subs = ids_and_places(batch)
            keys = rolling(data, gram + half)
            owner = np.repeat(np.arange(batch.num_rows), [len(x) for x in batch.column("pos")])
            pos, n, off = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pos", "n", "off"))
            first = at[owner] + pos - (subs[owner] << SHIFT)
            trigger, stop = first + off, first + n
            for k, (a, b) in enumerate(((first, np.minimum(trigger - half + 1, stop)), (np.maximum(trigger - half + 1, first), stop))):
                some = np.flatnonzero(b > a)
                a, b, t = a[some], b[some], trigger[some]
                key = mixed(keys[t - half] if k == 0 else keys[t] + np.uint64(1)).view(np.int64)
                view = memoryview(data.tobytes())
                texts = pa.array([view[x : y + width - 1].tobytes() for x, y in zip(a.tolist(), b.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[owner[some]]), pa.array(pos[some] + a - first[some]), texts], ["key", "doc_id", "pos", "bytes"])

    return run


def windows_of(width: int):
    """(h, doc_id, pos) for every window in the bytes of (doc_id, pos, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", most=PART):
            data, at = utf8(batch.column("bytes"))
            n = np.diff(at) - width + 1
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            h = rolling(data, width)[np.repeat(at[:-1], n) + step].view(np.int64)
            doc, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "pos"))
            columns = [pa.array(h), pa.array(np.repeat(doc, n)), pa.array(np.repeat(pos, n) + step)]
            yield pa.RecordBatch.from_arrays(columns, ["h", "doc_id", "pos"])

    return run


def drop_repeats(docs: DataFrame, width: int = 100, gram: int = 32, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, keep..., n_bytes, n_removed, spans, kept) for each row of (doc_id, text).

    Of every text the bytes are removed that a string of `width` bytes covers which also starts earlier: in a smaller id or
    before in the same text. `spans` are the separate removed byte ranges, `kept` the remaining bytes, or with
    `as_text` their text without the characters that a removal has cut.

    A null text counts as empty; texts shorter than `width` bytes stay whole. Rows of one repeated id are ordered by the
    hashes of their texts and count as documents of their own; null ids count as one id, before all others. An empty table
    gives no rows. Other columns are carried only if named in `keep`.
    """
    rows = docs.select("doc_id", *keep, text_or_empty().alias("text"))
    ids = rows.select("doc_id")
    if ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), *keep)
        rows = written(rows.withColumn("sub", F.row_number().over(order) - 1), "numbered")
    else:
        rows = rows.withColumn("sub", F.lit(0))
    rows = rows.withColumnRenamed("doc_id", "_id").withColumn("doc_id", F.coalesce(F.col("_id").cast("long"), F.lit(-(2**63))))
    paths: list[str] = []
    runs = repeated_runs(rows.select("doc_id", "sub", "text"), width, gram, paths)
    runs = runs.withColumn("sub", F.shiftright("pos", SHIFT).cast("int")).withColumn("pos", F.col("pos") - F.shiftleft(F.col("sub").cast("long"), SHIFT))
    runs = written(runs.groupBy("doc_id", "sub").agg(F.collect_list("pos").alias("places"), F.collect_list("n").alias("counts")), "runs")
    discard(docs.sparkSession, paths)
    release(docs.sparkSession)
    carried = ["_id", *keep]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=4_000_000):
            data, at = utf8(batch.column("text"))
            spans, kept = [], []
            for i, (places, counts) in enumerate(zip(batch.column("places"), batch.column("counts"))):
                text = data[at[i] : at[i + 1]]
                if not places.is_valid:
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                start, n = places.values.to_numpy(zero_copy_only=False), counts.values.to_numpy(zero_copy_only=False)
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + n + width - 1, -1)
                gone = np.append(np.cumsum(change[:-1]) > 0, False)
                edges = np.flatnonzero(np.diff(gone, prepend=False))
                spans.append([{"start": a, "end": e} for a, e in edges.reshape(-1, 2).tolist()])
                kept.append(text[~gone[:-1]].tobytes())
            whole = np.diff(at)
            left = np.array([len(x) for x in kept], np.int64)
            remaining = pa.array([x.decode(errors="ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            columns = [*(batch.column(c) for c in carried), pa.array(whole), pa.array(whole - left), pa.array(spans, span), remaining]
            yield pa.RecordBatch.from_arrays(columns, [*carried, "n_bytes", "n_removed", "spans", "kept"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried)
    whole = rows.join(runs, ["doc_id", "sub"], "left").select(*carried, "text", "places", "counts")
    whole = whole.mapInArrow(remove, f"{schema}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept {'string' if as_text else 'binary'}")
    return whole.withColumnRenamed("_id", "doc_id")
