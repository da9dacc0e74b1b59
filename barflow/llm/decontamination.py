"""Operator 9: benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a document's passage by k = floor(m * rate) edits. Cut into k + 1 pieces, at least
one piece is untouched in any such passage (pigeonhole). An automaton finds the exact pieces in a text; around each hit the
passage is verified with the bit-parallel edit distance of Myers.

Matching is on normal text: lower case, runs of white space as one blank. Spans are given in code points of the given text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, text_or_empty

BLANK = re.compile(r"\s+")
#: Bytes of item text that one automaton may hold; more items are matched in further blocks.
BLOCK_BYTES = 4_000_000


def normal(text: str) -> str:
    """Lower case, each run of white space one blank, no blank at the ends."""
    return " ".join(_lower(text).split())


def _lower(text: str) -> str:
    low = text.lower()
    # letters whose lower case has more characters keep their form, so that places stay
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def places(text: str) -> tuple[str, list[int] | None]:
    """The normal text and, if any character moved, the place in `text` of each of its characters."""
    found, low = normal(text), _lower(text)
    if found == low:
        return found, None
    at, blank = [], False
    for i, c in enumerate(low):
        if c.isspace():
            blank = bool(at)
        else:
            if blank:
                at.append(i - 1)
                blank = False
            at.append(i)
    return found, at


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item in edits + 1 pieces of nearly equal size, each with its place."""
    n, m = edits + 1, len(item)
    return [(m * i // n, item[m * i // n : m * (i + 1) // n]) for i in range(n)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best match of the whole pattern anywhere in the text; None beyond `most` edits.

    Bit i of the vectors tells whether the distance rises or falls from row i to i + 1 of a column (Myers 1999); a match may
    start anywhere, so the row above the first is zero throughout. Of equal matches the one that ends first counts.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if score == 0:
                break
    return best


class Matcher:
    """Pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int):
        import ahocorasick

        self.items, self.tree, pieces_of = {}, ahocorasick.Automaton(), {}
        for number, text in items:
            form = normal(text)
            if not form:
                continue
            edits = min(int(len(form) * rate), max(0, len(form) // least - 1))
            self.items[number] = (form, edits)
            for at, piece in pieces(form, edits):
                pieces_of.setdefault(piece, []).append((number, at))
        for piece, uses in pieces_of.items():
            self.tree.add_word(piece, (len(piece), uses))
        if pieces_of:
            self.tree.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the passages of the normal text; overlapping hits of one item count once."""
        if not self.items:
            return []
        out, done = [], {}
        for end, (size, uses) in self.tree.iter(text):
            for number, at in uses:
                item, edits = self.items[number]
                start = end + 1 - size - at  # where the item would start without edits
                if start < -edits or start + len(item) > len(text) + edits:
                    continue
                tried = done.setdefault(number, [])
                if any(a <= start <= b for a, b in tried):
                    continue
                low, high = max(0, start - edits), min(len(text), start + len(item) + edits)
                if text.startswith(item, start) if start >= 0 else False:
                    found = (0, start + len(item) - low)
                else:
                    found = myers(item, text[low:high], edits)
                if found is None:
                    tried.append((start, start))
                    continue
                cost, stop = found
                # the start comes from the same search backwards from the end
                back = myers(item[::-1], text[low : low + stop][::-1], cost)
                first = low + stop - (back[1] if back else stop)
                out.append((number, first, low + stop, cost))
                tried.append((first - edits, low + stop - 1))
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of bounded size, by id; null ids or texts match nothing."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        block.append((len(block), row))
        size += len(row.text.encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


SPAN = "array<struct<item_id:long,start:long,end:long,edits:int>>"


def find_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, least: int = 12, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., hits) for each row of (doc_id, text): the passages within the edits of an item of (item_id, text).

    An item of m characters allows floor(m * rate) edits, fewer if its pieces would have under `least` characters. Null and
    empty texts have no hits; items without text match nothing; repeated items and ids give a hit each. Every document meets
    all items; blocks of items are matched one after the other. Empty tables give no rows or no hits. Spans of one item that
    overlap are one hit.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", *keep, text_or_empty().alias("_text"), F.array().cast(SPAN).alias("hits"))
    kinds = dict(rows.dtypes)
    carried = ["doc_id", *keep]
    span = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*carried, "_text"]) + f", hits {SPAN}"
    for block in item_blocks(benchmark):
        items = spark.sparkContext.broadcast([(n, r.item_id, r.text) for n, r in block])

        def match(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([(n, t) for n, _, t in items.value], rate, least)
            ids = {n: i for n, i, _ in items.value}
            for batch in slices(batches, "_text"):
                hits = batch.column("hits").to_pylist()
                for own, text in zip(hits, batch.column("_text")):
                    text = text.as_py()
                    form = normal(text)
                    found = matcher.matches(form)
                    if found:
                        at = places(text)[1]
                        for n, a, b, cost in found:
                            a, b = (a, b) if at is None else (at[a], at[b - 1] + 1)
                            own.append({"item_id": ids[n], "start": a, "end": b, "edits": cost})
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*carried, "_text"]), pa.array(hits, span)], [*carried, "_text", "hits"])

        rows = rows.mapInArrow(match, schema)
    return rows.select(*carried, F.array_sort("hits").alias("hits"))
