"""Operator 7: near-duplicates by MinHash and a multi-index Hamming join.

A document's signature has 40 positions of 16 bits, one for each hash function's smallest shingle. Two documents are at the
distance of the number of positions in which they differ. Cut into 8 chunks of 5 positions, two signatures at a distance of
15 or less differ in at most one position of some chunk (pigeonhole: 8 * 2 > 15), so they meet under the key of that chunk
without that position: every document has 8 * 5 keys, and no pair under the distance is lost. A pair misses all keys with a
chance of 6e-7 at a similarity of 0.85, and of 2e-5 at 0.8.

What meets is confirmed on the full shingle sets. Within a key no pairs are made at first: all are compared with a pivot, so
that a group of copies becomes one component. Only keys that then still hold several components go on: of their members,
those are set aside that have too few shingles in common with other components to be linked to any, and the others are
compared across components. Before two sets are fetched, the parities of their shingles in 2048 buckets are compared: a bucket
whose parities differ holds a shingle that only one of them has, so their number bounds the common shingles from above, and
pairs that cannot reach the similarity are refused without a loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import slices, text_or_empty, utf8, written
from .words import LOWER, hashes, mixed, spans

BASE = np.uint64(0xD6E8FEB86659FD93)
#: Numbers of 64 bits that hold the parities of a set.
WORDS = 32


@dataclass(frozen=True)
class Index:
    """Signature and index: `chunks` of `chunk` positions, of which `errors` may differ."""

    chunks: int = 8
    chunk: int = 5
    errors: int = 1
    slack: int = 5  # what the index finds this much beyond its guarantee is confirmed too

    @property
    def positions(self) -> int:
        return self.chunks * self.chunk

    @property
    def distance(self) -> int:
        """All pairs at this distance or less share a key."""
        return self.chunks * (self.errors + 1) - 1


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; with fewer words than `width` the whole sequence is the one shingle."""
    low = LOWER[data]
    s, e, before = spans(low, at)
    words = hashes(low, s, e)
    out = []
    with np.errstate(over="ignore"):
        rows = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rows = rows * BASE + words[k : k + len(rows)]
        rows = mixed(rows)
        for i in range(len(at) - 1):
            a, b = before[i], before[i + 1]
            if b - a >= width:
                out.append(np.unique(rows[a : b - width + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = h * BASE + w
                out.append(mixed(np.array([h ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value under each hash function."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            least = np.minimum(least, ((shingles[i : i + 2048, None] ^ shifts) * factors).min(axis=0))
    return (mixed(least) & np.uint64(0xFFFF)).astype(np.int32)


def set_hashes(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two 64-bit hashes of each set; sets that agree in all three count as equal."""
    with np.errstate(over="ignore"):
        h1 = [int(x.sum(dtype=np.uint64).astype(np.int64)) for x in sets]
        h2 = [int(np.bitwise_xor.reduce(mixed(x), initial=np.uint64(0)).astype(np.int64)) for x in sets]
    return [pa.array(column, pa.int64()) for column in ([len(x) for x in sets], h1, h2)]


def signatures(docs: DataFrame, index: Index, width: int) -> DataFrame:
    """doc_id, text_hash, n (set size), h1 and h2 (hashes of the set), sig (array of int; empty for an empty set)."""
    random = np.random.default_rng(7)
    factors = random.integers(0, 2**63, index.positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 2**63, index.positions, dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*utf8(batch.column("text")), width)
            sig = [signature(x, factors, shifts).tolist() if len(x) else [] for x in sets]
            columns = [batch.column("doc_id"), batch.column("text_hash"), *set_hashes(sets), pa.array(sig, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "h1", "h2", "sig"])

    rows = docs.select("doc_id", text_hash().alias("text_hash"), text_or_empty().alias("text"))
    return rows.mapInArrow(sign, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n long, h1 long, h2 long, sig array<int>")


def text_hash():
    """64-bit hash that tells the texts of one id apart; a null text counts as empty."""
    return F.xxhash64(text_or_empty())


def chunk_keys(index: Index, sig: str = "sig"):
    """Array of the keys of a signature: each chunk without each choice of the positions that may differ."""
    keys = []
    for c in range(index.chunks):
        for k, left in enumerate(combinations(range(index.chunk), index.chunk - index.errors)):
            keys.append(F.xxhash64(F.lit(c * 1000 + k), *(F.col(sig)[c * index.chunk + i] for i in left)))
    return F.array(*keys)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("x"), batch.column("y")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                keep[i] = 100 * common >= percent * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep))

    x, y = sets.select(F.col("id").alias("u"), F.col("set").alias("x")), sets.select(F.col("id").alias("v"), F.col("set").alias("y"))
    return pairs.join(y, "v").join(x, "u").select("u", "v", "x", "y").mapInArrow(check, "u long, v long")


def can_link(index: Index, percent: int, n: str, m: str, sig: str, other: str):
    """Whether set sizes and signatures allow a link."""
    distance = F.aggregate(F.zip_with(sig, other, lambda a, b: (a != b).cast("int")), F.lit(0), lambda k, x: k + x)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (distance <= index.distance + index.slack)


def parities(sets: list[np.ndarray]) -> list[list[int]]:
    """For each set the parity of its number of shingles in each of 64 * WORDS buckets, as WORDS numbers of 64 bits."""
    out = []
    for shingles in sets:
        odd = np.bincount(mixed(shingles ^ BASE) % np.uint64(64 * WORDS), minlength=64 * WORDS) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist())
    return out


def may_share_enough(percent: int, n: str, m: str, parity: str, other: str):
    """Whether the parities of two sets of n and m shingles allow a link."""
    differ = sum((F.bit_count(F.col(parity)[i].bitwiseXOR(F.col(other)[i])) for i in range(WORDS)), F.lit(0))
    return (F.col(n) + F.col(m) - differ) * (100 + percent) >= 2 * percent * (F.col(n) + F.col(m))


def close_pairs(pairs: DataFrame, members: DataFrame, index: Index, percent: int) -> DataFrame:
    """Of the candidate pairs (u, v), those that signature and set sizes allow."""
    side = lambda name, other: members.select(F.col("id").alias(name), F.struct("sig", "n").alias(other))
    both = pairs.join(side("v", "q"), "v").join(side("u", "p"), "u")
    return both.where(can_link(index, percent, "p.n", "q.n", "p.sig", "q.sig")).select("u", "v")


def linkable(tagged: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, common) of the members (key, id, label, n) that can have a link to another label; `common` counts the shingles that
    other labels have too.

    Sets of n and m shingles are linked only with an intersection of percent / (100 + percent) * (n + m). It is at most
    `common`, m is at least percent / 100 * n and at least the smallest size in the member's keys.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "set", most=4_000_000):
            data, at = utf8(batch.column("set"))
            times = np.diff(at) // 8
            columns = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), times)) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data.tobytes(), np.int64)), *columns], ["s", "id", "label"])

    least = tagged.groupBy("key").agg(F.min("n").alias("least"))
    ids = tagged.join(least, "key").groupBy("id").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.min("least").alias("least"))
    each = sets.join(ids.select("id", "label"), "id").select("id", "label", "set").mapInArrow(shingles, "s long, id long, label long")
    shared = each.groupBy("s").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("s")
    found = each.join(shared, "s").groupBy("id").agg(F.count("*").alias("common")).join(ids, "id")
    enough = F.col("common") * (100 + percent) >= percent * (F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100)))
    return written(found.where(enough).select("id", "common"), "linkable")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, index: Index = Index()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, chosen) for each row of (doc_id, text).

    Texts without words (null, empty, blank) have the size 0 and stand alone. Equal sets form one class. Classes are linked,
    not ids: the texts of one repeated id may be in different components. `component_id` is the smallest id with a text in the
    row's component, so components with the same smallest id show the same number. `kept` is doc_id = component_id; `chosen`
    is true for the rows of one class of each component, among those kept. Rows with a null id link nothing, stand alone with
    a null component and are kept and chosen. An empty table gives no rows. Ids may be of any ordered type.
    """
    signed = written(signatures(docs, index, width), "signatures")
    whole = signed.where("n > 0 and doc_id is not null")
    classes = whole.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("lead"), F.first("sig").alias("sig"))
    # the number of a class is fixed by writing it
    members = written(classes.select(F.monotonically_increasing_id().alias("id"), "lead", "n", "sig", "h1", "h2"), "classes")
    keyed = members.select("id", F.posexplode(chunk_keys(index)).alias("k", "key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    keyed = written(keyed.join(crowded, "key"), "keys")

    wanted = members.join(keyed.select("id").distinct(), "id", "left_semi").select("id", "lead", "n", "h1", "h2")
    chosen = docs.select("doc_id", text_or_empty().alias("text")).join(wanted.select(F.col("lead").alias("doc_id")), "doc_id", "left_semi")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(*utf8(batch.column("text")), width)
            columns = [*set_hashes(sets), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(parities(sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["n", "h1", "h2", "set", "parity"])

    # a smallest id may have several texts: each class takes the set that has its size and hashes
    sets = chosen.select("text").mapInArrow(full, "n long, h1 long, h2 long, set binary, parity array<long>").dropDuplicates(["n", "h1", "h2"])
    sets = written(sets.join(wanted.drop("lead"), ["n", "h1", "h2"]).select("id", "set", "parity"), "sets")

    ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    # every member of a key with its pivot: the member that meets most others, over all its keys
    central = keyed.groupBy("id").agg(F.sum("c").alias("central"))
    pivot = keyed.join(central, "id").groupBy("key").agg(F.max(F.struct("central", (-F.col("id")).alias("first"))).alias("p"))
    star = keyed.join(pivot.select("key", (-F.col("p.first")).alias("pivot")), "key").where("id != pivot")
    star = close_pairs(star.select(*ordered("id", "pivot")).distinct(), members, index, percent)
    edges = written(confirmed(star, sets, percent), "links")
    labels = written(components(edges), "labels")

    # keys that still hold several components: the pairs of their members that can be links
    tagged = keyed.join(labels, "id", "left").select("key", "k", "id", F.coalesce("label", "id").alias("label"))
    mixed_keys = tagged.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("key")
    tagged = written(tagged.join(mixed_keys, "key").join(members.select("id", "n"), "id"), "open")
    left = linkable(tagged, sets, percent).join(members.select("id", "sig", chunk_keys(index).alias("keys")), "id")
    left = tagged.join(left.join(sets.select("id", "parity"), "id"), "id")
    right = left.select("key", *(F.col(c).alias(f"{c}_") for c in ("id", "label", "n", "common", "sig", "keys", "parity")))
    first = F.array_position(F.zip_with("keys", "keys_", lambda a, b: a == b), F.lit(True)) == F.col("k") + 1  # each pair once
    overlap = F.least("common", "common_") * (100 + percent) >= percent * (F.col("n") + F.col("n_"))
    possible = (F.col("label") < F.col("label_")) & overlap & may_share_enough(percent, "n", "n_", "parity", "parity_")
    possible = possible & first & can_link(index, percent, "n", "n_", "sig", "sig_")
    pairs = left.join(right, "key").where(possible)
    more = written(confirmed(pairs.select(*ordered("id", "id_")), sets, percent), "links")
    labels = components(more.union(labels.where("id != label").select(F.col("id").alias("u"), F.col("label").alias("v"))))

    named = members.join(labels, "id", "left").select("n", "h1", "h2", "lead", F.coalesce("label", "id").alias("label"))
    first = named.groupBy("label").agg(F.min(F.struct("lead", "n", "h1", "h2")).alias("first"))
    same = (F.col("n") == F.col("first.n")) & (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))
    by_class = named.join(first, "label").select("n", "h1", "h2", F.col("first.lead").alias("class"), same.alias("leads"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id"))
    rows = signed.join(by_class, ["n", "h1", "h2"], "left").select("doc_id", "n", component.alias("component_id"), "leads", "text_hash")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    leads = F.coalesce(F.col("leads"), F.lit(True)) | F.col("doc_id").isNull()
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "text_hash", (kept & leads).alias("chosen"))
