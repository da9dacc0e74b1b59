"""Operator 5: document fingerprints by consistent weighted sampling. DataFrame functions only.

For each of k draws a term t of weight w gets r and c from Gamma(2, 1) and b from Uniform(0, 1), all of them hashes of (t,
draw). With m = floor(ln w / r + b) the term's value is ln c - r * (m - b + 1); the term of the smallest value and its m are
the sample. Two documents have equal samples with the chance sum(min(w, w')) / sum(max(w, w')), the generalised Jaccard
similarity of their weights (here: the counts of their words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_or_empty, written

DRAWS = 32
PER_ROW = 8
SPACES = r"[\x20\x09-\x0D]+"
#: Documents a bucket of neighbours has on average; 16 to 4096 buckets.
BUCKET_DOCS = 1000


def _uniform(h: Column, k: int) -> Column:
    """The k-th 16 bits of h as a number inside (0, 1)."""
    return (F.shiftrightunsigned(h, 16 * k).bitwiseAND(F.lit(65535)) + F.lit(0.5)) / F.lit(65536.0)


def draw_values(term: Column, draw: Column) -> list[Column]:
    """r, b and ln c + r * (b - 1) of a term in a draw."""
    h, g = F.xxhash64(term, draw), F.xxhash64(term, draw + 1000)
    r = -F.ln(_uniform(h, 0) * _uniform(h, 1))
    c = -F.ln(_uniform(h, 2) * _uniform(h, 3))
    b = (g.bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(0.5)) / F.lit(4294967296.0)
    return [r, b, F.ln(c) + r * (b - 1)]


def sample_key(term: Column, log_weight: Column, r: Column, b: Column, q: Column) -> Column:
    """A long that sorts by the value of the term in its upper bits and names (term, m) in its lower 32 bits."""
    m = F.floor(log_weight / r + b)
    upper = F.greatest(F.lit(0.0), F.least(F.lit(127.99), q - r * m + 96)) * F.lit(16777216.0)
    name = term.bitwiseXOR(F.shiftleft(m, 20)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(upper.cast("long"), 32).bitwiseOR(name)


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, row, doc_id, text and `next`, the text of the next row by descending id (after the last: the first).

    Buckets are ranges of ids between approximate quantiles; each bucket's last row gets the first row of the following
    bucket. Ties are ordered by the texts' hashes; a null id comes last.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    ids = rows.select("key")
    count = ids.count()
    n = min(64, max(4, round((count / BUCKET_DOCS) ** 0.5)))
    shares = [(i + 1) / (n * n) for i in range(n * n - 1)]
    cuts = ids.agg(F.percentile_approx("key", shares, 10 * n * n).alias("c")).first().c or []
    # the number of cuts at or below the key: first among every n-th cut, then among the n after it
    coarse = F.array(*(F.lit(c) for c in cuts[n - 1 :: n])) if len(cuts) >= n else F.array().cast("array<long>")
    fine = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<long>")
    jump = F.size(F.filter(coarse, lambda c: c <= F.col("key"))) * n
    rows = rows.withColumn("jump", jump)
    bucket = F.col("jump") + F.size(F.filter(F.slice(fine, F.col("jump") + 1, F.lit(n)), lambda c: c <= F.col("key")))
    rows = rows.withColumn("bucket", bucket).withColumn("tie", F.xxhash64("text")).drop("jump")

    heads = rows.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("head"))
    order = Window.orderBy(F.col("bucket").desc())
    after = F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("bucket").alias("last_of"), after.alias("head"))  # at most 4096 rows
    heads = heads.select("last_of", F.col("head.key").alias("key"), F.col("head.tie").alias("tie"))
    texts = rows.select("key", "tie", F.col("text").alias("head_text")).join(F.broadcast(heads), ["key", "tie"])
    texts = written(texts.groupBy(F.col("last_of").alias("bucket")).agg(F.first("head_text").alias("head_text")), "heads")

    w = Window.partitionBy("bucket").orderBy(F.col("key").desc(), F.col("tie").desc())
    rows = rows.withColumn("row", F.row_number().over(w)).withColumn("inside", F.lead("text").over(w))
    return rows.join(texts, "bucket", "left").select("bucket", "row", "doc_id", "text", F.coalesce("inside", "head_text").alias("next"))


def term_weights(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """For each key and term: how often the term is in each of the text columns (w0, w1, ...). Terms are hashes of words."""
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(t).alias("t")) for i, t in enumerate(texts)))).alias("x")
    words = rows.select(*keys, sides).select(*keys, "x.side", F.explode(F.split("x.t", SPACES)).alias("word")).where("word != ''")
    counts = [F.sum((F.col("side") == i).cast("long")).alias(f"w{i}") for i in range(len(texts))]
    return words.select(*keys, "side", F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(*counts)


def sample(terms: DataFrame, keys: list[str], sides: int, draws: int) -> DataFrame:
    """f0, f1, ...: for each side the array of the samples' names; missing where a side has no terms.

    Draws are made PER_ROW at a time, on copies of the term's row: one aggregate over all draws would be more code than the
    virtual machine compiles.
    """
    turns = -(-draws // PER_ROW)
    logs = [F.when(F.col(f"w{s}") > 0, F.ln(F.col(f"w{s}").cast("double"))).alias(f"l{s}") for s in range(sides)]
    turned = terms.select(*keys, "term", *logs, F.explode(F.array(*(F.lit(t) for t in range(turns)))).alias("turn"))
    values = [v.alias(f"{n}{i}") for i in range(PER_ROW) for n, v in zip("rbq", draw_values(F.col("term"), F.col("turn") * PER_ROW + i))]
    drawn = turned.select(*keys, "turn", "term", *(f"l{s}" for s in range(sides)), *values)
    names = [[f"k{s}_{i}" for i in range(PER_ROW)] for s in range(sides)]
    found = [F.min(sample_key(F.col("term"), F.col(f"l{s}"), *(F.col(f"{n}{i}") for n in "rbq"))).alias(names[s][i]) for s in range(sides) for i in range(PER_ROW)]
    least = drawn.groupBy(*keys, "turn").agg(*found)
    part = [F.when(F.col(n[0]).isNotNull(), F.array(*(F.col(x).bitwiseAND(F.lit(0xFFFFFFFF)) for x in n))).alias(f"f{s}") for s, n in enumerate(names)]
    whole = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn", *part))).alias("parts"))
    joined = [F.slice(F.flatten(F.col(f"parts.f{s}")), 1, draws).alias(f"f{s}") for s in range(sides)]
    return whole.select(*keys, *joined)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; 1 for two texts without words, 0 if one has words."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def shown(f: Column, draws: int) -> Column:
    """The samples as hexadecimal text, zeros for a text without words."""
    return F.coalesce(F.array_join(F.transform(f, lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.lit("0" * 8 * draws))


def fingerprints(docs: DataFrame, draws: int = DRAWS) -> DataFrame:
    """Fingerprints of each row of (doc_id, text) and of its edited text, with their likenesses.

    The edited text has its last third of code points replaced by as many (or all) of the next document, by descending id.
    A null text counts as empty; a lone row is its own next document. Repeated rows are rows of their own. An empty table
    gives no rows.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next", F.lit(1), third))
    rows = with_next(docs).select("bucket", "row", "doc_id", "text", edited.alias("edited"))
    keys = ["bucket", "row"]
    # both branches read the same columns, so that they share the one shuffle of the texts
    prints = sample(term_weights(rows, [*keys, "doc_id"], ["text", "edited"]), [*keys, "doc_id"], 2, draws).drop("doc_id")
    facts = rows.select(*keys, "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    whole = written(facts.join(prints, keys, "left"), "fingerprints")

    w = Window.partitionBy("bucket").orderBy("row")
    heads = whole.where("row = 1").select("bucket", F.col("f0").alias("head"), F.lit(1).alias("there"))
    order = Window.orderBy(F.col("bucket").desc())
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("bucket", F.when(F.lead("there").over(order) == 1, F.lead("head").over(order)).otherwise(F.first("head").over(every)).alias("head"))
    rows = whole.withColumn("inside", F.lead("f0").over(w)).withColumn("more", F.lead("row").over(w)).join(heads, "bucket")
    following = F.when(F.col("more").isNotNull(), F.col("inside")).otherwise(F.col("head"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("f0"), draws).alias("fingerprint"), shown(F.col("f1"), draws).alias("edited_fingerprint"),
        likeness(F.col("f0"), F.col("f1")).alias("near_edited"), likeness(F.col("f0"), following).alias("near_next"),
    )
