"""Near-duplicates, repeated passages, fingerprints, mixing."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.llm.components import components
from barflow.llm.fingerprints import fingerprints
from barflow.llm.mixing import mix_documents, mixed_blocks, plan_mix, source_targets
from barflow.llm.near_duplicates import Index, near_duplicates
from barflow.llm.parse import drop_repeats
from barflow.llm.permutation import permuted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def corpus():
    """Bases with near copies of all degrees, exact copies, shared passages."""
    random.seed(11)
    vocabulary = ["".join(random.choice("abcdefgéñ") for _ in range(random.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    out, passage = [], text(40)
    for b in range(12):
        base = text(random.choice((3, 30, 80, 200))).split()
        for k in range(8):
            copy = list(base)
            for _ in range(k * len(base) // 60):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            out.append(" ".join(copy if b % 2 else [w.capitalize() for w in copy]))
    out += [f"{text(20)} {passage}\n{text(15)}" for _ in range(10)] + ["x y " * 200, "z " * 300]
    return list(enumerate(out, 10))


def brute_groups(rows, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_are_those_of_all_pairs(make, corpus, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make([(i, t, "a") for i, t in corpus]), percent=percent).collect()}
    assert got == brute_groups(corpus, percent)


def test_groups_of_odd_rows(make, odd):
    got = near_duplicates(make(odd)).collect()
    assert len(got) == len(odd)
    by = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in got}
    assert by[(1, 0)] == (1, True) and by[(2, 0)] == (2, True) and by[(3, 0)] == (3, True)
    assert by[(7, 5)] == (4, False) and by[(6, 1)] == (5, False) and by[(None, 1)] == (None, True)
    assert near_duplicates(make(odd).limit(0)).count() == 0


def test_texts_of_a_repeated_id_are_linked_each(make):
    random.seed(8)
    a, b = ([f"w{random.randrange(9000)}" for _ in range(200)] for _ in range(2))
    near = lambda words: " ".join([*words[:100], "changed", *words[101:]])
    a, near_a, b, near_b = " ".join(a), near(a), " ".join(b), near(b)
    got = near_duplicates(make([(5, a), (5, b), (6, near_a), (7, near_b), (None, a)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (5, 5), (5, 5), (6, 5), (7, 5)]
    got = near_duplicates(make([(3, near_a), (5, a), (5, b), (7, near_b), (5, b)])).collect()
    assert sorted((r.doc_id, r.component_id, r.chosen) for r in got) == [(3, 3, True), (5, 3, False), (5, 5, True), (5, 5, True), (7, 5, False)]
    one = near_duplicates(make([(5, a), (5, near_a), (6, a)])).collect()
    assert [r.component_id for r in one] == [5, 5, 5] and sum(r.chosen for r in one) == 1
    named = make([(5, a), (6, near_a)]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id: r.component_id for r in near_duplicates(named).collect()} == {"d5": "d5", "d6": "d5"}


def test_pipeline_stage_keeps_other_texts_of_an_id(spark, make):
    from corpus_pipeline import COLUMNS, near_duplicates as stage

    rows = [(3, "a b c d e f g"), (5, "a b c d e f g"), (5, "other words that stand alone"), (5, "other words that stand alone"), (None, "x"), (8, None)]
    docs = make(rows).withColumns({"lang": F.lit("en"), "n_chars": F.lit(1).cast("long")})
    got = stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, "x"), (3, rows[0][1]), (5, rows[2][1]), (8, "")]
    assert list(got[0].asDict()) == COLUMNS


def test_index_guarantee():
    index = Index()
    assert index.positions == 40 and index.distance == 15
    random.seed(2)
    for _ in range(300):  # any 15 positions leave some chunk with one error or none
        wrong = Counter(p // index.chunk for p in random.sample(range(40), 15))
        assert min(wrong[c] for c in range(index.chunks)) <= index.errors


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(300, 200), (200, 250)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == got[250] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_removal(rows, width=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            if s in seen:
                gone[k : k + width] = [True] * width
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(g and not p for p, g in zip([False, *gone], gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_removed_bytes_are_those_of_brute_force(make, corpus):
    rows = [*corpus, (5, corpus[3][1]), (9999, "é" * 30 + corpus[40][1] + "ñ" * 200)]
    frame = make([(i, t, "a") for i, t in rows]).repartition(7)
    got = drop_repeats(frame).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("k"), F.sha2("kept", 256).alias("s")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.k, r.s) for r in got} == brute_removal(sorted(rows))


def test_long_texts_are_parsed_in_parts(make, corpus, monkeypatch):
    from barflow.llm import parse

    text = " ".join(t for _, t in corpus)
    data, at = parse.np.frombuffer(text.encode(), parse.np.uint8), parse.np.array([0, len(text.encode())])
    monkeypatch.setattr(parse, "PART", 1000)
    pieces = list(parse.parts(data, at, 100))
    starts = [p + s for d, o, _, (p,) in pieces for s in range(len(d) - 99)]
    assert starts == list(range(len(data) - 99))


def test_removal_of_odd_rows(make, odd):
    got = drop_repeats(make(odd), as_text=True).collect()
    assert len(got) == len(odd)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_removed, len(r.kept)))
    assert by[1] == by[2] == [(0, 0)] and by[7][0][0] == 108000 and by[4][0][1] < 200 and by[5] == [(0, 7), (0, 7), (0, 5)] or sorted(by[5]) == [(0, 5), (0, 7), (0, 7)]
    assert drop_repeats(make(odd).limit(0)).count() == 0
    twice = drop_repeats(make([(1, "ab" * 80, "a"), (1, "ab" * 80, "a")])).collect()
    assert sorted(r.n_removed for r in twice)[1] == 160


def edited_texts(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        out[i] = (t[: len(t) - third] + following[:third], following)
    return out


def jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints(make, corpus):
    got = {r.doc_id: r for r in fingerprints(make([(i, t, "a") for i, t in corpus])).collect()}
    near, following, by_text = [], [], defaultdict(set)
    for i, t in corpus:
        edited, after = edited_texts(corpus)[i]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        by_text[" ".join(sorted(WORD.findall(t)))].add(got[i].fingerprint)
        near.append(got[i].near_edited - jaccard(t, edited))
        following.append(got[i].near_next - jaccard(t, after))
    assert all(len(f) == 1 for f in by_text.values())
    assert abs(sum(near) / len(near)) < 0.03 and abs(sum(following) / len(following)) < 0.03
    assert (sum(x * x for x in near) / len(near)) ** 0.5 < 0.12


def test_fingerprints_of_odd_rows(make, odd):
    rows = fingerprints(make(odd)).collect()
    assert len(rows) == len(odd) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {"0" * 256}
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 7)}) == 1
    lone = fingerprints(make([(1, "a b c", "x")])).first()
    assert lone.near_next == 1.0 and fingerprints(make(odd).limit(0)).count() == 0


def test_permutations(spark):
    for n in (1, 2, 3, 7, 100, 1023):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), 3)).collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


def level(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """Targets by resharing until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > most * sizes[s]}
        if not full:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_targets(spark):
    random.seed(4)
    for n in (1, 2, 5, 23):
        sizes = {**{f"s{k}": random.randint(0, 1000) for k in range(n)}, None: 50}
        frame = spark.createDataFrame([(f"={s}" if s else "null", s, v) for s, v in sizes.items()], "skey string, source string, source_size long")
        got = {r.source: r.target for r in source_targets(frame, (5, 2, 1), 1.5, 2.0).collect()}
        assert got == pytest.approx(level(sizes))


def test_mix_takes_what_the_slots_say(make):
    random.seed(6)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(random.randint(0, 90))), random.choice(["a", "b", "c", None])) for i in range(200)]
    frame, block = make(rows), 16
    got = {r.doc_id: r for r in mix_documents(frame, block=block).collect()}
    words = Counter(w for r in mixed_blocks(frame, block=block).collect() for w in r.words)
    for i, t, s in rows:
        mine = t.split()
        assert got[i].size == len(mine) and got[i].taken == sum(words[w] for w in mine) <= 2 * len(mine) and got[i].source == s
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    for s, t in level(sizes).items():
        taken = sum(r.taken for r in got.values() if r.source == s)
        assert abs(taken - t) <= block and all(r.target == pytest.approx(t) for r in got.values() if r.source == s)
    again = {r.doc_id: r.taken for r in mix_documents(frame.repartition(5), block=block).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    shards = plan_mix(frame, block=block, shard_slots=64).uses.groupBy("shard").count().collect()
    assert sum(r["count"] for r in shards) > 64 and max(r["count"] for r in shards) <= 64


def test_mix_of_odd_rows(make, odd):
    got = mix_documents(make(odd)).collect()
    assert len(got) == len(odd) and all(r.taken <= 2 * r.size for r in got)
    assert mix_documents(make(odd).limit(0)).count() == 0 and mix_documents(make([(1, None, None)])).first().target == 0


def test_blocks_of_odd_rows_lose_no_word(make, odd, monkeypatch):
    rows = [*((i, t and t[:300], s) for i, t, s in odd), (None, "a b c d", "b"), (1, "e f", "b"), (1, "g h i", "b"), (1, "j k", "c"), (1, "l m", "c")]
    frame = make(rows)
    taken, blocks = mix_documents(frame, block=2).collect(), mixed_blocks(frame, block=2).collect()
    by_source, words = Counter(), Counter()
    for r in taken:
        by_source["null" if r.source is None else f"={r.source}"] += r.taken
    for r in blocks:
        words[r.skey] += len(r.words)
    assert all(r.words for r in blocks) and words == +by_source
    every = {w for _, t, _ in rows for w in WORD.findall(t or "")}
    limit = Counter({w: 2 * n for w, n in Counter(w for _, t, _ in rows for w in WORD.findall(t or "")).items()})
    used = Counter(w for r in blocks for w in r.words)
    assert set(used) <= every and all(used[w] <= limit[w] for w in used)
    assert mixed_blocks(frame.limit(0)).count() == 0

    from barflow.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_RANGE", 3)  # running totals over several ranges give the same slots
    again = mixed_blocks(frame, block=2, shard_slots=64).collect()
    monkeypatch.setattr(mixing, "SHARD_RANGE", 10**6)
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixed_blocks(frame, block=2, shard_slots=64).collect()))


def test_parities_bound_the_common_shingles(spark):
    from barflow.llm.near_duplicates import may_share_enough, parities

    rng = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        both, a, b = (rng.integers(0, 2**63, int(k), dtype=np.uint64) for k in rng.integers(1, [300, 120, 120]))
        x, y = (np.unique(np.concatenate([both, own])) for own in (a, b))
        common = len(np.intersect1d(x, y))
        rows.append((len(x), len(y), *parities([x, y]), 100 * common >= 80 * (len(x) + len(y) - common)))
    d = spark.createDataFrame(rows, "n int, m int, p array<long>, q array<long>, linked boolean")
    got = d.select("linked", may_share_enough(80, "n", "m", "p", "q").alias("may")).collect()
    assert all(r.may for r in got if r.linked) and any(r.linked for r in got)
    assert sum(r.may for r in got) < 1.2 * sum(r.linked for r in got)
