"""Operator 12: periodic runs."""

import hashlib
import random
import re
import zlib

import pytest

from barflow.llm.periodic import PRIME, find_runs, in_texts, periodic_runs, squared_differences
from barflow.llm.queries import op12_periodic_runs

np = pytest.importorskip("numpy")


def plain_runs(words, least=6, times=4):
    """By definition: every stretch of equal words at distance q, if q is its smallest period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                part = words[i : j + q]
                if next(d for d in range(1, q + 1) if part[:-d] == part[d:]) == q:
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out)


def random_words(rng):
    if rng.random() < 0.5:
        return [rng.randint(0, rng.choice([1, 2, 3])) for _ in range(rng.randint(0, 60))]
    words = []
    for _ in range(rng.randint(1, 4)):
        period = [rng.randint(0, 3) for _ in range(rng.randint(1, 12))]
        words += (period * rng.randint(1, 8))[: rng.randint(1, 80)]
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = 9
    return words


def test_runs_are_those_of_the_definition():
    rng = random.Random(5)
    for _ in range(800):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        before = np.cumsum([0] + [len(t) for t in texts])
        assert in_texts(np.array([w for t in texts for w in t], np.uint64), before) == [plain_runs(t) for t in texts]


def test_transforms_are_exact():
    rng = np.random.default_rng(1)
    for size in (2, 8, 64):
        blocks, windows = (rng.integers(0, 10**6, (5, k)).astype(np.uint64) for k in (size, 2 * size))
        got = squared_differences(blocks, windows)
        for t in range(size + 1):
            plain = [sum((int(a) - int(b)) ** 2 for a, b in zip(blocks[r], windows[r, t : t + size])) % int(PRIME) for r in range(5)]
            assert got[:, t].tolist() == plain


def test_long_rows_and_zeros_that_the_modulus_makes():
    assert find_runs(np.ones(100_000, np.uint32)) == [(0, 100_000, 1)]
    assert find_runs(np.array([1, 2, 3, 4, 5, 6, 7] * 9000 + list(range(10, 5000)), np.uint32)) == [(0, 63_000, 7)]
    assert find_runs(np.array([0, int(PRIME)] * 2 + [0, 5, 0, int(PRIME)], np.uint32)) == []
    assert find_runs(np.zeros(0, np.uint32)) == []
    with pytest.raises(ValueError):
        find_runs(np.ones(9, np.uint32), times=3)


def plain(doc_id, text):
    """The contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    numbers = (*best[:2], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *numbers, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_the_contract(spark, tmp_path, odd):
    rng = random.Random(2)
    odd = [(i, (t or "")[:3000] if t else t) for i, t, _ in odd]
    rows = odd + [(100 + i, " \n".join(["ab", "é😀", "x", "y"][w % 4] * (1 + w % 3) for w in random_words(rng)) + rng.choice(["", " ", "\t"])) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randint(0, 200)))) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((plain(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 100


def test_odd_rows(make, odd):
    got = periodic_runs(make(odd), keep=("source", "score")).collect()
    assert len(got) == len(odd) and {r.doc_id for r in got} == {r[0] for r in odd}
    long = [r for r in got if r.doc_id in (4, 7)]
    assert [(r.runs[0].start, r.runs[0].length, r.runs[0].period) for r in long] == [(0, 20_000, 5)] * 2
    assert all(r.collapsed == "lorem ipsum dolor sit amet" for r in long)
    assert [r.n_words for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert periodic_runs(make([]).limit(0)).count() == 0
