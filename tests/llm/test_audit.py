"""Operator 13: what filters remove, in every order."""

import random
import re
from itertools import permutations

import pytest

from barflow.llm.filter_audit import audit, mask_cells
from barflow.llm.queries import op13_filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(rows):
    """The filters that each row fails, as letters."""
    out = []
    for i, lang, text in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        fails += "E" * any(j is not None and i is not None and j < i and (u or "") == t for j, _, u in rows)
        out.append((lang or "", fails, i))
    return out


def plain(rows, labels, letters="ABCDE"):
    """Every order walked over the rows one by one."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out, totals = [], {}
    for part in {lang or "" for _, lang, _ in rows}:
        docs = [(fails, i) for p, fails, i in failed(rows) if p == part]
        for order in permutations(letters):
            alive = docs
            for step, letter in enumerate(order, 1):
                gone = [d for d in alive if letter in d[0]]
                alive = [d for d in alive if letter not in d[0]]
                all_failing = sum(letter in f for f, _ in docs)
                out.append([part, "".join(order), step, len(alive), len(gone), all_failing - len(gone), sum(f == letter for f, _ in docs), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)])
                totals[part, letter] = totals.get((part, letter), 0) + len(gone)
    return sorted((*r, totals[r[0], r[1][r[2] - 1]]) for r in out)


def made():
    rng = random.Random(4)
    words = ["The", "and", "x#", "UPPER", "é😀", "of", "b&b", "\t", "\n", *(f"w{k}" for k in range(300))]
    texts = ["", " ", "A", "short", *(" ".join(rng.choices(words[: rng.choice([6, 40, 309])], k=rng.choice([3, 99, 100, 101, 300]))) for _ in range(25))]
    rows = [(rng.randint(1, 80), rng.choice(["en", "fr", None]), rng.choice([*texts, None])) for _ in range(150)]
    rows += rows[:10] + [(None, "en", "short"), (None, "en", texts[9]), (None, None, None)]
    labels = [(i, rng.randint(0, 1), rng.choice([0, 1, None])) for i in range(1, 60)] + [(5, 1, 0), (None, 1, 1)]
    return rows, labels


def test_query_equals_a_walk_over_the_rows(spark, tmp_path):
    rows, labels = made()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, lang string, text string, mask long, hash string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op13_filter_audit(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, labels)


def test_cells_count_every_row(spark, make, odd):
    docs = make(odd)
    docs = docs.withColumn("lang", docs.source)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mask_cells(docs, labels).collect()
    want = {}
    for part, fails, _ in failed([(i, s, t) for i, t, s in odd]):
        key = part, sum(1 << "ABCDE".index(c) for c in fails)
        want[key] = want.get(key, 0) + 1
    assert {(r.part, r["mask"]): r.n for r in got} == want and not any(r.good or r.toxic for r in got)
    assert audit(mask_cells(docs.limit(0), labels)).count() == 0


def test_other_letters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 1, 1), ("p", 3, 4, 0, 4), ("q", 2, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    got = sorted(tuple(r) for r in audit(cells, "xy").collect())
    assert got == [
        ("p", "xy", 1, 5, 6, 0, 2, 1, 5, 8), ("p", "xy", 2, 5, 0, 4, 0, 0, 0, 4), ("p", "yx", 1, 7, 4, 0, 0, 0, 4, 4), ("p", "yx", 2, 5, 2, 4, 2, 1, 1, 8),
        ("q", "xy", 1, 1, 0, 0, 0, 0, 0, 0), ("q", "xy", 2, 0, 1, 0, 1, 0, 0, 2), ("q", "yx", 1, 0, 1, 0, 1, 0, 0, 2), ("q", "yx", 2, 0, 0, 0, 0, 0, 0, 0),
    ]
    for wrong in ("", "aa", "abcdefgh"):
        with pytest.raises(ValueError):
            audit(cells, wrong)
