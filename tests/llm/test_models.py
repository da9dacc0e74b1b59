"""Toxicity, quality, the language model, the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barflow.llm import hmm, queries
from barflow.llm.quality import fit_quality, score_quality
from barflow.llm.toxicity import fit_toxicity, score_toxicity, sentences

np = hmm.np
SF = "/root/testdata/sf0.01"


def separation(rows):
    """Chance that a row of label 1 has the higher score."""
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.fixture(scope="module")
def labelled(spark):
    random.seed(8)
    names = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "eno", "ilu", "or")]
    rows, labels = [], []
    for i in range(900):
        text = [random.choice(names) for _ in range(random.choice((10, 60, 300)))]
        toxic = i % 5 == 0
        for _ in range(random.randint(1, 4) if toxic else 0):
            text[random.randrange(len(text))] = random.choice(("vile", "nasty"))
        body = "".join(w + random.choice((" ", " ", " ", ". ", "!\n")) for w in text)
        bad = i % 4 == 0
        rows.append((i, (body.upper().replace(" ", "!! ") if i % 8 else "dup dup " * 100 + body[:50]) if bad else body))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (10**9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_documents_and_sentences(make, odd, labelled):
    docs, labels = labelled
    model = fit_toxicity(docs, labels.where("doc_id % 3 != 0"))
    held = score_toxicity(docs.where("doc_id % 3 = 0"), model).join(labels, "doc_id").collect()
    assert separation([(r.score, r.toxic) for r in held]) > 0.95
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.95
    texts = {r.doc_id: r.text for r in docs.collect()}
    spots = [texts[r.doc_id][s.start : s.end].lower() for r in held if r.toxic for s in r.offending]
    assert spots and sum("vile" in s or "nasty" in s for s in spots) / len(spots) > 0.95
    got = score_toxicity(make(odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got) and all(r.predicted == 0 for r in got)
    none = fit_toxicity(docs, labels.limit(0))
    assert none.weights == {} and score_toxicity(make(odd).limit(0), none).count() == 0


def test_toxicity_learns_words_in_few_documents(spark):
    random.seed(13)
    names, slurs = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "eno", "ilu", "or")], [f"slur{c}" for c in "abcdef"]
    rows, labels = [], []
    for i in range(3000):  # each slur in nine labelled rows, 0.3 %; ten clean rows with a wrong label; thirty copies of one text
        text = [random.choice(names) for _ in range(random.choice((20, 80)))]
        if slur := i < 54:
            text[random.randrange(len(text))] = slurs[i % 6]
        rows.append((i, "unique words of a copy" if i >= 2970 else " ".join(text[:10]) + ". " + " ".join(text[10:])))
        labels.append((i, int(slur or i % 290 == 60 or i >= 2970)))
    model = fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(slurs) <= set(model.weights) and min(model.weights[w] for w in slurs) > 2 and "unique" not in model.weights
    held = [(k, f"{' '.join(random.choices(names, k=30))}. {w} {' '.join(random.choices(names, k=9))}") for k, w in enumerate(slurs + ["plain"] * 30)]
    got = {r.doc_id: r.predicted for r in score_toxicity(spark.createDataFrame(held, "doc_id long, text string"), model).collect()}
    assert [got[k] for k in range(36)] == [1] * 6 + [0] * 30


def test_sentences_cover_all_words():
    text = "One two. Three\nfour! " + "w " * 200
    found = [w for _, _, words in sentences(text) for w in words]
    assert found == re.findall(r"[^\W\d_]+", text.lower()) and max(len(w) for _, _, w in sentences(text)) <= 60


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    from barflow.llm import quality

    n = 20_600
    docs = spark.range(n).selectExpr("id doc_id", "if(id % 3 = 0, concat('!! ', id, ' !!'), concat('plain words ', id)) text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 <> 0) quality")
    tables = {}

    def kept(df, name):
        return tables.setdefault(name, plain(df, name))

    plain = quality.written
    monkeypatch.setattr(quality, "written", kept)
    model = fit_quality(docs, labels, pairs=1000)
    rows = [r.features for r in tables["quality-known"].collect()]
    assert len(rows) == n and tables["quality-pairs"].count() == sum(i % 3 != 0 for i in range(n))
    scores = sorted(sum(x * w for x, w in zip(r, model.weights)) for r in rows)
    at = -(-n // 3) / n * (n - 1)
    want = scores[int(at)] + (at - int(at)) * (scores[int(at) + 1] - scores[int(at)])
    assert abs(model.threshold - want) < 1e-9
    assert [r.n for r in tables["quality-numbered"].groupBy("y").agg(F.count_distinct("k").alias("n")).orderBy("y").collect()] == [-(-n // 3), n - -(-n // 3)]


def test_quality_moves_no_text(spark, monkeypatch):
    from barflow.llm import quality

    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    plain = quality.written
    monkeypatch.setattr(quality, "written", kept)
    docs = spark.range(300).selectExpr("id doc_id", "if(id % 3 = 0, concat('!! ', id, ' !!'), concat('plain words ', id)) text")
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 <> 0) quality")
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: docs if name == "documents" else labels)
    got = queries.op6_quality(spark, "")
    assert not any("Exchange" in p and "_text" in p for p in plans.values())
    assert "_text" not in got._jdf.queryExecution().executedPlan().toString()  # measured once, for learning and scoring
    rows = labels.where(queries.remainder() != 0)
    want = score_quality(docs, fit_quality(docs, rows)).collect()
    assert {r.doc_id: r.predicted for r in got.collect()} == {r.doc_id: r.predicted for r in want}


def test_quality_ranks_held_out_documents(make, odd, labelled):
    docs, labels = labelled
    model = fit_quality(docs, labels.where("doc_id % 3 != 0"), pairs=4000)
    held = score_quality(docs.where("doc_id % 3 = 0"), model).join(labels.where("quality is not null"), "doc_id").collect()
    assert separation([(r.score, r.quality) for r in held]) > 0.95
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    got = score_quality(make(odd), model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert fit_quality(docs, labels.where("quality = 1")) is None
    assert {r.score for r in score_quality(make(odd), None).collect()} == {0.3}
    assert score_quality(make(odd).limit(0), model).count() == 0


def test_forward_and_expected_counts_against_all_paths():
    random_ = np.random.default_rng(1)
    k, c = 2, 3
    m = hmm.normal(random_.random(k), random_.random((k, k)), random_.random((c, k)))
    texts = [np.array(x) for x in ([0, 1, 2], [2], [1, 1])]
    sums = hmm.Hmm(np.zeros(k), np.zeros((k, k)), np.zeros((c, k)))
    for part, flat, sizes in hmm.batches_of(texts):
        hmm.expected(m, flat, sizes, sums)
        logs = dict(zip(part, hmm.forward(m, flat, sizes)))
    from itertools import product

    start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    for i, x in enumerate(texts):
        chances = {}
        for path in product(range(k), repeat=len(x)):
            p = m.start[path[0]] * m.emits[x[0], path[0]]
            for t in range(1, len(x)):
                p *= m.moves[path[t - 1], path[t]] * m.emits[x[t], path[t]]
            chances[path] = p
        total = sum(chances.values())
        assert logs[i] == pytest.approx(math.log10(total))
        for path, p in chances.items():
            start[path[0]] += p / total
            for t in range(len(x)):
                emits[x[t], path[t]] += p / total
                if t:
                    moves[path[t - 1], path[t]] += p / total
    assert sums.start == pytest.approx(start) and sums.moves == pytest.approx(moves) and sums.emits == pytest.approx(emits)


def test_base_scores_and_gain(make, odd):
    random.seed(9)
    first, second = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)]
    rows = [(1000 + i, " ".join(random.choice(first if i % 2 else second) + random.choice(("", "", "X")) for _ in range(60)), "s") for i in range(120)] + odd
    got = hmm.language_scores(make(rows), states=4, rounds=4, frequent=60, shared=8).collect()
    assert len(got) == len(rows)
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + [None]) for i, t, _ in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((i or -1, held(i), len(ws), sum(count[w] > 0 for w in ws), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in words)
    assert want == sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got)
    assert {r.train_tokens for r in got} == {n}
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert hmm.language_scores(make(odd).limit(0)).count() == 0


def test_training_raises_the_likelihood(make):
    random.seed(10)
    rows = [(i, " ".join(random.choice("abcdefgh" if i % 2 else "stuvwxyz") for _ in range(50)), "s") for i in range(60)]
    totals = [hmm.language_scores(make(rows), states=3, rounds=r, frequent=20, shared=4).where("not held_out").agg(F.sum("score")).first()[0] for r in (0, 1, 3)]
    assert totals == sorted(totals)


def test_registered_queries_cover_their_tables(spark):
    import duckdb

    count = lambda t: duckdb.sql(f"select count(*) from '{SF}/{t}.parquet'").fetchall()[0][0]
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 11))
    for name in ("op1_token_counts", "op3_page_text", "op9_decontamination"):
        assert queries.QUERIES[name](spark, SF).count() == count("pages" if name == "op3_page_text" else "documents")


def test_pipeline_stages_one_by_one(spark, tmp_path):
    """Each stage on all that the one before kept, compared with a plain version."""
    from test_groups import brute_groups, brute_removal, level

    small = str(tmp_path)
    for t in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        rows.coalesce(1).write.parquet(f"{small}/{t}.parquet")
    docs = queries.table(spark, small, "documents")
    kept, names = {}, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.shared.written(stage(spark, docs, small), name)
        after = {r.doc_id: r for r in docs.collect()}
        texts = sorted((i, r.text) for i, r in before.items())
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            assert set(after) <= set(before) and len(after) > 0.8 * len(before) and all(after[i] == before[i] for i in after)
        elif name == "near_duplicates":
            assert set(after) == {i for i, (_, _, keep) in brute_groups(texts, 80).items() if keep}
        elif name == "repeated_passages":
            want = brute_removal(texts)
            assert set(after) == set(before) and all((want[i][1] == 0) == (r.text == before[i].text) and r.n_chars == len(r.text) for i, r in after.items())
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            clean = {i for i, t in texts if not any(q in t for q in items)}
            assert set(after) <= clean and len(after) >= len(clean) - 3
        else:
            sizes = Counter()
            for i, r in before.items():
                sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            assert set(after) == set(before)
            for r in after.values():
                assert r.target == pytest.approx(level(sizes)[r.source]) and r.taken <= 2 * r.size
        kept[name] = len(after)
    assert kept["toxicity"] >= kept["near_duplicates"] == kept["repeated_passages"] >= kept["decontamination"] == kept["mixing"]
