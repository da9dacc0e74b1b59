"""Token counts, page text, decontamination."""

import random
import re

import pytest

from barflow.llm import words
from barflow.llm.decontamination import find_benchmark, myers, normal, pieces
from barflow.llm.token_count import counted, encoder, token_counts
from barflow.llm.wrappers import extract_pages, infer, main_text, matched, roles, tokens

np = pytest.importorskip("numpy")


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_counts_are_the_library_s(spark, make, odd, model):
    random.seed(1)
    odd_texts = ["".join(random.choice("ab the\n\t ▁é€😀\x00<s></s>ﬁ\r") for _ in range(random.randint(0, 60))) for _ in range(300)]
    rows = odd + [(100 + i, t, "a") for i, t in enumerate(odd_texts)]
    got = sorted((tuple(r) for r in token_counts(make(rows), model, limit=20).collect()), key=str)
    sizes = [(i, len((t or "").encode()), len(encoder(model).encode(t or ""))) for i, t, _ in rows]
    assert got == sorted(((i, b, n, n > 20) for i, b, n in sizes), key=str)
    assert token_counts(make([]).limit(0), model).count() == 0


def test_counts_do_not_depend_on_the_table(model):
    text = "the quick  brown\nfox <s> the end"
    full = counted(text, model, {})
    assert counted(text, model, {" the": 1, "\n": 1}) == full == len(encoder(model).encode(text))


def test_words_and_hashes():
    texts = [b"The of  a\tb", b"", b"  ", b"X" * 5000 + b" y", b"of the"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    start, end, before = words.spans(data, at)
    found = [bytes(data[a:b]) for a, b in zip(start, end)]
    assert found == [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    assert list(before) == [0, 4, 4, 4, 6, 8]
    h = words.hashes(data, start, end)
    assert len(set(h.tolist())) == len(set(found)) and h[1] == h[6]


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav><div class="ad">buy</div><article><h1>Head {n}</h1>'
    "<p>A&amp;B  &nbsp; c\n d {n}</p>{more}<script>var t='</p>';</script><section class='comments'><p>reader {n}</p></section></article><footer>&copy; x</footer></body></html>"
)


def page(n, more=""):
    return PAGE.format(n=n, more=more, menu="".join(f"<li><a href='/{k}'>m{k}</a></li>" for k in range(n % 3 + 2)))


def test_wrapper_has_slots_and_groups():
    found = infer([page(k, "<p>more <b>bold</b></p>" * (k % 3)) for k in range(6)])
    kinds = {n[0] for n in found}
    assert "+" in kinds and "slot" in kinds
    stream = tokens(page(20, "<p>x <b>y</b></p>"))
    assert matched(roles(found), stream, 0, []) == len(stream)


def test_main_text_with_and_without_wrapper():
    w = roles(infer([page(k) for k in range(4)]))
    for html in (page(9), page(9).replace("</body></html>", ""), page(9) + "<!-- end"):
        assert main_text(html, w) == main_text(html, None) == "Head 9\nA&B c d 9"
    assert main_text("", w) == "" and main_text("plain & simple", None) == "plain & simple"


def test_pages_with_odd_rows(spark):
    host = "https://a.example/x"
    rows = [(k, host, page(k)) for k in range(12)] + [(50, None, page(5)), (51, "no url", "<p>one<p>two"), (52, host, None), (52, host, None), (None, host, ""), (53, "http://b.example", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host long, wrapper string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract_pages(pages).collect()}
    assert got[(3, host)] == ("Head 3\nA&B c d 3", 16) and got[(50, None)][0] == "Head 5\nA&B c d 5"
    assert got[(51, "no url")] == ("one\ntwo", 7) and got[(52, host)] == ("", 0) and got[(53, "http://b.example")][0] == "deep"
    assert extract_pages(pages).count() == len(rows) and extract_pages(pages.limit(0)).count() == 0


def test_constant_texts_without_a_name_are_template(spark):
    def plain(n):
        return f"<html><body><div id='x1'>The Site</div><table><tr><td>Home<td>News</table><div id='x2'><h2>Title {n}</h2>{''.join(f'<p>line {n} {k}</p>' for k in range(n % 4 + 1))}<p>All rights</p></div></body></html>"

    host, two = "http://c.example/", "http://two.example/"
    rows = [(k, host, plain(k)) for k in range(20)] + [(30, host, plain(1).replace("<table>", "<ul><li>more</ul><table>")), (40, two, plain(1)), (41, two, plain(1))]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(20):
        assert got[n] == "\n".join([f"Title {n}", *(f"line {n} {k}" for k in range(n % 4 + 1))])
    assert got[30] == "more\nTitle 1\nline 1 0\nline 1 1"
    assert got[40] == got[41] == "The Site\nHome\nNews\nTitle 1\nline 1 0\nline 1 1\nAll rights"  # one text only: nothing tells its template
    same = roles(infer([plain(1), plain(1)]))
    assert main_text(plain(1), same) == got[40]


def distance_in(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    random.seed(3)
    for _ in range(200):
        p = "".join(random.choice("ab c") for _ in range(random.randint(1, 80)))
        t = "".join(random.choice("ab c") for _ in range(random.randint(1, 90)))
        best = distance_in(p, t)
        got = myers(p, t, len(p))
        assert best == len(p) or (got and got[0] == best)
        assert myers(p, t, best - 1) is None


def test_every_passage_within_the_edits_is_found(spark, make, odd):
    random.seed(5)
    items = [" ".join("".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(30)) for _ in range(12)]
    rows, wanted = list(odd), set()
    for k in range(60):
        item = k % len(items)
        text, edits = list(items[item]), int(len(items[item]) * 0.06)
        for _ in range(k % (edits + 1)):
            at = random.randrange(len(text))
            text[at : at + 1] = random.choice(([], [random.choice("xyz")], [text[at], "q"]))
        passage = "".join(text).upper() if k % 5 == 0 else "".join(text).replace(" ", "\n ", 3)
        rows.append((1000 + k, "foo bar " * (k % 7) + passage + " tail words" * (k % 3), "a"))
        if distance_in(normal(items[item]), normal(rows[-1][1])) <= edits:
            wanted.add((1000 + k, item))
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(99, None, 1), (98, "", 1), (None, "null id", 1), (97, items[0], 1)], "item_id long, text string, hits int")
    found = find_benchmark(make(rows), benchmark).collect()
    got = {(r.doc_id, h.item_id) for r in found for h in r.hits}
    assert wanted | {(d, 97) for d, i in wanted if i == 0} == got and len(found) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in found:
        for h in r.hits:
            assert distance_in(normal(items[h.item_id % 97]), normal(texts[r.doc_id][h.start : h.end])) <= h.edits
    assert find_benchmark(make(rows), benchmark.limit(0)).where("size(hits) > 0").count() == 0


def test_pieces_cover_the_item():
    assert "".join(p for _, p in pieces("abcdefghij", 3)) == "abcdefghij" and len(pieces("abcdefghij", 3)) == 4
