"""Operator 3: main text of web pages by wrappers, inferred as union-free regular expressions.

Pages of a host are filled-in templates. From some pages of a host a wrapper is inferred: the token stream of one page is the
first wrapper, and every further page is aligned to it. Where texts differ a slot comes in; where tags differ, first a repeated
group is looked for (the mismatch starts another copy of what ended just before), then an optional one (the mismatch token
occurs further on, on one side). Every page is then matched with its host's wrapper: what is constant over the host's pages is
template, slots are content. Of the content, the page's own open elements set the asides and, if there is one, the article
apart. In repeated groups, and on a page that does not match, a text is template if it is on most of the host's pages.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, text_or_empty, written

# fixed values: element names of HTML and their roles
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|audio|video|title"
BLOCKS = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = set("nav header footer aside form menu button dialog head label".split())
BODY = ("article", "main")
#: Words in the class, id or role of an element that is not part of the article.
ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|nav\w*|newsletter|notice|popup|promo\w*"
    r"|related|replies|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")

TEXT, SLOT, OPTIONAL, REPEAT = "text", "slot", "?", "+"


def tokens(page: str) -> list[tuple[str, str]]:
    """(kind, value): a tag as ("<p>" or "</p>" with class and id, ""), text as (TEXT, its characters). Raw content is left out."""
    out, at = [], 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not (between := page[at : m.start()]).isspace():
            out.append((TEXT, between))
        elif m.start() > at and out and out[-1][0] == TEXT:
            out[-1] = (TEXT, out[-1][1] + " ")
        elif m.start() > at:
            out.append((TEXT, " "))
        at = m.end()
        if m["name"]:
            name = m["name"].lower()
            if m["end"]:
                out.append((f"</{name}>", ""))
            else:
                marks = " ".join(sorted({next(filter(None, g), "") for g in NAMES.findall(m["rest"])})) if m["rest"] else ""
                out.append((f"<{name}>" if not marks else f"<{name} {marks}>", ""))
    if at < len(page):
        out.append((TEXT, page[at:]))
    return out


def tag_name(tag: str) -> str:
    return tag.strip("</>").split(" ", 1)[0]


# --- inference: a wrapper is a list of [kind] for tags, [TEXT, value], [SLOT], [OPTIONAL, nodes], [REPEAT, nodes]


def first_wrapper(page: list[tuple[str, str]]) -> list:
    return [[TEXT, SPACE.sub(" ", v).strip()] if k == TEXT else [k] for k, v in page if k != TEXT or not v.isspace()]


def head(node: list) -> str:
    """The tag with which a node starts."""
    while node[0] in (OPTIONAL, REPEAT):
        node = node[1][0]
    return node[0]


def flat(nodes: list) -> Iterator[list]:
    for n in nodes:
        if n[0] in (OPTIONAL, REPEAT):
            yield from flat(n[1])
        else:
            yield n


def square(nodes: list, i: int, last: str) -> int:
    """End of the copy of a group that starts at i and ends with the tag `last`; 0 if there is none."""
    for k in range(i, len(nodes)):
        if nodes[k][0] == last:
            return k + 1
    return 0


def before(nodes: list, start: str) -> int:
    """Begin of the copy of a group that ends at the end of the nodes; -1 if there is none."""
    for k in range(len(nodes) - 1, -1, -1):
        if nodes[k][0] == start:
            return k
    return -1


def align(w: list, t: list, depth: int = 0) -> list:
    """The wrapper that covers what wrapper w covers and the nodes t of a page."""
    out, i, j = [], 0, 0
    while i < len(w) and j < len(t):
        a, b = w[i], t[j]
        if a[0] in (TEXT, SLOT) and b[0] in (TEXT, SLOT):
            out.append(a if a == b else [SLOT])
            i, j = i + 1, j + 1
        elif a[0] == SLOT or (a[0] == TEXT and b[0] != TEXT):
            out.append([SLOT])
            i += 1
        elif b[0] in (TEXT, SLOT):
            out.append([SLOT])
            j += 1
        elif a[0] == b[0] and a[0] not in (OPTIONAL, REPEAT):
            out.append(a)
            i, j = i + 1, j + 1
        elif a[0] == OPTIONAL:
            if head(a) == b[0] and (used := prefix(a[1], t, j)):
                out.append([OPTIONAL, align(a[1], t[j:used], depth + 1)])
                j = used
            else:
                out.append(a)
            i += 1
        elif a[0] == REPEAT:
            body, last = a[1], a[1][-1][0]
            while j < len(t) and t[j][0] == head(a) and (end := square(t, j, last)):
                body = align(body, t[j:end], depth + 1)
                j = end
            out.append([REPEAT, body])
            i += 1
        else:
            i, j = mismatch(w, t, i, j, out, depth)
    out += [[OPTIONAL, w[i:]]] if i < len(w) and depth == 0 else w[i:]
    if j < len(t):
        out.append([OPTIONAL, t[j:]])
    return out


def prefix(nodes: list, t: list, j: int) -> int:
    """Where the copy of an optional group that starts at t[j] ends; 0 if its last tag does not come."""
    last = next((n[0] for n in reversed(list(flat(nodes))) if n[0].startswith("<")), "")
    return square(t, j, last) if last else 0


def mismatch(w: list, t: list, i: int, j: int, out: list, depth: int) -> tuple[int, int]:
    """Resolve different tags at w[i] and t[j]: a repeated group, else an optional one. Returns where to go on."""
    last = next((n[0] for n in reversed(out) if n[0].startswith("<")), "") if out else ""
    if last.startswith("</") and depth < 4:
        for side, nodes, k in ((1, t, j), (0, w, i)):
            if (end := square(nodes, k, last)) and (begin := before(out, nodes[k][0])) >= 0:
                body = align(out[begin:], nodes[k:end], depth + 1)
                while end < len(nodes) and nodes[end][0] == nodes[k][0] and (more := square(nodes, end, last)):
                    body = align(body, nodes[end:more], depth + 1)
                    end = more
                out[begin:] = [[REPEAT, body]]
                return (i, end) if side else (end, j)
    ahead_t = next((k for k in range(j + 1, len(t)) if t[k][0] == w[i][0]), None)
    ahead_w = next((k for k in range(i + 1, len(w)) if w[k][0] == t[j][0]), None)
    if ahead_t is not None and (ahead_w is None or ahead_t - j <= ahead_w - i):
        out.append([OPTIONAL, t[j:ahead_t]])
        return i, ahead_t
    if ahead_w is not None:
        out.append([OPTIONAL, w[i:ahead_w]])
        return ahead_w, j
    out += [[OPTIONAL, [w[i]]], [OPTIONAL, [t[j]]]]
    return i + 1, j + 1


def infer(pages: list[str]) -> list:
    wrapper: list = []
    for k, page in enumerate(pages):
        nodes = first_wrapper(tokens(page))
        wrapper = align(wrapper, nodes) if k else nodes
    return wrapper


def key(text: str) -> str:
    return hashlib.blake2b(SPACE.sub(" ", text).strip().encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def constants(pages: list[str], least: int = 4) -> set[str]:
    """Keys of the texts on more than half of the different pages, and on `least`: fewer pages do not tell template from copies."""
    pages = sorted({p for p in pages if p.strip()})
    on = Counter(k for p in pages for k in {key(v) for kind, v in tokens(p) if kind == TEXT and not v.isspace()})
    return {k for k, n in on.items() if n >= least and 2 * n > len(pages)}


# --- extraction


class Place:
    """The open elements at a point of a page."""

    def __init__(self):
        self.open: list[tuple[str, bool]] = []

    def tag(self, tag: str) -> None:
        name = tag_name(tag)
        if tag.startswith("</"):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == name:
                    del self.open[k:]
                    break
        elif name not in VOID:
            if name in BLOCKS and self.open and self.open[-1][0] == "p":
                self.open.pop()  # a block ends a paragraph that was left open
            marks = tag.strip("<>").split(" ", 1)[1:]
            self.open.append((name, name in ASIDE or bool(marks and ASIDE_NAME.search(marks[0]))))

    def role(self) -> int:
        """2 in the article, 1 outside of it, 0 in what is never main text."""
        body = max((k for k, (name, _) in enumerate(self.open) if name in BODY), default=-1)
        if body >= 0:
            return 0 if any(aside and name not in ("html", "body") for name, aside in self.open) else 2
        return 0 if any(aside for _, aside in self.open) else 1


CONTENT, TEMPLATE, ASK = 0, 1, 2


def roles(wrapper: list, known: set[str] | None = None, repeated: bool = False) -> list:
    """The wrapper with each run of slots and texts as [SLOT, keys of its constant texts, what other texts are].

    Only texts in `known` count as constant, all without it. In a repeated group other texts are to be asked for in `known`.
    """
    out: list = []
    for n in wrapper:
        if n[0] in (OPTIONAL, REPEAT):
            out.append([n[0], roles(n[1], known, repeated or n[0] == REPEAT)])
        elif n[0] in (TEXT, SLOT):
            if not out or out[-1][0] != SLOT:
                out.append([SLOT, [], ASK if repeated else CONTENT])
            if n[0] == TEXT and (known is None or key(n[1]) in known):
                out[-1][1].append(key(n[1]))
        else:
            out.append(n)
    return out


def matched(nodes: list, page: list[tuple[str, str]], j: int, found: list[int]) -> int:
    """Match the nodes from page[j] on; CONTENT, TEMPLATE or ASK of the texts go to found. Where it ends, or -1."""
    for n in nodes:
        kind = n[0]
        if kind == SLOT:
            while j < len(page) and page[j][0] == TEXT:
                found.append(TEMPLATE if n[1] and key(page[j][1]) in n[1] else n[2])
                j += 1
            continue
        while j < len(page) and page[j][0] == TEXT and page[j][1].isspace():
            found.append(CONTENT)
            j += 1
        if kind == OPTIONAL:
            mark, size = j, len(found)
            if j < len(page) and (page[j][0] == head(n) or head(n) == SLOT):
                j = matched(n[1], page, j, found)
                if j < 0:
                    j = mark
                    del found[size:]
        elif kind == REPEAT:
            while j < len(page) and page[j][0] == head(n):
                mark, size = j, len(found)
                j = matched(n[1], page, j, found)
                if j < 0 or j == mark:
                    j = mark
                    del found[size:]
                    break
        elif j < len(page) and page[j][0] == kind:
            j += 1
        else:
            return -1
    return j


def by_markup(page: list[tuple[str, str]]) -> list[int]:
    """Roles of the texts of a page by its own open elements."""
    place, found = Place(), []
    for kind, _ in page:
        if kind == TEXT:
            found.append(place.role())
        else:
            place.tag(kind)
    return found


def main_text(page: str, wrapper: list | None, known: Collection[str] = ()) -> str:
    """Blocks of the article joined by line breaks; without an article those of all that is not set aside.

    Texts of the template are left out, unless the article has no other.
    """
    stream = tokens(page)
    found: list[int] = []
    if wrapper is None or matched(wrapper, stream, 0, found) != len(stream):
        found = [ASK] * sum(kind == TEXT for kind, _ in stream)
    marks, texts = by_markup(stream), [v for kind, v in stream if kind == TEXT]
    wanted = 2 if 2 in marks else 1
    own = [m if m != wanted or f == CONTENT or (f == ASK and key(t) not in known) else 0 for m, f, t in zip(marks, found, texts)]
    if any(m == wanted and not t.isspace() for m, t in zip(own, texts)):
        marks = own
    found = marks
    blocks, now, k = [], [], 0
    for kind, value in stream:
        if kind == TEXT:
            if found[k] == wanted:
                now.append(value)
            k += 1
        elif tag_name(kind) in BLOCKS and now:
            blocks.append(now)
            now = []
    blocks.append(now)
    # white space before and after decoding: a coded blank is one too
    texts = (SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    return "\n".join(t for t in texts if t)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
WRAPPER_BYTES = 16_000_000


def host_wrappers(pages: DataFrame, sample: int) -> DataFrame:
    """(host, wrapper): wrappers as JSON, each from at most `sample` pages of the host, chosen by a hash of the page."""
    order = Window.partitionBy("host").orderBy(F.xxhash64("page_id", "url"), "page_id")
    chosen = pages.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample).select("host", "k", "html")

    def build(host, group):
        import pandas as pd

        own = [p for p in group.sort_values("k").html if p.strip()]
        known = constants(own)
        return pd.DataFrame({"host": [host[0]], "wrapper": [json.dumps([roles(infer(own), known), sorted(known)])]})

    return chosen.groupBy("host").applyInPandas(build, "host string, wrapper string")


def decoded(coded: str) -> tuple[list, frozenset[str]]:
    nodes, known = json.loads(coded)
    return nodes, frozenset(known)


def extract_pages(pages: DataFrame, sample: int = 8) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of (page_id, url, html).

    A null html counts as empty and gives an empty text. Pages without a host (null or odd url) share one wrapper-less host
    and go by their own markup. Repeated rows are rows of their own; an empty table gives no rows. Wrappers are broadcast
    while all of them have at most WRAPPER_BYTES; beyond that they join the pages by host and a salt.
    """
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    rows = pages.select("page_id", "url", host.alias("host"), text_or_empty("html").alias("html"))
    wrappers = written(host_wrappers(rows.where("host != ''"), sample), "wrappers")
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0)).alias("b")).first().b
    known, none = None, (None, ())
    if size <= WRAPPER_BYTES:
        known = spark.sparkContext.broadcast({r.host: decoded(r.wrapper) for r in wrappers.collect()})
        rows = rows.withColumn("wrapper", F.lit(None).cast("string"))
    else:
        salts = 256
        salted = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, tuple] = {}
        for batch in slices(batches, "html"):
            hosts, coded = batch.column("host").to_pylist(), batch.column("wrapper").to_pylist()
            texts = []
            for h, c, page in zip(hosts, coded, batch.column("html").to_pylist()):
                if known is not None:
                    w = known.value.get(h, none)
                elif h in own:
                    w = own[h]
                else:
                    if len(own) > 1000:
                        own.clear()
                    w = own[h] = decoded(c) if c else none
                texts.append(main_text(page, *w))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    text = rows.select("page_id", "url", "host", "wrapper", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
    return text.withColumn("n_chars", F.length("text").cast("long"))
