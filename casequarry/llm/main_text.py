"""Main text of web pages: the contiguous region of highest score.

A page is read as a line of tokens: tags, and runs of words. Words score positive and tags negative, by weights learnt
from labelled pages, so the best region is the maximum-scoring contiguous run, found in one pass. Words in places that
labelled pages show to be outside the content (menus, footers, adverts, links ...) score negative as well.

Labelled pages are those with exactly one ``<article>`` (or ``<main>``): its tokens are content, others are not. A
weight is the log odds of a token's kind inside against outside, from a sample of at most ``SAMPLE_PAGES`` such pages
(those with the smallest hash of ``page_id``). Kinds of token: the tag's name, and for words the innermost element
around them that tells what they are. Only counts by kind reach the driver. Without labelled pages the prior counts
decide. Where a page holds no region of positive score the text is empty.

The text is that region without what lies in menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments inside it, as blocks: references decoded, white space one space, trimmed, joined by two line ends.

Cases: null or empty html gives an empty text; null ``page_id`` and ``url`` are passed on; repeated rows stay; an empty
table gives no rows; other columns are not read. Of equal scores the region that ends first wins.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casequarry.llm import store

#: Pages that the weights are fitted on, at most.
SAMPLE_PAGES = 2000

# Names of elements of HTML.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
OUTSIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head"} | RAW
CONTENT = {"article", "main"}
#: Words of class, id or role that tell an element which is not content.
HINTS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert newsletter subscribe signup login menu menubar nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets related "
    "recommended share sharing social comment comments commentlist respond reply replies disqus footer header masthead topbar popup "
    "modal overlay pagination pager search skip copyright complementary contentinfo".split()
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<[!?/][^>]*>""", re.S)
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Prior counts (inside, outside) of kinds of token, before any labelled page is seen.
PRIOR = {"word": (50.0, 5.0), "link": (2.0, 20.0), "outside": (0.1, 50.0), "tag": (1.0, 20.0), "prose": (10.0, 11.0)}
#: Tags that running text is made of; before any page is seen they cost little.
PROSE = INLINE | set("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption ul ol li dl dt dd br hr".split())
#: Bounds of the weights. Tags of running text must not outweigh a short block, nor an advert inside the content the
#: content behind it.
LEAST_WORD, TAG_RANGE, LINK_RANGE, OUTSIDE_RANGE = 0.5, (-4.0, -0.01), (-1.0, 0.5), (-0.2, -0.02)


def hinted(attributes: str) -> bool:
    if "=" not in attributes:
        return False
    return any(w in HINTS for m in _NAMED.finditer(attributes) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()))


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, tag or text, place, content): place is the innermost telling element, content is the label's answer."""
    stack: list[tuple[str, str]] = []  # open elements with the place of what they hold
    inside = 0
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        begin = m.start() if m else end
        place = stack[-1][1] if stack else "word"
        if begin > at:
            yield "text", page[at:begin], place, inside > 0 and place != "outside"
        if not m:
            return
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                inside -= sum(x[0] in CONTENT for x in stack[depth:])
                del stack[depth:]
        elif name not in VOID and not m[3].endswith("/"):
            if name == "p":  # an open paragraph ends here
                if stack and stack[-1][0] == "p":
                    stack.pop()
                place = stack[-1][1] if stack else "word"
            if place == "outside" or (name in OUTSIDE or (name not in CONTENT and name != "body" and hinted(m[3]))):
                own = "outside"
            else:
                own = "link" if name == "a" or place == "link" else "word"
            stack.append((name, own))
        yield "tag", ("/" if closing else "") + name, place, inside > 0 and name not in CONTENT and place != "outside"
        if not closing and name in CONTENT:
            inside += 1
        if not closing and name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.start() if close else end


def kind_counts(page: str) -> Counter:
    """Counts by (kind, inside) of a labelled page; nothing for others."""
    out: Counter = Counter()
    opened = 0
    for kind, what, place, content in tokens(page):
        if kind == "tag":
            opened += what in CONTENT
            out[f"<{what.lstrip('/')[:20]}>", content] += 1
        elif n := len(what.split()):
            out[place, content] += n
    return out if opened == 1 else Counter()


def _count_kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found: Counter = Counter()
        for page in b["html"]:
            found.update(kind_counts(page or ""))
        yield pd.DataFrame([(k, inside, n) for (k, inside), n in found.items()], columns=["kind", "inside", "n"])


def learn_weights(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weight of each kind of token; what reaches the driver is bounded by the sample."""
    store.small_batches(pages.sparkSession)
    lower = F.lower("html")
    labelled = pages.where(lower.contains("<article") | lower.contains("<main"))
    key = F.xxhash64("page_id", "html")
    share = min(1.0, 1.5 * sample_pages / max(1, labelled.count()))  # no task has to hand on many more than are needed
    drawn = labelled.select("page_id", "html").where(F.pmod(key, F.lit(1 << 20)) <= share * (1 << 20))
    sample = drawn.orderBy(F.pmod(key, F.lit(1 << 20)), key, "page_id").limit(sample_pages)
    counts = sample.select("html").mapInPandas(_count_kinds, "kind string, inside boolean, n long")
    rows = counts.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r.kind, r.inside): r.n for r in rows})


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    total = {side: 1.0 + sum(n for (_, inside), n in counts.items() if inside == side) for side in (True, False)}

    def odds(kind: str) -> float:
        prior = PRIOR[kind if kind[0] != "<" else "prose" if kind[1:-1] in PROSE else "tag"]
        rate = [(counts.get((kind, side), 0) + prior[not side]) / (total[side] + 100.0) for side in (True, False)]
        return math.log(rate[0] / rate[1])

    tags = {k for k, _ in counts if k[0] == "<"} | {f"<{name}>" for name in PROSE} | {"<>"}
    within = lambda kind, bounds: min(max(odds(kind), bounds[0]), bounds[1])
    out = {k: within(k, TAG_RANGE) for k in tags}
    out["word"] = max(LEAST_WORD, odds("word"))
    out["link"] = within("link", LINK_RANGE)
    out["outside"] = within("outside", OUTSIDE_RANGE)
    return out


def scored_line(page: str, weights: dict[str, float]) -> list[tuple[float, str]]:
    """Score and text of each block and each tag between blocks, in page order; tags have no text.

    Words and inline tags up to the next block tag are one block, so a region never begins or ends inside a sentence.
    """
    line, score, parts = [], 0.0, []
    for kind, what, place, _ in [*tokens(page), ("tag", "p", "", False)]:
        name = what.lstrip("/")[:20] if kind == "tag" else ""
        if kind == "text":
            score += weights[place] * len(what.split())
            if place != "outside":
                parts.append(what)
        elif name in INLINE:
            score += weights.get(f"<{name}>", weights["<>"])
            parts.append(" " if what == "br" else "")
        else:
            if parts or score:
                line.append((score, " ".join(entities.unescape("".join(parts)).split())))
            line.append((weights.get(f"<{name}>", weights["<>"]), ""))
            score, parts = 0.0, []
    return line


def best_region(scores: list[float]) -> tuple[int, int]:
    """From where to where the sum is largest: one pass keeps the best run that ends here, and the best of all."""
    best = run = 0.0
    begin = best_from = best_to = 0
    for k, score in enumerate(scores):
        run += score
        if run <= 0:
            run, begin = 0.0, k + 1
        elif run > best:
            best, best_from, best_to = run, begin, k + 1
    return best_from, best_to


def main_text(page: str | None, weights: dict[str, float]) -> str:
    line = scored_line(page or "", weights)
    begin, end = best_region([score for score, _ in line])
    return "\n\n".join(text for _, text in line[begin:end] if text)


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    store.small_batches(pages.sparkSession)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [main_text(p, weights) for p in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": found, "n_chars": [len(t) for t in found]})

    columns = [F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string")]
    out = pages.select(*columns).mapInPandas(texts, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = store.table(spark, sf_dir, "pages")
    return extract(pages, learn_weights(pages))


QUERIES = {"op10_main_text": op10_main_text}
ORACLES: dict[str, str] = {}
