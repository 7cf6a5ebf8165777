import html
import re

import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st

from casequarry.llm import main_text as m

SF = "/root/testdata/sf0.001"
WEIGHTS = m.weights_of({})
PARAGRAPH = "Some words of the article that go on for a while."


def article_of(page):
    """The page's own answer: blocks of its article."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_every_page_of_the_table(spark):
    table = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got = {r.page_id: r for r in m.op10_main_text(spark, SF).collect()}
    assert len(got) == len(table)
    wrong = [p["page_id"] for p in table if got[p["page_id"]].text != article_of(p["html"])]
    assert not wrong, (len(wrong), got[wrong[0]].text, article_of(next(p["html"] for p in table if p["page_id"] == wrong[0])))
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav>", ""),
        (f"<p>{PARAGRAPH}</p>", PARAGRAPH),
        (f"<header><p>Top {PARAGRAPH}</p></header><div><h1>T</h1><p>a &amp; b\n &lt;x&gt; {PARAGRAPH}</p></div><footer>f</footer>", f"T\n\na & b <x> {PARAGRAPH}"),
        (f"<p>{PARAGRAPH}</p><div class='ad box'>Buy {PARAGRAPH}</div><p>{PARAGRAPH}</p>", f"{PARAGRAPH}\n\n{PARAGRAPH}"),
        (f"<p>{PARAGRAPH}</p><aside>Side</aside><form><p>Name</p></form><p>{PARAGRAPH}</p><section id=comments><p>{PARAGRAPH} no</p></section>", f"{PARAGRAPH}\n\n{PARAGRAPH}"),
        (f"<script>var a='<p>{PARAGRAPH}</p>'</script><!-- <p>{PARAGRAPH} --><p>x {PARAGRAPH}<br>y<p>z", f"x {PARAGRAPH} y\n\nz"),
        (f"<p>{PARAGRAPH} <a href=x>in a link</a> on</p>", f"{PARAGRAPH} in a link on"),
        (f"<p>1 < 2 {PARAGRAPH} &am", f"1 < 2 {PARAGRAPH} &am"),
    ],
)
def test_small_pages(page, text):
    assert m.main_text(page, WEIGHTS) == text


@given(st.lists(st.sampled_from([-3.0, -1.0, -0.5, 0.5, 1.0, 2.0]), max_size=12))
def test_best_region_is_that_of_all_regions(scores):
    a, b = m.best_region(scores)
    assert sum(scores[a:b]) == max(sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1))


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", "<p>a b c</p>", "t", 3), (1, "u", "<p>a b c</p>", "t", 3), (None, None, None, None, None), (2, "v", "<p>" + "word " * 50_000, "", 0)]
    pages = spark.createDataFrame(rows, schema)
    got = [(r.page_id, r.n_chars) for r in m.extract(pages, m.learn_weights(pages)).collect()]
    assert sorted(got, key=str) == [(1, 5), (1, 5), (2, 249_999), (None, 0)]
    assert m.extract(pages.limit(0), m.learn_weights(pages.limit(0))).count() == 0
