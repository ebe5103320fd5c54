"""Pages that a tag-soup reader may lose text of, and hand-made pages."""

from __future__ import annotations

import os
import time

import pytest

from sessionloom.llm import html

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
LONG = "A sentence of running text, with commas, that goes on for a while. " * 4


@pytest.fixture(scope="module")
def model():
    import pyarrow.parquet as pq

    return html.Extractor(sorted(pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()))


def text(model, page):
    return model.texts([page])[0]


@pytest.mark.parametrize("drawing", ["<svg/>", '<svg width="3"/>', "<svg><path d='M0'/></svg>", "<svg><use href=#x /><title>icon</title></svg>", "<svg><g><path d='M0'/>", "<svg><foreignObject><div>x</div></foreignObject></svg>", "<math/>"])
def test_drawings_end(model, drawing):
    got = text(model, f"<html><body><article><h1>Title of it</h1><p>{LONG}</p>{drawing}<p>{LONG}</p><p>The very last words.</p></article></body></html>")
    assert got.count("A sentence of running text") == 8 and got.endswith("The very last words.") and "icon" not in got


@pytest.mark.parametrize("open_tag", ["<button>", "<select><option>one<option>two", "<button type=submit>"])
def test_an_unclosed_button_or_list_swallows_nothing(model, open_tag):
    got = text(model, f"<article><p>{LONG}</p><div>{open_tag}</div><p>{LONG}</p></article>")
    assert got.count("A sentence of running text") == 8


def test_closed_buttons_and_lists_are_cut(model):
    got = text(model, f"<article><p>{LONG}<button>Buy now</button> and on</p><p><select><option>one</option></select>{LONG}</p></article>")
    assert "Buy" not in got and "one" not in got.replace("on for", "") and got.count("A sentence") == 8


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div>short</div>", "short"), ("<div>Only one short line here</div>", "Only one short line here"), ("<script>x</script>hello", "hello"),
        ("<ul><li>one</li><li>two</li></ul>", "one two"), ("<h1>Only a title</h1>", "Only a title"), ("<p>a</p><p>b</p>", "a b"), ("plain &amp; <b>bold</b>", "plain & bold"),
        ("<ul><li><a href=x>one</a></li></ul>", ""), ("<nav>menu</nav>", ""), ("<nav>menu</nav><div>said</div><footer>end</footer>", "said"), ("", ""), (None, ""), ("<!-- x", ""),
    ],
)
def test_short_pages_keep_what_is_visible(model, page, want):
    assert text(model, page) == want


def test_an_article_with_comments_forms_and_adverts_inside(model):
    page = f"""<html><head><title>t</title><style>p {{}}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>Sections</a></li></ul></nav>
    <main><article><h1>The headline</h1><p>{LONG}</p><div class="advert"><p>Buy our things today, they are cheap.</p></div><p>It&rsquo;s <em>more</em> of it.</p>
    <form><label>Mail</label><input name=x><p>Sign up for our letters, it is free.</p></form><p>{LONG}</p>
    <section class="comments"><p>First! I liked this very much, thank you for writing it.</p></section></article><aside><p>Related things to read, many of them.</p></aside></main>
    <footer><p>Copyright of someone, all rights reserved.</p></footer></body></html>"""
    plain = " ".join(LONG.split())
    assert text(model, page) == f"The headline {plain} It’s more of it. {plain}"


def test_deep_pages_take_linear_time():
    page = html.Page("<div>" * 40_000 + LONG)
    began = time.process_time()
    assert html.structural_labels(page, set())[-1] == 1
    assert time.process_time() - began < 1.5


def test_pages_with_and_without_names(model):
    """With names every page is exact; the README has the figures of pages without any."""
    import re

    import pyarrow.parquet as pq

    pages = pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()
    want = []
    for page in map(html.Page, pages):
        labels = html.named_labels(page)
        want.append(page.text([x == 1 for x in labels]))
    bare = [re.sub(r"<(/?)(article|main|nav|header|footer|aside|section|form)\b", r"<\1div", re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", x, flags=re.I), flags=re.I) for x in pages]
    assert model.texts(pages) == want
    assert sum(a == b for a, b in zip(model.texts(bare), want)) >= 0.98 * len(pages)


def test_training_rows_do_not_depend_on_the_order_of_repeated_ids(spark):
    rows = [(k % 3, f"<article><p>{LONG}</p></article><div>{k}</div>") for k in range(40)]
    kinds = "page_id long, html string"
    a, b = (html.fit(spark.createDataFrame(r, kinds).repartition(n), sample=5) for r, n in ((rows, 1), (rows[::-1], 7)))
    assert a.odds == b.odds
