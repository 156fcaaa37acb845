"""HTML extraction on generated and on odd pages."""

import html as H
import re

import pytest

from tablelens.llm.html_text import content_lines, extract_pages, main_text


def test_pages_of_the_test_tables(llm_spark):
    rows = llm_spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    out = {r["page_id"]: r for r in extract_pages(llm_spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert len(out) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        blocks = [re.sub(r"\s+", " ", H.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip()
                  for b in re.split(r"</?(?:p|h1)>", inner)]
        assert out[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b) and out[r["page_id"]]["url"] == r["url"]


LONG = "Some words of a paragraph that goes on for a while, with commas and a full stop at its very end."


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain &lt;text&gt; only", "plain <text> only"), ("<p>a<p>b<p></p>", "a\n\nb"),
    (f"<body><header><h1>Site</h1></header><nav><a href=x>x</a></nav><main><h1>T</h1><p>{LONG}</p><p>Short.</p>"
     f"<aside>side</aside><form><p>{LONG}</p></form></main><footer>f</footer>", f"T\n\n{LONG}\n\nShort."),
    (f"<article><header><h2>T</h2><p>by me</p></header><p>{LONG}</p><ul><li>one<li>two</ul><section class='comments'>"
     f"<p>{LONG}</p></section></article><div class='sidebar'><p>{LONG}</p></div>", f"T\n\n{LONG}\n\none\n\ntwo"),
    (f"<div id='top-menu'><a href=a>a</a> <a href=b>b</a></div><div class='body'><p>{LONG}</p><p>x</p></div>"
     f"<div><a href=a>one</a><a href=b>two</a><a href=c>three</a></div><div class='cookie-notice'>{LONG}</div>",
     f"{LONG}\n\nx"),
    (f"<article><div class='ad'>buy</div><p hidden>h</p><p style='display: none'>n</p><script>var a = '</p>';</script>"
     f"<style>p{{}}</style><p>{LONG} <b>bold</b><i>er</i><br>end</p><!-- c --></article>", f"{LONG} bolder end"),
    (f"<article class='post has-sidebar'><p>{LONG}</article><article class='comment'><p>{LONG}</p></article>", LONG),
    ("<article><table><tr><td>a<td>b</tr><tr><td>c</td></tr></table></article>", "a b\n\nc"),
    ("<article><p>unclosed <b>bold<p>next</article", "unclosed bold\n\nnext"),
    ("<article><p>a&nbsp;b&#233;&#x1F600; &bogus;</p></article>", "a bé\U0001f600 &bogus;"),
    ("<![bad <article><p>x</p>", "x"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


LINKS = "".join(f"<li><a href={k}>Another page {k}</a></li>" for k in range(6))
BODY = f"<h2>T</h2><div><p>{LONG}</p><p>Short.</p></div><div><p>{LONG} 2</p></div><div><div><p>{LONG} 3</p></div></div>"
BODY_TEXT = f"T\n\n{LONG}\n\nShort.\n\n{LONG} 2\n\n{LONG} 3"


@pytest.mark.parametrize("page,text", [
    # no article, no telling names: containers by their text
    (f"<body><div><div><a href=h>Home</a> <a href=a>About us</a></div></div><div class=x1><div class=x2>{BODY}</div></div>"
     f"<div><ul>{LINKS}</ul></div>{'<div><b>Site</b> <i>of</i> <span>2020</span></div>' * 20}</body>", BODY_TEXT),
    # a list of links inside the article, without a telling name
    (f"<article>{BODY}<div class=x3><ul>{LINKS}</ul></div></article>", BODY_TEXT),
    # misleading names: of what the article stands in, and of the article itself
    (f"<body><div class='header-wrap'><article>{BODY}</article></div><div><p>{LONG}</p></div></body>", BODY_TEXT),
    (f"<body><div><a href=h>Home</a></div><div id='social-notice'>{BODY}<div class='share'><p>Tell it</p></div></div></body>",
     BODY_TEXT),
    # true names: comments longer than the article, a page with nothing but a notice
    (f"<main>{BODY}<div class='comments'>{''.join(f'<p>{LONG} {k}</p>' for k in range(9))}</div></main>", BODY_TEXT),
    (f"<div class='comments'><article><p>{LONG}</p></article><article><p>{LONG}</p></article></div><article>{BODY}</article>",
     BODY_TEXT),
    (f"<body><div class='cookie-notice'><p>{LONG}</p></div></body>", ""),
])
def test_regions_are_chosen_by_the_clustering(page, text, monkeypatch):
    import numpy as np
    from tablelens.llm import html_text
    assert main_text(page) == text
    if "x1" in page or "x3" in page:  # without it these pages come out otherwise
        monkeypatch.setattr(html_text, "content_lines", lambda r: np.ones(len(r), dtype=bool))
        assert main_text(page) != text
    if "x1" in page or "social" in page:
        monkeypatch.setattr(html_text, "content_lines", lambda r: np.zeros(len(r), dtype=bool))
        assert main_text(page) != text


def test_deep_markup():
    page = "<div class='menu'>" * 5000 + "<div>" * 5000 + f"<p>{LONG}</p>" * 3 + "</div>" * 10_000
    assert main_text(page) == "\n\n".join([LONG] * 3)


def test_long_page_keeps_everything():
    blocks = [f"block {k} " + "w " * (k % 40) for k in range(5000)]
    page = "<html><body><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article></body></html>"
    assert main_text(page) == "\n\n".join(b.strip() for b in blocks)


def test_threshold():
    import numpy as np
    up = content_lines(np.array([1, 1, 1, 90, 95, 80, 1, 1, 1, 1], dtype=float))
    assert up[3:6].all() and not up[0] and not up[-2:].any()
    assert content_lines(np.zeros(0)).shape == (0,) and content_lines(np.array([5.0])).all()


def test_tables(llm_spark):
    df = llm_spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, "<p>x")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in extract_pages(df).collect()) == [(1, ""), (1, ""), (2, "x")]
    assert extract_pages(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        extract_pages(df, text_col="url")
