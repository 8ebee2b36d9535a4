import html as entities
import random
import time
from pathlib import Path

import pytest

import pyarrow.parquet as pq

from stratascan.llm import html_text
from stratascan.llm.html_text import article_text, extract

P1 = "The first paragraph has some length, and it has marks: commas, stops and more of them. It goes on."
P2 = "Second paragraph; shorter, but still prose that reads as an article does, with a point."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just  text\n here", "just text here"),
        (f"<html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>x';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy now, buy cheap, buy here today.</div><article><h1>Head</h1><p>{P1}</p><p>Is.</p><p>{P2}</p></article><footer>&copy; all rights, 2020.</footer></body></html>", f"Head\n\n{P1}\n\nIs.\n\n{P2}"),
        (f"<body><div id=content><p>{P1}<p>{P2}<br>tail &amp; more</div><div class='comments'><p>{P1}</p></div>", f"{P1}\n\n{P2} tail & more"),
        (f"<p><b>{P1}<br><p>{P2}</p>", f"{P1}\n\n{P2}"),
        ("<nav>only a menu</nav><form>and a form</form>", ""),
        (f"<article><p>{P1}</p><!-- <p>hidden</p> --><aside>{P2}</aside><ul><li>one<li>two</ul><form>x<input></form><div role=alert>{P2}</div></article>", f"{P1}\n\none\n\ntwo"),
        (f"<article><p>{P1} <a href=x>linked words</a> on.</p><script>unclosed", f"{P1} linked words on."),
        (f"<article><p>{P1}</p><!-- unclosed <p>hidden</p>", P1),
        (f"<html><head><title>T</title><body><div hidden>a</div><p>{P1}<br/>x<svg><text>t</text></svg></p>", f"{P1} x"),
        (f"<article><p>{P1}</ p></><!-->x<table><tr><td>a<td>b<tr><td>c</table></article>", f"{P1}x\n\na\n\nb\n\nc"),
        (f"<body><header><p>{P2}</p></header><main><header><h1>Title</h1></header><p>{P1}<a href=\"unclosed>", f"Title\n\n{P1}"),
        (f"<article><p>a &lt;b&gt; &#233;&nbsp;x {P1}</p></article>", f"a <b> é x {P1}"),
    ],
)
def test_cases(page, want):
    assert article_text(page) == want


def test_generated_pages_against_their_parts():
    """Pages made of known parts: the article's blocks come back, nothing else does."""
    rng = random.Random(3)
    words = "alpha beta, gamma delta. epsilon; zeta eta: theta & iota < kappa".split(" ")
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for _ in range(200):
        blocks = [prose(rng.randint(1, 120)) for _ in range(rng.randint(2, 9))] + [prose(80)]
        wrap = rng.choice(["article", "main", "div class='post-body'"])
        body = "".join(f"<p>{entities.escape(b).replace(' ', rng.choice([' ', chr(10) + '  ']))}</p>" for b in blocks)
        noise = [f"<nav><ul>{'<li><a href=/>menu</a></li>' * 5}</ul></nav>", f"<header><p>{entities.escape(prose(9))}</p></header>", f"<div class='{rng.choice(['ad', 'sidebar', 'cookie-notice', 'comments'])}'>{entities.escape(prose(30))}</div>"]
        rng.shuffle(noise)
        page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{noise[0]}{noise[1]}<{wrap}>{body}</{wrap.split()[0]}>{noise[2]}<footer>{entities.escape(prose(12))}</footer></body></html>"
        assert article_text(page) == "\n\n".join(" ".join(b.split()) for b in blocks)


@pytest.mark.parametrize("part", ["<div class='x'>", "<p>", "<!--", "<a href='", "<", "</p", "<a ", "<script>", "<li>", "<td><tr>", '<a x="', "</div>", "&", "<b c=d "])
def test_odd_pages_take_time_in_proportion(part):
    began = time.perf_counter()
    article_text(part * 100_000 + P1)
    assert time.perf_counter() - began < 20


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", f"<p>{P1}", "t"), (1, "u", f"<p>{P1}", "t"), (None, None, None, None), (3, "v", "<div>" * 3000 + P2, "t")], "page_id long, url string, html string, text string")
    got = sorted(extract(pages).collect(), key=str)
    assert sorted((r.page_id, r.text, r.n_chars) for r in got if r.page_id) == [(1, P1, len(P1)), (1, P1, len(P1)), (3, P2, len(P2))]
    assert [(r.url, r.text, r.n_chars) for r in got if r.page_id is None] == [(None, "", 0)]
    assert extract(pages.filter("false")).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div id=content><section><p>{P1 * 5}</p></section><section><p>{P2 * 2}</p></section></div></body>",
        f"<body><article><p>{P1 * 5}</p></article><article><p>{P2 * 2}</p></article></body>",
        f"<body><div class=body><blockquote><p>{P1 * 5}</p></blockquote><div class=ad>Buy.</div><p>{P2 * 2}</p></div></body>",
        *(f"<body><div {names}><p>{P1 * 5}</p><p>{P2 * 2}</p></div></body>" for names in ("class='content no-sidebar'", "class='content-area has-sidebar'", "class='post no-comments'", "class='entry menu-open'", "id=discussion")),
        f"<body><form><div class='sidebar-left'>{P2}</div><div><p>{P1 * 5}</p><p>{P2 * 2}</p></div></form></body>",
    ],
)
def test_no_part_of_the_article_is_lost(page):
    assert article_text(page) == f"{P1 * 5}\n\n{P2 * 2}"


BODY = f"<p>{P1 * 3}</p><p>{P2 * 2}</p>"
BODY_TEXT = f"{P1 * 3}\n\n{P2 * 2}"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div id="comment-policy-article">{BODY}</div></body>',
        f'<body><div class="comments">{BODY}</div></body>',  # nothing else reads as prose
        f'<body><main><section class="related-work">{BODY}</section></main></body>',
        f'<article>{BODY}<span class="cookie-notice">We use cookies, and more of them.</span></article>',
        f'<article><cookie-banner>We use cookies, <b>and</b> more of them.</cookie-banner>{BODY}</article>',
        f'<article>{BODY}<span hidden>Not to be seen, at all.</span><span style="color:red;display: none">Nor this.</span></article>',
        f'<article>{BODY}<div class="comments"><article class="comment"><p>{P1 * 4}</p></article></div></article>',
        f'<body><div class="content">{BODY}</div><div class="links"><a href=x>One thing, here.</a> <a href=y>Another; there.</a></div></body>',
        f'<body><div class="content">{BODY}</div><div class="x1">Tiny bit</div><div class="x2">Home</div><p class=z>More</p></body>',
        f'<body><div class="teasers"><article>Short one.</article></div><div class="content">{BODY}</div></body>',
    ],
)
def test_what_decides(page):
    assert article_text(page) == BODY_TEXT


def test_elements_within_lines():
    assert article_text(f"<article><p>{P1} Before <span hidden>not <span>seen</span> here</span> after, <i class=x>in</i> one line.</p></article>") == f"{P1} Before after, in one line."
    assert article_text(f"<article><p>{P1} a <x-term>b</x-term> c.</p></article>") == f"{P1} a b c."
    assert article_text(f"<article><p>{P1}<span hidden><div>x</span>y</div>z</p></article>").startswith(P1)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_the_ratios_choose_the_text(monkeypatch):
    """With other scores in place of the ratios, other text comes out: on made pages, and on those of the tables."""
    pages = [
        f'<body><div class="content">{BODY}</div><div class="links"><a href=x>One thing, here.</a> <a href=y>Another; there.</a></div><div class="x2">Home</div></body>',
        f'<body><div class="a"><p>{P1 * 3}</p></div><div class="b">Login</div><div class="c">Read more</div></body>',
    ]
    table = Path("/root/testdata/sf0.001/pages.parquet")
    real = [r["html"].replace("<article>", "<div class=body>").replace("</article>", "</div>").replace('class="ad"', 'class="x"') for r in pq.read_table(table).to_pylist()]
    made, want = [article_text(p) for p in pages], [article_text(p) for p in real]
    assert made == [BODY_TEXT, P1 * 3]
    own = html_text.ratios
    constant = lambda blocks, tree: dict.fromkeys(own(blocks, tree), 1.0)
    inverse = lambda blocks, tree: {p: 1 / (1e-9 + x) for p, x in own(blocks, tree).items()}
    assert sum(w == article_text(r["html"]) for w, r in zip(want, pq.read_table(table).to_pylist())) >= 0.8 * len(real)  # without names and article, by the ratios alone
    for other in (constant, inverse):
        monkeypatch.setattr(html_text, "ratios", other)
        assert all(article_text(p) != m for p, m in zip(pages, made))
        assert sum(article_text(p) != w for p, w in zip(real, want)) >= 0.8 * len(real)
