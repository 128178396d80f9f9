"""Article extraction from pages with a known article."""

import html as escape
import random
import re

import pytest

from corpuskit.llm import html_text as H
from corpuskit.llm.queries import QUERIES

WORDS = "the report said that many people in town were glad about a new library which opens in spring".split()


def paragraph(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 80))).capitalize() + "."


def page(rng, frame):
    title, body = paragraph(rng), [paragraph(rng) for _ in range(rng.randrange(1, 9))]
    marked = "".join(f"<p>{p.replace('town', '<em>town</em>', 1)} &amp; more{rng.choice(['</p>', ''])}" for p in body)
    inner = f"<h1>{title}</h1>{marked}"
    text = " ".join([title, *[p + " & more" for p in body]])
    links = "".join(f'<li><a href="/{w}">{w}</a>' for w in WORDS[:8])
    return frame.format(inner=inner, links=links, noise=paragraph(rng)), text


FRAMES = [
    '<html><head><title>x</title><script>var a="<p>no</p>";</script></head><body><nav><ul>{links}</ul></nav><div class="ad">{noise}</div><article>{inner}</article><footer>&copy; {noise}</footer></body></html>',
    '<body><header>{noise}<ul>{links}</ul></header><div id="page"><div class="post-body">{inner}</div><aside>{noise}</aside></div><div id="comments"><p>{noise}</p><p>{noise}</p><p>{noise}</p></div>',
    '<div class="layout with-sidebar"><div class="cookieNotice">{noise}</div><main><section>{inner}</section><form><label>{noise}</label><input value=1></form></main><div class="sidebar">{links}</div></div>',
    '<body><table><tr><td><ul>{links}</ul><td><div>{inner}</div></table><p style="display: none">{noise}</p><style>p</style><!-- {noise} --></body>',
    '<body><article>{inner}<footer>{noise}</footer></article><section class="comments"><article class="comment"><p>{noise}</p><p>{noise}</p><p>{noise}</p></article></section></body>',
]


@pytest.mark.parametrize("frame", FRAMES)
def test_known_articles(frame):
    rng = random.Random(len(frame))
    for _ in range(60):
        source, text = page(rng, frame)
        assert H.main_text(source) == text, source


WRAPPED = [
    '<body><form id="aspnetForm"><input type=hidden value=1><nav>{links}</nav><label>{noise}</label><article>{inner}</article><button>go</button></form></body>',
    '<body><form><select><option>no</select><ul>{links}</ul><div>{inner}</div></form></body>',
    '<body><nav><ul>{links}</ul></nav><aside><article>{inner}</article></aside><footer>{noise}</footer></body>',
    '<body><main><dialog open><article>{inner}</article></dialog></main><aside><p>{noise}</p></aside></body>',
    '<body><article>{inner}</article><aside><article>{noise}</article></aside></body>',
    '<body><article><div class="page-header">{inner}</div><div class="share"><ul>{links}</ul></div><div class="widget">{noise}<input></div></article></body>',
]


@pytest.mark.parametrize("frame", WRAPPED)
def test_articles_in_forms_and_other_sections(frame):
    rng = random.Random(len(frame))
    for _ in range(60):
        source, text = page(rng, frame)
        assert H.main_text(source) == text, source


#: no article, main or telling name anywhere
DIVS = [
    '<body><div><ul>{links}</ul></div><div><div>{inner}</div></div><div><ul>{links}</ul></div></body>',
    '<body><div><a href=/>Home</a> <a href=/n>News</a> | <a href=/c>Contact</a></div><div>{inner}</div><div>Buy one now.</div></body>',
    '<body><div><div>Short <a href=/1>teaser one</a></div><div>Short <a href=/2>teaser two</a></div></div><div>{inner}<ul>{links}</ul></div></body>',
    '<table><tr><td>{links}<td>{inner}<td><p>One <a href=/3>more</a></p><p>Two <a href=/4>more</a></p></table>',
    '<body><div><p>{links}</p></div><div><div>{inner}</div><div><a href=/p>back</a> <a href=/q>next</a></div></div><div><a href=/r>All rights.</a></div></body>',
]


def long_page(rng, frame):
    """Three or more paragraphs of some length, so that the text is denser than what is around it."""
    body = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(30, 90))) + "." for _ in range(rng.randrange(3, 9))]
    links = "".join(f'<li><a href="/{w}">{w}</a>' for w in WORDS[:8])
    return frame.format(inner="<h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in body), links=links), " ".join(["A title", *body])


@pytest.mark.parametrize("frame", DIVS)
def test_density_alone_finds_the_text(frame, monkeypatch):
    rng = random.Random(len(frame))
    for _ in range(40):
        source, text = long_page(rng, frame)
        assert not any(n.marked for n in H.parse(source)) and H.main_text(source) == text, source
    monkeypatch.setattr(H, "select", lambda nodes: ([nodes[0]], set()))
    assert H.main_text(source) != text


def test_density_decides_on_given_pages(small, monkeypatch):
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{small}/pages.parquet").column("html").to_pylist()
    with_density = [H.main_text(p) for p in pages]
    monkeypatch.setattr(H, "select", lambda nodes: ([nodes[0]], set()))
    assert all(H.main_text(p) != t for p, t in zip(pages, with_density))


def test_an_advert_without_a_name_and_parts_below_the_threshold():
    long = "A long sentence of the report, which says what was seen and by whom. " * 8
    parts = f"<section><h2>One</h2><p>{long}</p><p>{long}</p></section><section><h2>Two</h2><p>Short.</p></section>"
    want = f"Loose words. One {long}{long}Two Short."
    four = f"<p>{long}</p>" * 4
    # within one article all parts stay, a dense part beside it joins it, thin ones do not
    assert H.main_text(f"<body><article>Loose words. {parts}</article><div>Buy now.</div></body>") == want
    assert H.main_text(f"<body><div><p>{long}</p></div><div>{four}</div><div>Buy now.</div></body>") == (long * 5).strip()
    assert H.main_text(f"<body><h1>Title</h1><div><p>{long}</p><p>{long}</p></div></body>") == f"Title {long}{long}".strip()
    assert H.main_text(f"<body>a<div>b<div><p>{long}</p><p>{long}</p></div>c</div>d</body>") == f"{long}{long}".strip()
    assert H.main_text(f"<body><main>a<div>b<div><p>{long}</p><p>{long}</p></div>c</div>d</main></body>") == f"a b {long}{long}c d"


def test_form_around_a_page_without_heading():
    assert H.main_text("<body><form><nav><a href=/>menu</a></nav><div><p>Long text of the page. <p>And more.</div><input></form></body>") == "Long text of the page. And more."
    assert H.main_text("<body><div><p>Long text of the page.</p></div><form><p>Search</p><input></form></body>") == "Long text of the page."


@pytest.mark.parametrize("name", ["section-header", "share-price", "reply", "related", "notice", "widget"])
def test_a_name_alone_cuts_nothing_of_an_article(name):
    inner = f'<h1>Title</h1><p>First part.</p><div class="{name}"><h2>Second heading</h2></div><p>Second part.</p>'
    for tag in ("article", "main"):
        assert H.main_text(f"<body><{tag}>{inner}</{tag}></body>") == "Title First part. Second heading Second part."
    text = "The whole text of the page stands in here. " * 5
    assert H.main_text(f'<body><main><h1>Title</h1><div class="{name}"><p>{text}</p><form><input></form></div></main></body>') == f"Title {text.strip()}"


def test_text_rules():
    assert H.main_text("<article><p>a &lt;b&gt; c&nbsp;d\n\t e</p><p>f<br>g<b>h</b>i</p></article>") == "a <b> c d e f gh i".replace("gh i", "ghi")
    assert H.main_text("plain   text") == "plain text"
    assert H.main_text("<body><nav><a href=/>only menu</a></nav></body>") == ""
    for odd in (None, "", " ", "<", "<p", "<!-- x", "<script>x", "</p></p>", "<article>", "&am"):
        assert isinstance(H.main_text(odd), str)
    deep = "<div>" * 50_000 + "deep text" + "</div>" * 50_000
    assert H.main_text(deep) == "deep text"
    assert H.main_text("<article><p>" + "long words " * 200_000 + "</p></article>").count("long") == 200_000


def test_densities_by_hand():
    nodes = H.prune(H.parse("<body><p>abcdef</p><p><a href=/>link</a></p></body>"))
    H.measure(nodes)
    body, first, second = nodes[1], nodes[2], nodes[3]
    assert (body.chars, body.tags, body.link_chars, body.link_tags) == (10, 3, 4, 1)
    import math

    assert first.density == pytest.approx(6 * math.log(6) / math.log(math.log(6 * 1 / 6 + 0.4 * 6 + math.e)))
    assert second.density == 0.0 and body.total == pytest.approx(first.density)


def test_query_on_pages(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = QUERIES["op10_html_text"](spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        source = pages[r.page_id].html
        inner = re.search(r"(?s)<article>(.*?)(</article>|$)", source)
        plain = escape.unescape(re.sub(r"<[^>]*>?", lambda m: "" if m.group() in ("<b>", "</b>") else " ", inner.group(1))) if inner else ""
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_rows_and_columns(spark):
    rows = [(1, "u", None, 5, "t"), (1, "u", None, 5, "t"), (None, None, "<p>x y</p>", None, None), (3, "u", "", 1, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = H.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got.collect()) == [("1", "", 0), ("1", "", 0), ("3", "", 0), ("None", "x y", 3)]
    assert H.extract(df.limit(0)).collect() == []


def test_clashing_columns_stay(spark):
    from corpuskit.llm.html_text import extract

    df = spark.createDataFrame([("<p>Some words of a page.</p>", "a", "b", 1)], "html string, found string, __text string, `c.d` int")
    row = extract(df).first()
    assert (row["found"], row["__text"], row["c.d"], row["text"]) == ("a", "b", 1, "Some words of a page.")
