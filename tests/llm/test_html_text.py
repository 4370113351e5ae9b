from __future__ import annotations

import pytest

from undula.llm.html_text import extract_text, main_text

CASES = {
    "plain": ("<html><body><article><h1>T</h1><p>One,  two.\n three</p><p>Four &amp; &lt;five&gt; &eacute;&#233;&#x41;</p></article></body></html>", "T\nOne, two. three\nFour & <five> ééA"),
    "frame": (
        '<body><header><p>Site head, here.</p></header><nav><ul><li><a href="/x">X</a></li></ul></nav><div class="ad">Buy now, please.</div>'
        '<article><h1>Title</h1><p>Body text, first.</p><aside>pull quote</aside><form><p>mail?</p></form></article><div id="comments"><p>Nice, very nice indeed. I liked it.</p></div><footer>(c)</footer></body>',
        "Title\nBody text, first.",
    ),
    "unclosed": ("<article><p><b>Lead.<br><p>Next one.<ul><li>a<li>b</ul><p>Last", "Lead.\nNext one.\na\nb\nLast"),
    "script": ('<body><script>var t="</p><p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><article><p>Yes, this.</p></article>', "Yes, this."),
    "nested comments": ("<main><article><p>Text one. Here.</p><section class='reader-comments'><article><p>Hi there.</p></article></section></article></main>", "Text one. Here."),
    "inline": ("<article><p>a<b>b</b>c <i>d</i>\n<a href='x'>e</a></p></article>", "abc d e"),
    "truncated entity": ("<article><p>x &amp y &am</p></article>", "x & y &am"),
    "truncated tag": ("<article><p>Kept text.</p><p class=", "Kept text."),
    "no article": (
        '<body class="page"><div class="menu"><a href=1>A</a><a href=2>B</a></div><div class="content"><p>First para, with some text; and more of it.</p><p>Second para, also long enough.</p></div><div class="sidebar">More, here.</div></body>',
        "First para, with some text; and more of it.\nSecond para, also long enough.",
    ),
    "empty": ("", ""),
    "no text": ("<html><body><nav><a href=x>menu</a></nav></body></html>", ""),
    "less than": ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table><p>After it.</p></article>", "a\nb\nc\nAfter it."),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    html, want = CASES[name]
    assert main_text(html) == want


RAW_CASES = {
    "less than in script": "<script>if(a<b){x()}</script>",
    "loop in script": "<SCRIPT type='module'>for(i=0;i<n;i++){s='<p'}</SCRIPT >",
    "comment in script": "<script>if(a<!--b){}</script>",
    "style": "<style>/* a<b */ p{}</style>",
    "textarea": "<textarea>x <b 'y</textarea>",
    "noscript": "<noscript><img src='x</noscript>",
}


@pytest.mark.parametrize("name", RAW_CASES)
def test_raw_text_ends_at_its_own_end_tag(name):
    assert main_text(f"<body>{RAW_CASES[name]}<article><p>Text, all of it.</p><p>More a{RAW_CASES[name]}b.</p></article></body>") == "Text, all of it.\nMore ab."


WRAPPERS = ["content has-sidebar", "page-with-sidebar", "no-comments", "search-results", "post-share", "hasSidebar"]


@pytest.mark.parametrize("words", WRAPPERS)
def test_wrapper_with_an_aside_word_keeps_its_article(words):
    side = "<div class='sidebar'><p>More, here.</p></div><div id='comments'><p>Nice, very nice.</p></div>"
    paragraphs = "<p>First para, with some text; and more of it.</p><p>Second para, also long enough, as it is.</p>"
    want = "First para, with some text; and more of it.\nSecond para, also long enough, as it is."
    for inner in (f"<article>{paragraphs}</article>{side}", f"<main>{paragraphs}</main>{side}", f"<main><div class='search-results'><article>{paragraphs}</article></div></main>", f"<div class='text'>{paragraphs}</div>{side}"):
        assert main_text(f"<body><nav><a href=x>X</a></nav><div class='{words}'>{inner}</div><footer>(c)</footer></body>") == want


def test_asides_stay_out_beside_a_text():
    side = "<div class='comments'><article><p>Nice, very nice indeed.</p></article></div>"
    for tag in ("article", "div"):
        assert main_text(f"<body><{tag}><p>The text itself, of some length.</p></{tag}>{side}</body>") == "The text itself, of some length."
    assert main_text(f"<main><article><p>Short, text.</p>{side * 3}</article></main>") == "Short, text."


def test_long_page_is_whole():
    paragraphs = [f"Paragraph {k}, with words." for k in range(5000)]
    html = "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    assert main_text(html) == "\n".join(paragraphs)


def test_table_of_pages(spark):
    rows = [(k, f"u{k}", html, "clash", 7) for k, (html, _) in enumerate(CASES.values())] + [(99, None, None, None, None), (0, "u0", CASES["plain"][0], "clash", 7)]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["page_id", "url", "text", "n_chars"]
    by_id = {r.page_id: r for r in got}
    for k, (_, want) in enumerate(CASES.values()):
        assert (by_id[k].text, by_id[k].n_chars) == (want, len(want))
    assert (by_id[99].text, by_id[99].n_chars) == ("", 0)
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_given_pages_give_their_articles(spark, sf):
    import html as H
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = r.html[r.html.find("<article>") + 9 :].split("</article>")[0]
        parts = re.split(r"</?(?:p|h1)>", inner.replace("<b>", "").replace("</b>", "").replace("<br>", " "))
        assert main_text(r.html) == "\n".join(t for t in (" ".join(H.unescape(p).split()) for p in parts) if t)


BROKEN = {
    "unclosed quote": ("<p>hello there, reader.</p><img src=\"a.png\" width=640 data-large-url=\"http://x" + "y" * 50_000, "hello there, reader."),
    "quote that ends nowhere": ("<article>" + "<p class='x>Some text.</p>" * 2001 + "</article>", None),
    "open quotes": ("<p class=\"a" * 50_000, None),
    "deep": ("<div>" * 100_000 + "text, here.", "text, here."),
    "end tags": ("<p>Text, first.</p>" + "<div>" * 3000 + "</span>" * 50_000 + "</p>" * 50_000, None),
    "comments": ("<p>Text, first.</p>" + "<!--" * 50_000, "Text, first."),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_markup_takes_time_in_proportion(name):
    import time

    html, want = BROKEN[name]
    start = time.process_time()
    got = main_text(html)
    assert time.process_time() - start < 20 and (want is None or got == want)


LONG = "A paragraph, with some words in it; and then more of them, as it goes on. " * 3


def test_paths_decide_where_nothing_has_a_name():
    page = "<body><div><a href=a>Link one</a> <a href=b>Link two</a> <a href=c>Three</a></div><h2>Head</h2>" + f"<p>{LONG}</p><p>Short one.</p><p>{LONG}</p><ul><li>first item</li><li>second</li></ul><div>We use cookies. OK?</div></body>"
    assert main_text(page) == "\n".join(["Head", LONG.strip(), "Short one.", LONG.strip(), "first item", "second"])
    nested = f"<body><div><div><a href=a>Link one</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div>We use cookies, as you know. <button>OK</button></div></div></body>"
    assert main_text(nested) == "\n".join([LONG.strip()] * 2)


def test_words_weigh_and_do_not_decide():
    want = f"{LONG.strip()}\nThe results, as they are noted, and more of them."
    assert main_text(f"<article><p>{LONG}</p><section class='notice-of-results'><p>The results, as they are noted, and more of them.</p></section></article>") == want
    assert main_text(f"<body><form class='search'><div><p>{LONG}</p><p>{LONG}</p></div></form></body>") == "\n".join([LONG.strip()] * 2)
    assert main_text("<body><div class='cookie-notice'>We use cookies, as you know.</div><div class=menu><a href=x>X</a></div></body>") == ""
    assert main_text("<article><p>x <math><mi>y</mi><mo>=</mo><mn>2</mn></math>.</p></article>") == "x y=2."
    assert main_text("<article><h1>The end.</h1><p><b>The end.<br></article><div class='ad'>Buy a very long thing now, please. Or more of them.</div>") == "The end.\nThe end."


def test_content_paths_against_a_plain_count():
    """Pages of random parts; the twin adds up what was put in, path by path."""
    import random

    from undula.llm.html_text import blocks_of, content_paths

    rng = random.Random(3)
    weights = {"": 1.0, "ad": 0.03, "reader-comments": 0.1, "text": 1.0, "has-menu": 1.0, "old news notice": 0.03, "notice-of-results": 0.6}
    for _ in range(200):
        rows, page = [], []
        for _ in range(rng.randint(1, 12)):
            name, tag, links = rng.choice(list(weights)), rng.choice(("p", "div", "h2")), rng.random() < 0.3
            words = sorted({w for c in name.split() for w in c.split("-")})
            for _ in range(rng.randint(1, 3)):
                text = " ".join(rng.choice(("word", "a", "longer,", "end.")) for _ in range(rng.randint(1, 40)))
                page.append(f"<section class='{name}'><{tag}>{'<a href=x>' if links else ''}{text}{'</a>' if links else ''}</{tag}></section>")
                rows.append((f"/body/section{'.' * bool(words)}{'.'.join(words)}/{tag}", text, links, weights[name]))
        paths = list(dict.fromkeys(r[0] for r in rows))
        level = {}
        ratio = lambda p, f: sum(f(r) for r in rows if r[0] == p) / sum(2 if r[2] and r[1] and False else 1 + r[2] for r in rows if r[0] == p)  # noqa: E731  the block's tag, and the link's end tag
        for f in (lambda r: 0 if r[2] else len(r[1]), lambda r: r[1].count(",") + r[1].count(".")):
            x = [ratio(p, f) for p in paths]
            for k, p in enumerate(paths):
                near = [x[j] for j in (k - 1, k + 1) if 0 <= j < len(x) and paths[j].rsplit("/", 1)[0] == p.rsplit("/", 1)[0]]
                level.setdefault(p, []).append(x[k] * (1 - len(near) / 16) + sum(near) / 16)
        level = {p: a * (1 + b) * next(r[3] for r in rows if r[0] == p) for p, (a, b) in level.items()}
        total = sum(level[r[0]] * len(r[1]) for r in rows)
        mean = sum(level[r[0]] ** 2 * len(r[1]) for r in rows) / total if total else 0
        want = {p for p, v in level.items() if v > 0 and v >= 0.3 * mean}
        blocks = blocks_of(f"<body>{''.join(page)}</body>")
        assert [b.path for b in blocks] == [r[0] for r in rows]
        got = content_paths(blocks, ["".join(b.text) for b in blocks])
        assert got == want or all(abs(level[p] - 0.3 * mean) < 1e-9 * mean for p in got ^ want)
