import random
import time

import pytest

from hazeloom.llm.html import Page, extract_pages

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head><body><nav><ul><li><a href='/x'>x</a></li></ul></nav>"
    "<!-- <p>no --><div class='ad'>buy</div><article><h1>A &amp;  B</h1><p><b>bold.<br><p>one\n two &lt;x&gt; caf&eacute;</p><section class='comments'><p>me too</p></section>"
    "<form><input name='a>b'>no</form><aside>no</aside></article><footer>&copy; f</footer></body></html>"
)


def text(html):
    return Page(html).main_text(None)


def test_article():
    assert text(PAGE) == "A & B\nbold.\none two <x> café"


def test_pages_without_article_and_broken_markup():
    div = "<body><div id=top><p>menu <a href=x>link link link</a></p></div><div class='post p12'><p>" + "long text " * 20 + "</p><ul><li>a<li>b</ul></div></body>"
    assert text(div) == ("long text " * 20).strip() + "\na\nb"
    for html, want in (("", ""), ("plain &lt;", "plain <"), ("<p>a<p>b", "a\nb"), ("<div>a</span>b<i>c</div>d", None), ("<script>x", ""), ("<!-- x", ""), ("a < b", "a < b")):
        assert want is None or text(html) == want, html
    assert text("<body><p>" + "<b>" * 3000 + "deep</body>") == "deep"


def test_title_and_lead_beside_the_body_without_article(spark):
    body, menu = "<p>" + "story " * 60 + "</p>", "<div class='top'><a href='/'>home page of the site</a></div>"
    inside = "<h1>Title here</h1><p>A lead of some words.</p><div class='text'><div class='inner'>" + body + "</div></div>"
    want = "Title here\nA lead of some words.\n" + ("story " * 60).strip()
    pages = [f"<body>{menu}<{a}>{inside}</{b}></body>" for a, b in (("main", "main"), ("div class='post'", "div"), ("section", "section"))] + [inside, f"<body>{menu}{inside}</body>"]
    for html in pages[:4]:
        assert text(html) == want
    assert text(pages[4]) == "home page of the site\n" + want
    nested = f"<body>{menu}<main><section><h2>One</h2>{body}</section><section><div><p>Two is short.</p></div></section></main></body>"
    assert text(nested) == "One\n" + ("story " * 60).strip() + "\nTwo is short."
    got = extract_pages(spark.createDataFrame([(i, "http://a.b/x", pages[1]) for i in range(3)], "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [want] * 3


def test_hosts_vote(spark):
    good = "<body><div class='main'><p>" + "story " * 40 + "</p></div><div class='more'><p>" + "x " * 9 + "</p></div></body>"
    odd = "<body><div class='main'><p>short</p></div><div class='more'><p>" + "y " * 400 + "</p></div></body>"
    rows = [(i, "http://a.b/" + str(i), good) for i in range(8)] + [(8, "http://a.b/8", odd), (9, "http://c.d/", odd), (10, None, PAGE), (11, "u", None), (12, "http://a.b/8", ""), (8, "http://a.b/8", odd)]
    pages = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, path string")
    want = sorted([(i, ("story " * 40).strip()) for i in range(8)] + [(8, "short"), (9, ("y " * 400).strip()), (10, text(PAGE)), (11, ""), (12, ""), (8, "short")])
    for limit in (100, 0):
        got = extract_pages(pages, broadcast_hosts=limit).collect()
        assert sorted((r.page_id, r.text) for r in got) == want and all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p title=it's>hello world</p><p>second</p><p>don't lose me</p><p>tail</p>", "hello world\nsecond\ndon't lose me\ntail"),
        ("<p>x<svg/>y</p><p>z</p>", "xy\nz"),
        ("<p>x<svg><text>no</text></svg>y<math><mi>n</mi><mo>+</mo></math></p><p>z</p>", "xyn+\nz"),
        ("<article><p>a</p><div class='share-price'>b</div><div class='search-results'>c</div><div class='article-header'>d</div></article>", "a\nb\nc\nd"),
        ("<article><p>long text of the page here</p><div class='ad-slot'>b</div><div id=siteFooter>c</div><p class='cookie notice'>d</p><span role=search>e</span></article>", "long text of the page here"),
        ("<div class='sidebar-wrapper'><p>all of the text</p></div>", "all of the text"),
        ("<p a=\"x>y</p><p>z</p>", "y\nz"),
        ("<p a=\"x>y\" b='>'/>q</p><!--><p>z</p><!-- -- >no--!><p>e<!- x>f</p>", "q\nz\nef"),
        ("<p>a</p x='>'><p/>b<p>c</", "a\nb\nc</"),
        ("<ul><li>a<div>b<li>c</ul><dl><dt>d<dd>e</dl><table><tr><td>f<td>g<tr><td>h</table>", "a\nb\nc\nd\ne\nf\ng\nh"),
        ("<b>a<p>b</b>c</p>d", "a\nbc\nd"),
        ("<p>1 < 2 > 0 &amp;lt; &#x41;&nbsp;&#66</p>", "1 < 2 > 0 &lt; A B"),
    ],
)
def test_odd_markup(html, want):
    assert text(html) == want


LONG = " ".join(f"word{i}" for i in range(30))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<main>" + "".join(f"<div class='elementor-element elementor-widget elementor-widget-text'><p>{i} {LONG}</p></div>" for i in range(4)) + "</main>", "\n".join(f"{i} {LONG}" for i in range(4))),
        ("<main>" + "".join(f"<div class='sidebar box'><p>{i} {LONG}</p></div>" for i in range(4)) + "</main>", "\n".join(f"{i} {LONG}" for i in range(4))),
        (f"<main><section id='intro'><h2>Intro</h2><p>{LONG}</p></section><section id='comments'><h2>Comments</h2><p>{LONG} a</p></section><section id=search><h2>Search \u00b6</h2><p>b</p></section></main>",
         f"Intro\n{LONG}\nComments\n{LONG} a\nSearch \u00b6\nb"),
        (f"<article><h2 id='comments'>Comments on theory</h2><p id='share'>A share of it.</p><p>{LONG}</p></article>", f"Comments on theory\nA share of it.\n{LONG}"),
        (f"<article><p>{LONG}</p><section id=comments><h2>Comments</h2><div class='comment'>me too</div></section></article>", LONG),
        (f"<article><p>{LONG}</p><section id=comments><h2>3 comments</h2><p>me too</p></section></article>", LONG),
        (f"<article><p>{LONG}</p><div class='widget related'><a href=x>some other story to read</a> now</div><div class='share'><a href=y>tell all your friends</a></div></article>", LONG),
        (f"<article><p>{LONG}</p><div class='related work'><p>Others did this before.</p></div><div class='notice'>Mind the gap.</div></article>", f"{LONG}\nOthers did this before.\nMind the gap."),
        (f"<div class=notice>We moved.</div><main><p>{LONG}</p><div class='cookie-notice'>We use them.</div></main>", LONG),
    ],
    ids=range(9),
)
def test_names_that_text_has_as_well(html, want):
    assert text(html) == want


def test_random_pages_of_builders_boxes():
    """Every block in a box that a page builder made, some boxes of one class; ids made from headings; page parts between."""
    rng = random.Random(8)
    classes = ["elementor-widget", "wp-block-group", "widget", "related", "share", "search", "notice", "e-con box widget-container", "sharing"]
    for k in range(200):
        want, inside, same = [], [], rng.choice(classes)
        for i in range(rng.randrange(3, 9)):
            line = " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(12, 40)))
            if rng.random() < 0.4:
                head = rng.choice(["Comments", "Search", "Menu", "Related work", "Social ads", "Sidebar"])
                inside.append(f"<section id='{head.lower().replace(' ', '-')}'><h2>{i}. {head}</h2><p>{line}</p></section>")
                want += [f"{i}. {head}", line]
            else:
                inside.append(f"<div class='{rng.choice([same, rng.choice(classes)])}' id='b{i}'><p id={rng.choice(['share', 'menu', 'x'])}>{line}</p></div>")
                want.append(line)
            if rng.random() < 0.3:
                inside.append(rng.choice(["<div class='ad'>buy it</div>", "<div class='widget'><a href=/a>all of our stories</a></div>", "<div class='comments'><p>me too</p></div>", "<div class='cookie notice'>we use</div>"]))
        page = rng.choice(["<body><main>{x}</main></body>", "<article>{x}</article>", "<body><div id=page><main>{x}</main></div></body>"]).format(x="".join(inside))
        assert text(page) == "\n".join(want), (k, page)


def test_random_pages_of_known_blocks():
    """Pages built from blocks and page parts in random frames; what comes back is the blocks, no more, no less."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "don't", "x", "naïve", "&amp;", "&lt;b&gt;", "漢字", "3 > 2"]
    plain = {"&amp;": "&", "&lt;b&gt;": "<b>"}
    sep = lambda: rng.choice([" ", "\n ", "\t", "<br>", " <i>", "</i> ", "<!-- c --> "])
    parts = ["<nav><a href=/>home</a></nav>", "<aside>aside text</aside>", "<div class='ad'>buy it</div>", "<form><input>send<select><option>o</select></form>",
             "<script>if (a<b) '<p>no</p>'</script>", "<style>p{}</style>", "<section id=comments><p>me too</p></section>", "<div class='cookie-notice'><p>we use</p></div>"]
    for k in range(300):
        want, inside = [], []
        for _ in range(rng.randrange(4, 12)):
            some = [rng.choice(words) for _ in range(rng.randrange(8, 30))]
            gaps = [sep() for _ in some]
            want.append(" ".join(plain.get(w, w) for w in some))
            open_tag, close_tag = rng.choice([("<p>", "</p>"), ("<p class=lead>", ""), ("<h2>", "</h2>"), ("<blockquote><p>", "</p></blockquote>"), ("<ul><li>", "</ul>"), ("<div data-x='>'><p>", "</div>")])
            inside.append(open_tag + "".join(w + (" " if "<" in g and g.strip() not in ("<br>", "</i>") else "") + g for w, g in zip(some[:-1], gaps, strict=False)) + some[-1] + "</i>" + close_tag)
            inside += rng.choices(["", *parts], k=1)
        frame = rng.choice(["<body>{t}<article>{x}</article>{f}</body>", "<body>{t}<main>{x}</main>{f}", "{t}<div id=wrap><div class='post'>{x}</div></div>{f}", "<html><body>{t}<div class=a><article><section>{x}</section></article></div>{f}"])
        page = frame.format(t="<header>top</header>" + rng.choice(parts), x="".join(inside), f=rng.choice(parts) + "<footer>end</footer>")
        assert text(page) == "\n".join(want), (k, page)


@pytest.mark.parametrize(
    "html",
    [
        "<div>" * 50_000 + "deep",
        "<div class=a1>" * 20_000 + "".join(f"<p>{i} text</p></div>" for i in range(20_000)),
        "<a '" * 300_000,
        "<p x=\"" * 200_000 + ">",
        "<b>" * 50_000 + "</i>" * 50_000 + "<div>" + "</b>" * 50_000 + "t",
        "<ul>" + "<div>" * 30_000 + "<li></li>" * 30_000,
        "<script>" + "</scrip" * 100_000,
        "<!--" * 200_000,
        "<p>" + "word " * 250_000,
        "<td>" * 60_000 + "</tr>" * 60_000,
        "<p " + "=" * 300_000,
        "<p " + "a " * 300_000 + "b=c>t",
        "<div class=ad>" * 50_000 + "text",
    ],
    ids=range(13),
)
def test_time_in_proportion_to_length(html):
    began = time.time()
    text(html)
    assert time.time() - began < 8


def test_rows_with_nulls_and_an_empty_table(spark):
    pages = spark.createDataFrame([(None, "http://a.b/", "<p>a</p>"), (None, None, None), (1, "", "<p></p>")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in extract_pages(pages).collect())
    assert got == [("1", "", "", 0), ("None", "None", "", 0), ("None", "http://a.b/", "a", 1)]
    assert extract_pages(pages.limit(0)).collect() == []
