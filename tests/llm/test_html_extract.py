import re
from html import unescape

from sondage.llm import html_extract as h

PAGE = "page_id long, url string, html string, host int, region int, text int"


def brute(html):
    """The article of the tables' known layout."""
    m = re.search(r"<article>(.*?)</article>", html, re.DOTALL)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", m[1]) if m else []
    return "\n\n".join(t for p in parts if (t := " ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split())))


def texts(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], PAGE)
    return sorted(((r.page_id, r.text, r.n_chars) for r in h.extract(df).collect()), key=str)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = sorted((r.page_id, brute(r.html)) for r in df.collect())
    assert sorted((r.page_id, r.text) for r in h.extract(df).collect()) == want


def test_other_layouts(spark):
    body = "<p>First &amp; best\n text.<p>Second<br>line <i>in</i>line &lt;b&gt;<ul><li>one<li>two</ul>"
    want = "First & best text.\n\nSecond line inline <b>\n\none\n\ntwo"
    shell = "<html><head><title>T</title><script>if (a<b) '</p>'</script></head><body class='page'><div class='top-menu'><a>Home</a></div>{}<aside>side</aside><form><p>Sign up</form><section id=comments><article class='comment'><p>Nice post</article></section><div role=contentinfo>(c)</div></body></html>"
    pages = [shell.format(f"<article>{body}</article>"), shell.format(f"<main><div class='share'>Share</div>{body}</main>"), shell.format(f"<div class='post'>{body}</div>"), shell.format(f"<div class='cookie-notice'>We use cookies and very many long words about them, more than the text has</div><div class='post'>{body}</div>")]
    rows = [(i, f"http://h{i}.example.com/{j}", p) for i, p in enumerate(pages) for j in range(3)]
    assert {r[1] for r in texts(spark, rows)} == {want}


def test_awkward_rows(spark):
    rows = [(1, "http://a/1", None), (2, None, "<p>x</p>"), (None, "http://a/1", "<article>a < b <p"), (4, "http://a/2", ""), (4, "http://a/2", ""), (5, "http://a/3", "plain"), (6, "http://a/4", "<div>" * 300 + "deep" + "<p>" * 500), (7, "no host", "<!-- never ends <p>x"), (8, "http://b/1", "<article>" + "<p>w</p>" * 20000 + "</article>")]
    got = {r[0]: r[1] for r in texts(spark, rows)}
    assert len(texts(spark, rows)) == len(rows)
    assert got[1] == got[4] == got[7] == "" and got[2] == "x" and got[5] == "plain" and got[6] == "deep"
    assert got[None] == "a < b <p" and got[8] == "\n\n".join(["w"] * 20000)
    assert texts(spark, []) == []


def regex(wrapper):
    """The wrapper as a regular expression over spelled tokens."""
    out = []
    for x in wrapper:
        out.append(re.escape(x) + " " if isinstance(x, str) else f"(?:{regex(x[1])}){x[0]}")
    return "".join(out)


def test_wrapper_matches_what_it_was_inferred_from():
    streams = [
        "div h1 # /h1 p # /p p # /p /div".split(), "div h1 # /h1 p # /p /div".split(), "div h1 # /h1 ul li # /li li # /li li # /li /ul p # /p /div foot # /foot".split(),
        "div p # /p p # /p /div".split(), "div h1 # /h1 ul li # /li /ul p # /p /div".split(),
    ]
    wrapper = h.fold(tuple(streams[0]))
    for s in streams[1:]:
        wrapper = h.align(wrapper, h.fold(tuple(s)))
    for s in streams:
        assert re.fullmatch(regex(wrapper), " ".join(s) + " ")
    assert "|" not in h.spell(wrapper)


def test_slots_of_a_wrapper():
    streams = ["body div.a # /div.a nav # /nav /body", "body div.b # /div.b div.c p # /p p # /p /div.c /body", "body div.b p # /p div.c # /div.c /div.b /body"]
    wrapper = h.fold(tuple(streams[0].split()))
    for s in streams[1:]:
        wrapper = h.align(wrapper, h.fold(tuple(s.split())))
    held = lambda p: any(h.fits(p, s) for s in h.slots(wrapper))
    assert all(map(held, ("/body/div.a", "/body/nav", "/body/div.b", "/body/div.c", "/body/div.b/div.c")))
    assert not any(map(held, ("/body/aside", "/div.a", "", "/body/div.a/div.a/div.a")))
    assert h.region_of(wrapper, {"/body/aside": 99, "/body/div.b/div.c": 5, "/body/div.b": 4}) == ("/body/div.b", frozenset())
    assert h.region_of(wrapper, {"/body/div.c": 5, "/body/div.b": 4})[0] == "/body"
    assert h.region_of(wrapper, {"/body/aside": 99})[0] == "/body/aside"
    deep = h.fold(("div",) * 300 + ("#",) + ("/div",) * 300)
    assert h.region_of(deep, {"/div" * 300: 1})[0] == "/div" * 300


def test_wrappers_of_a_host(spark):
    df = spark.createDataFrame([(i, "http://Host/x", "<div>" + "".join(f"<p>{i} {k}</p>" for k in range(1 + i % 3)) + ("<h2>q</h2>" if i % 5 else "") + "</div>", 1, 2, 3) for i in range(50)] * 2, PAGE)
    r = h.wrappers(h._pages(df, "page_id", "url", "html")).collect()
    assert len(r) == 1 and (r[0].host, r[0].n_pages, r[0].region, r[0].shells) == ("host", 50, "/div", [])
    q = h.Block("", (), True, "q", 1).key
    assert r[0].wrapper == f"div ( p # /p )+ ( h2 ={q} /h2 )? /div" and r[0].fixed == [q]


def story(i, n=3):
    return [f"Paragraph {k} of story {i}, which no other page has." for k in range(n + i % 3)]


NOTE = "We keep small files on your machine and show this note on every page of the site."
#: Layouts without an article element: what holds the texts, and what comes of them.
LAYOUTS = {
    "split": lambda i: f"<div class='post'><div class='intro'><p>{story(i)[0]}</p></div><div class='body'>{''.join(f'<p>{t}</p>' for t in story(i)[1:])}</div></div>",
    "sections": lambda i: "<div>" + "".join(f"<section class='s{k}'><p>{t}</p></section>" for k, t in enumerate(story(i))) + "</div>",
    "named": lambda i: f"<article class='post social'>{''.join(f'<p>{t}</p>' for t in story(i))}</article>",
    "shell": lambda i: f"<div class='layout sidebar' id='comments-open'><div class='share-price'>{''.join(f'<p>{t}</p>' for t in story(i))}</div></div>",
    "form": lambda i: f"<form>{''.join(f'<p>{t}</p>' for t in story(i))}</form>",
}
COMMENTS = "<ol class='commentlist'><li>Reader {0} agrees with it</li></ol><section class='responses'><p>Reader {0} doesn't</p></section>"


def layout(kind, i):
    return f"<html><body><div><p>{NOTE}</p></div>{LAYOUTS[kind](i)}{COMMENTS.format(i)}<div><p>All rights kept by the site.</p><ul><li><a href='/{i}'>Story {i} again</a></li></ul></div></body></html>"


def test_layouts_without_article(spark):
    """Wrappers part the article from texts that no name or tag marks."""
    rows = [(100 * k + i, f"http://{kind}.example.com/{i}", layout(kind, i)) for k, kind in enumerate(LAYOUTS) for i in range(12)]
    want = {100 * k + i: "\n\n".join(story(i)) for k, _ in enumerate(LAYOUTS) for i in range(12)}
    assert {r[0]: r[1] for r in texts(spark, rows)} == want


def test_numbered_class_names(spark):
    """A number in a class name doesn't make every page's element another one."""
    for tag in ("div", "article"):
        page = "<body class='postid-{0} single'><div class='col-4'><p>Box {1} of the day</p></div><" + tag + " class='post-{0} post type-post'><p>Text {0} says more of it.</p><p>And {1} ends it.</p></" + tag + "><div class='col-8'><p>Seen {1} times today</p></div></body>"
        rows = [(i, f"http://h/{i}", page.format(1000 + i, i * 7 % 61)) for i in range(60)]
        got = {r[0]: r[1] for r in texts(spark, rows)}
        assert all(got[i].startswith(f"Text {1000 + i} says") or f"\n\nText {1000 + i} says" in got[i] for i in range(60))
        df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], PAGE)
        known = h.wrappers(h._pages(df, "page_id", "url", "html")).first()
        assert len(known.wrapper) < 400 and "post-0" in known.wrapper.replace("_", "-")
    assert [h._kind(x) for x in ("post-17", "postid-1", "col-4", "h2", "page-item-3", "w50", "id-9-x-2", "type-post")] == ["post-0", "postid-0", "col-4", "h2", "page-item-0", "w50", "id-0-x-0", "type-post"]


def test_without_wrappers_the_notes_stay(spark):
    for kind in LAYOUTS:
        alone = h.main_text(layout(kind, 1), None)
        assert (NOTE in alone) == (kind not in ("named",))
        # with class names alone, a form or a sidebar that holds the article is lost
        assert all(t in alone for t in story(1)) == (kind not in ("shell", "form"))


def test_one_page_of_a_host(spark):
    """With one page, or copies of one, all its texts are slots."""
    rows = [(k, "http://once/x", "<body><div><p>Note.</p></div><div class='post'><p>Only story.</p></div></body>") for k in range(4)]
    assert {r[1] for r in texts(spark, rows)} == {"Note.\n\nOnly story."}


def test_copies_of_an_article_stay(spark):
    """A host most of whose pages hold one article keeps it."""
    rows = [(k, f"http://h/{k}", f"<body><nav>{k}</nav><article><h1>Same</h1><p>Same story.</p></article></body>") for k in range(9)]
    assert {r[1] for r in texts(spark, rows)} == {"Same\n\nSame story."}


def test_template_texts_within_an_article(spark):
    """A box of constant text in an article goes; a constant paragraph among others stays."""
    page = "<body><article><header><h1>Story {0}</h1><p>by {0}</p></header><div><p>Join our list.</p></div><p>Text {0}.</p><p>Licensed freely.</p></article></body>"
    rows = [(k, f"http://h/{k}", page.format(k)) for k in range(5)]
    assert {r[0]: r[1] for r in texts(spark, rows)} == {k: f"Story {k}\n\nText {k}.\n\nLicensed freely." for k in range(5)}


def test_names(spark):
    assert all(map(h._marked, ("cookie-notice", "top-menu", "site-footer", "related-posts", "ad", "ad-300x250", "post-comments", "newsletter_signup")))
    assert not any(map(h._marked, ("has-sidebar", "no-sidebar", "share-price", "tag-social", "comments-open", "post", "main-content", "", "adopt")))
