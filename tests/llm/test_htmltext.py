"""Main text of pages of several layouts."""
from spanlake.llm import htmltext as H

BODY = "<p>First paragraph of the story, long enough to matter here.</p><p>Second <b>par</b>agraph with a <a href='/x'>link</a> &amp; more\n words.</p>"
TEXT = "First paragraph of the story, long enough to matter here. Second paragraph with a link & more words."
NAV = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Item {i}</a></li>" for i in range(12)) + "</ul></nav>"


def page(main):
    return f"<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body><header><a href='/'>Home</a> Site name</header>{NAV}{main}<footer>&copy; someone, all rights</footer></body></html>"


def test_layouts():
    for main in (f"<article><h1>Title here</h1>{BODY}</article>", f"<main><h1>Title here</h1>{BODY}</main>", f"<div class='content'><h1>Title here</h1>{BODY}</div>",
                 f"<div id='post'><h1>Title here</h1>{BODY}</div><aside>Other things to read now</aside>",
                 f"<article><h1>Title here</h1>{BODY}<div class='ad-box ad'>Buy this now</div><section id='comments'><p>First! What a nice story this is, thanks.</p></section></article>",
                 f"<div class='cookie-notice'><p>We use cookies on this site to serve you.</p></div><div><h1>Title here</h1>{BODY}<form><label>Mail</label><input name=a><button>Send</button></form></div>",
                 f"<script>var a='<p>no</p>';</script><div><h1>Title here</h1><!-- <p>old</p> -->{BODY}<noscript>Enable it</noscript></div>"):
        assert H.main_text(page(main), {}) == "Title here " + TEXT, main


def test_odd_pages():
    for p, want in ((None, ""), ("", ""), ("just   words\n here", "just words here"), ("<p>a<br>b<p>c", "a b c"), ("<div>1 &lt; 2 &#233;&nbsp;x</div>", "1 < 2 é x"), (NAV, ""),
                    ("<p>open <b>bold<p>next <i>it", "open bold next it"), ("<p>x</p><!-- no end", "x"), ("<p title='a > b'>y</p>", "y"), ("< 3 and <3", "< 3 and <3"), ("<script>all", "")):
        assert H.main_text(p, {}) == want, p
    assert len(H.main_text("<p>" + "word " * 200_000, {}).split()) == 200_000


def test_learned(spark):
    pages = [(i, "u", page(f"<article><h1>Title here</h1>{BODY}</article><div>outside words of no use</div>"), 1) for i in range(5)]
    pages += [(9, "u", page(f"<section>{BODY}</section><div>outside words of no use</div>"), 1), (10, "u", None, 1), (10, "u", None, 1), (11, "u", "", 1)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, text int")
    weights = H.learn_weights(df)
    assert weights["p"] > 0 > weights["div"] and weights["<p"] < 0 and weights["!li+a"] < 0
    rows = {r.page_id: r for r in H.extract_text(df).collect()}
    assert rows[0].text == "Title here " + TEXT and rows[9].text == TEXT and rows[10].text == rows[11].text == "" and rows[9].n_chars == len(TEXT)
    assert H.extract_text(df).count() == len(pages) and H.extract_text(df.limit(0)).collect() == []


def test_scan_is_the_best_region():
    """The linear scan's region has the highest sum of all contiguous ones."""
    import itertools
    import random
    r = random.Random(5)
    for _ in range(100):
        parts = [r.choice(["<p>good words here</p>", "<li><a href=x>menu entry</a></li>", "<hr>", "<div>more text</div>", "<div class=ad>buy</div>"]) for _ in range(7)]
        items = H.tokens("".join(parts))
        score = [(-H.MOST if bad else H._score(w, False, {})) * len(t.split()) if n is None else H.TAG_COST for n, w, bad, t in items]
        best = max((sum(score[a:b]) for a, b in itertools.combinations(range(len(items) + 1), 2)), default=0)
        text = H.main_text("".join(parts), {})
        assert bool(text) == (best > 0)
        regions = [(a, b) for a, b in itertools.combinations(range(len(items) + 1), 2) if sum(score[a:b]) >= best - 1e-9]
        words = lambda a, b: " ".join("".join(t if n is None and not bad else " " for n, _, bad, t in items[a:b]).split())
        assert not text or text in {words(a, b) for a, b in regions}


def test_names_around_the_article():
    """Class names of themes on the page, the article or its wrappers say nothing about the text; those of furniture still do."""
    plain = f"<h1>Title here</h1>{BODY}"
    comments = "<div id='comments'><article class='comment'><p>" + "What a nice story this is. " * 30 + "</p></article></div>"
    for name in ("has-sidebar", "right-sidebar", "no-sidebar", "comments-open", "has-header-image", "content-with-sidebar"):
        for main in (f"<div class='{name}'><article>{plain}</article>{comments}</div>", f"<article class='post {name}'>{plain}</article>{comments}", f"<main class='{name}'>{plain}</main>",
                     f"<div class='{name}'><div>{plain}</div><div class='sidebar'><p>Other things</p></div></div>"):
            assert H.main_text(page(main), {}) == "Title here " + TEXT, main
        assert H.main_text(page(f"<div>{plain}</div>").replace("<body>", f"<body class='{name}'>"), {}) == "Title here " + TEXT, name


def test_furniture_inside_the_article_parts_nothing():
    """Asides, adverts and forms of any length, at the start, in the middle and at the end, leave the article whole."""
    first, second = " ".join(f"one{i}" for i in range(12)), " ".join(f"two{i}" for i in range(40))
    for n in (5, 20, 60, 200):
        junk = " ".join(f"junk{i}" for i in range(n))
        rows = "".join(f"<li><a href=/{i}>go{i}</a></li>" for i in range(n))
        for extra in (f"<aside>{junk}</aside>", f"<div class=ad>{junk}</div>", f"<form><label>{junk}</label></form>", f"<nav><ul>{rows}</ul></nav>", f"<div class='share-tools'><ul>{rows}</ul></div>"):
            for parts in ((extra, f"<p>{first}</p><p>{second}</p>"), (f"<p>{first}</p>", extra, f"<p>{second}</p>"), (f"<p>{first}</p><p>{second}</p>", extra)):
                if "share" in extra and n > 20:
                    continue  # a part of a name that holds most of the article's words says nothing
                for tag in ("article", "main"):
                    for weights in ({}, {"p": 2.0, "!aside": -3.0, "!div": -2.0, "<p": -0.5, "<li": -1.0}):
                        assert H.main_text(page(f"<{tag}>{''.join(parts)}</{tag}>"), weights) == f"{first} {second}", (extra[:30], n)


def test_parts_of_names_inside_the_article():
    """A part of a name marks no element that holds most of its section's words."""
    story = "<p>" + "All of this is the work of others. " * 5 + "</p>"
    text = ("All of this is the work of others. " * 5).strip()
    assert H.main_text(page(f"<article><section><h2>Before us</h2><div class='related-work'>{story}</div></section></article>"), {}) == "Before us " + text
    assert H.main_text(page(f"<article>{story}<div class='related-posts'><a href=/a>Another one</a></div></article>"), {}) == text
