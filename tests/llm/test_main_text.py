import html
import random
import re

import pyspark.sql.functions as F

from tracekit.llm import main_text as M

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header class="site"><h1>Brand</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad-slot">Buy this now please today</div>
<main><article><header class="entry-header"><h1>Head&#108;ine &lt;x&gt;</h1></header><p>First   <b>bold</b>&nbsp;part
of it.<br>after the break<p>Unclosed one<p>Second &copy; <a href="x">linked</a> words.</p><aside>side words here</aside><div class="cookieNotice">we use</div>
<form><input><button>Send</button></form><ul><li>item one</li><li>item two</li></ul><section id="comments"><p>A reader says</p></section><ol class="commentlist"><li>Me too</li></ol></article></main>
<div class="sidebar"><p>other things to read</p></div><footer>(c) me</footer></body></html>"""
WANT = "Headline <x>\nFirst bold part of it.\nafter the break\nUnclosed one\nSecond © linked words.\nitem one\nitem two"


def test_page_without_boilerplate(spark):
    weights = M.fit(spark.createDataFrame([(i, PAGE) for i in range(6)], "page_id long, html string"))
    assert weights["n:ad-slot"] < -1 < weights["w:p"]
    assert M.extract(PAGE, weights) == WANT
    assert M.extract(PAGE, {}) == WANT


def test_region_is_found_without_a_container():
    page = "<body><div><a>x</a><a>y</a><a>z</a></div><div><p>" + "long text here " * 10 + "</p><p>more of it</p></div><table><tr><td><a>l</a></td><td><a>m</a></td></tr></table></body>"
    assert M.extract(page, {"t:a": -3.0, "t:td": -3.0, "t:div": -1.0, "t:p": -0.1}) == ("long text here " * 10).strip() + "\nmore of it"


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a"), (4, "u", "<div"), (5, "u", "plain &amp words"), (6, "u", "<script>x"), (7, "u", "<p>" * 3000 + "deep"), (8, "u", "<!-- a <p>b</p>"), (1, "u", None), (9, "u", "<p>a < b and c > d</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in M.main_text(df, M.fit(df)).collect())
    assert got == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "", 0), (4, "<div", 4), (5, "plain & words", 13), (6, "", 0), (7, "deep", 4), (8, "", 0), (9, "a < b and c > d", 15)]
    assert M.main_text(df.limit(0), {}).count() == 0
    assert M.fit(df.limit(0)) == {}


def marked(page):
    """The text of the given pages' container by their own simple layout."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|br|h1|ul|li)>", body)
    return "\n".join(x for b in blocks if (x := " ".join(html.unescape(re.sub(r"</?b>", "", b)).split())))


def test_whole_table_against_the_marked_container(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = M.main_text(pages, M.fit(pages)).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(got) == pages.count()
    for r in got:
        assert r.text == marked(r.html)


def test_held_out_pages_that_mark_nothing(spark):
    """Weights from half of the pages find the articles of the other half, whose containers have become plain divisions and
    whose boilerplate has names that no list holds but that the first half has shown."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    pages = pages.withColumn("html", F.replace("html", F.lit('class="ad"'), F.lit('class="xq-zone"')))
    weights = M.fit(pages.where("page_id % 2 = 0"))
    assert weights["n:xq-zone"] < -1
    rest = pages.where("page_id % 2 = 1").withColumn("bare", F.replace(F.replace("html", F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>")))
    got = M.main_text(rest.select("page_id", "url", "bare"), weights, html_col="bare").join(rest.select("page_id", "html"), "page_id").collect()
    assert len(got) > 50 and all(r.text == marked(r.html) for r in got)


def test_scan_finds_the_largest_sum():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randrange(25))]
        best, low, high = M.best_run(scores)
        assert best == max([sum(scores[i:j]) for i in range(len(scores) + 1) for j in range(i, len(scores) + 1)]) == sum(scores[low:high])


def test_what_belongs_to_an_article_stays():
    cases = {
        '<div class="content has-sidebar"><article><p>one two three</p></article></div>': "one two three",
        '<div class="sidebar-wrapper"><main><p>one two three</p></main></div>': "one two three",
        '<article><p>a b c d</p><section class="related-work"><p>e f g h</p></section><p class="legal">i j k</p><section class="commentary">l m n</section></article>': "a b c d\ne f g h\ni j k\nl m n",
        "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> and <svg><desc>no</desc><text>label</text></svg> end</p></article>": "so x=2 and label end",
        "<p>abc def <![CDATA[bcdef": "abc def bcdef",
        "<p>abc def <![CDATA[bc]]> def": "abc def bc def",
        '<main><article><p>the article itself here</p></article></main><div id="comments"><article class="comment"><p>me too</p></article></div>': "the article itself here",
    }
    for page, want in cases.items():
        assert M.extract(page, {}) == want


def test_very_long_page():
    page = "<nav>" + "<a>x</a>" * 1000 + "</nav><article>" + "<p>some words of a text</p>" * 50_000 + "</article>"
    assert M.extract(page, {}) == "\n".join(["some words of a text"] * 50_000)


def test_names_of_an_articles_own_parts_are_not_boilerplate():
    page = """<body><article><h1>Title</h1><h2 id="the-notice-period">Notice</h2><p>one two three</p><h2 id="related-work">Related</h2><p id="search">four five</p><p class="advert">Buy</p><div class="post-navigation">Next</div>
<section class="commentary"><p>six seven</p></section><div class="cookie-recipe"><p>eight nine</p></div><h3 id="search-and-replace">Ten</h3><p>eleven</p>
<div class="share-buttons">Post it</div><div class="related-posts"><p>Other pages</p></div><div id="newsletter"><p>Sign up</p></div><p>end</p></article></body>"""
    want = "Title\nNotice\none two three\nRelated\nfour five\nsix seven\neight nine\nTen\neleven\nend"
    assert M.extract(page, {}) == want


WEIGHTS = {"w:td": 0.1, "w:li": 0.1, "w:p": 1.0, "t:td": -3.0, "t:tr": -3.0, "t:li": -3.0, "t:a": -3.0, "t:p": -0.1}


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_tables_and_lists_do_not_cut_an_article():
    rows = "".join(f"<tr><td>r{i}</td><td>v{i}</td></tr>" for i in range(60))
    links = "".join(f'<li><a href="#">l{i}</a></li>' for i in range(80))
    code = "<pre>" + "\n".join(f"<a>c{i}</a>" for i in range(40)) + "</pre>"
    for middle, inside in ((f"<table>{rows}</table>", "r30"), (f"<ul>{links}</ul>", "l40"), (code, "c20")):
        page = f"<body><nav><a>menu</a></nav><div><a>Home</a><a>Login</a></div><article><p>{words('a', 50)}</p>{middle}<p>{words('b', 60)}</p></article><div><p>Short end.</p></div></body>"
        got = M.extract(page, WEIGHTS)
        assert "a0 " in got and "a49" in got and "b59" in got and inside in got and "menu" not in got and "Login" not in got


def test_names_inside_an_article():
    text = f"<p>{words('w', 60)}</p>"
    for called in ('class="ad_300x250"', 'class="in-article-ad"', 'class="google-ads"', 'class="sponsored-content"', 'class="cookie-banner-v2"', 'class="newsletter-cta"', 'class="article-comments"', 'class="user-comments"', 'class="comment-body"', 'id="disqus_thread"'):
        assert M.extract(f"<article>{text}<div {called}><p>{words('x', 40)}</p></div>{text}</article>", {}).count("x3") == 0, called
    for called in ('<section id="search">', '<section class="social">', '<div class="legal">', '<div class="widget">', '<div class="share">', '<div class="cookie-recipe">', '<section class="commentary">'):
        end = called.split()[0].replace("<", "</") + ">"
        assert "share price fell" in M.extract(f"<article>{text}{called}<p>The share price fell {words('y', 30)}</p>{end}{text}</article>", {}), called
    for called, inner in (("share", '<a href="#">Tweet this now please</a> <a href="#">Post</a>'), ("search", "<input> Search our very large archive"), ("widget", "Weather today"), ("social", f'<a href="#">{words("z", 50)}</a>')):
        got = M.extract(f'<article>{text}<div class="{called}">{inner}</div>{text}</article>', {})
        assert len(got.split()) == 120, called


def test_comments_and_stray_tags_are_linear():
    import time

    assert M.extract("<article><p>one two</p><!-- x --!><p>three</p><!--><p>four</p><!---><p>five</p></article>", {}) == "one two\nthree\nfour\nfive"
    for make in (lambda n: "<div>" * n + "word " + "</b>" * n, lambda n: "<b>" * n + "<div>word</div>" * n, lambda n: "<div class=share>" * n + "word" + "</span>" * n):
        took = []
        for n in (4000, 16000):
            began = time.perf_counter()
            M.extract(make(n), {})
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0] + 0.2
