"""Main text of pages: markup cases, tree matching against brute force, and templates of a host."""

import random
import time
from functools import cache

from quire.llm import html_text
from quire.llm.html_text import extract, match, skeleton

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{a:b}</style><script>var t="</p><p>no</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad > 7 <p>no</p> --><div class="ad">Buy</div>
<div id="cookie-notice">We use cookies</div><main><article class="post"><header><h1>Title &amp; more</h1></header><p>One <b>bold</b> &eacute;&nbsp;&#8211;
 two<br>three<p><b>Open four<br><p>Five</p><ul><li>six<li>seven</ul><div class="share">Share</div><form>Your name <input name=a></form>
<aside>Side</aside><table><tr><td>a<td>b</table>tail</article><section class="comments"><article><p>I disagree at great length, dear author</p></article></section></main>
<div class="sidebar"><p>More</p></div><footer>&copy; Host</footer>"""


def test_article_without_the_rest():
    assert extract(PAGE) == "Title & more\nOne bold é – two three\nOpen four\nFive\nsix\nseven\na\nb\ntail"


def test_odd_markup():
    assert extract("") == ""
    assert extract("plain &lt;text&gt; & more") == "plain <text> & more"
    assert extract("<p>a < b and 3<4</p>") == "a < b and 3<4"
    assert extract("<script>never closed <p>x") == ""
    assert extract("<!-- never closed <p>x") == ""
    assert extract("<div><p>a</div>b</p></b>c") == "a\nb\nc"
    assert extract("<p hidden>x</p><p style='display:none'>y</p><p>z</p>") == "z"
    assert extract("<article><p>short</p></article><article><p>the longer article</p></article>") == "the longer article"
    assert len(extract("<p>" * 20_000 + "x" * 200_000)) == 200_000
    assert extract("<div>" * 20_000 + "deep") == "deep"


def test_hidden_is_an_attribute_not_a_word():
    for a in ('class="overflow-hidden"', "class=hidden-print", 'style="overflow:hidden"', 'title="hidden gems"', 'title="a hidden b"', "hidden=false", 'data-hidden="x"', "title='display:none'"):
        for tag in ("p", "div", "article", "main", "body"):
            assert extract(f"<{tag} {a}>kept</{tag}>") == "kept", (tag, a)
    for a in ("hidden", "HIDDEN", 'hidden=""', "class=x hidden", 'hidden="until-found"', "aria-hidden=true", 'aria-hidden="true"', "style='color:red; DISPLAY: None'", "style=display:none"):
        assert extract(f"<div {a}>lost</div><p>z</p>") == "z", a


def test_names_made_from_text_are_no_chrome():
    for start in ('<h2 id="discussion">', '<h2 id="social-and-economic-impact">', '<p id="share-prices">', '<span id="search-1">', '<h2 id=alert>', '<h3 id="comments">', '<a id="menu">'):
        end = f"</{start[1:].split()[0]}>"
        assert extract(f"<article><p>a</p>{start}b{end}<p>c</p></article>").split() == ["a", "b", "c"], start
        assert extract(f"<p>a</p>{start}b{end}<p>c</p>").split() == ["a", "b", "c"], start
    for start in ('<section id="related-work">', '<section id="discussion">', '<div class="section" id="search">', '<section aria-label="Discussion">', '<div class="has-sidebar">', '<div class="content-sidebar-wrap">'):
        end = f"</{start[1:].split()[0]}>"
        assert extract(f"<main><p>a</p>{start}<p>b</p>{end}</main>") == "a\nb", start
    assert extract('<article id="comment-on-the-budget">a</article>') == "a"


def test_whole_names_and_known_compounds_are_chrome():
    for a in ('class="x ad"', 'class="ad-slot-1"', "class=article-footer", 'class="share-buttons"', 'role="navigation"', 'class="related-posts"', 'class="nav__item"', 'id="comments"', 'id="ad-slot-1"', 'id="cookie-notice"', 'class="sidebar-right"', 'aria-label="Comments"'):
        assert extract(f"<main><p>a</p><div {a}>lost</div></main>") == "a", a
    for a in ('id="sidebar"', 'id="site-footer"', 'class="site-header"', 'id="search"', 'aria-label="Cookie consent"', 'id="related-articles"'):
        assert extract(f"<div><p>a</p></div><div {a}>lost</div>") == "a", a
    assert extract('<p>a</p><article id="div-comment-5" class="comment-body">lost</article><article id=comment-7>lost</article>') == "a"


def test_a_small_article_is_not_the_page():
    assert extract('<main><div>a long story of many words</div><article class="teaser">two lines</article></main><p>x</p>') == "a long story of many words\ntwo lines"
    assert extract("<div>a long story of many words</div><article>two lines</article>") == "a long story of many words\ntwo lines"
    assert extract("<main><article>a story of many words</article><div>short</div></main><p>x</p>") == "a story of many words"
    assert extract("<main>a story of many words</main><article>two lines</article>") == "a story of many words"
    assert extract("<main>short</main><article>two lines</article><p>some more words</p>") == "short\ntwo lines\nsome more words"


def test_sibling_articles_of_a_host_are_kept(spark):
    rng = random.Random(3)

    def part(k):
        return " ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(4, 40))) + f" {k}"

    rows, want = [], {}
    for k in range(12):
        a, b = part(k), part(k)
        want[k] = f"{a}\n{b}"
        rows.append((k, f"http://a.example/{k}", f"<body><p>Read our paper</p><div><article><p>{a}</p></article><article><p>{b}</p></article></div><p>{k}</p></body>"))
    got = html_text.page_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.main_text for r in got} == want


def brute(a, b):
    """Most nodes that two trees can share by order and labels."""
    def kids(t):
        out = [[] for _ in t[0]]
        for k in range(1, len(t[0])):
            out[t[1][k]].append(k)
        return out

    ka, kb = kids(a), kids(b)

    @cache
    def w(i, j):
        if a[0][i] != b[0][j]:
            return 0
        x, y = ka[i], kb[j]
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for p in range(1, len(x) + 1):
            for q in range(1, len(y) + 1):
                m[p][q] = max(m[p - 1][q], m[p][q - 1], m[p - 1][q - 1] + w(x[p - 1], y[q - 1]))
        return 1 + m[-1][-1]

    return w(0, 0)


def tree(rng):
    n = rng.randint(1, 14)
    return [0] + [rng.randint(1, 3) for _ in range(n)], [-1] + [rng.randint(0, k) for k in range(n)]


def test_matching_is_as_large_as_can_be_and_keeps_parents():
    rng = random.Random(1)
    for _ in range(400):
        a, b = tree(rng), tree(rng)
        pairs = match(a, b)
        assert len(pairs) == brute(a, b) == len(set(pairs.values()))
        assert all(a[0][i] == b[0][j] and (i == 0 or pairs[a[1][i]] == b[1][j]) for i, j in pairs.items())


def test_what_all_pages_of_a_host_share_is_template(spark):
    rng = random.Random(2)
    words = "river stone bridge quiet seven lamp".split()

    def page(k):
        text = "".join(f"<p>{' '.join(rng.choice(words) for _ in range(12))} {k}</p>" for _ in range(rng.randint(1, 6)))
        return f"<body><div class=x>Read our paper every day</div><div><h2>Story {k}</h2>{text}</div><p>All rights kept</p></body>"

    rows = [(k, f"http://a.example/{k}", page(k), "x") for k in range(20)]
    copies = [(100 + k, "http://b.example/same", "<p>Common line</p><p>same story</p>", "x") for k in range(30)]
    odd = [(200, None, None, "x"), (201, "not a url", "", "x"), (201, "not a url", "", "x"), (202, "http://c.example/", "<p>Common line</p>", "x"), (None, "http://%%/", "<p>é</p>", None)]
    df = spark.createDataFrame(rows + copies + odd, "page_id long, url string, html string, host string")
    got = html_text.page_text(df)
    assert got.columns == [*df.columns, "main_text"] and got.count() == len(rows + copies + odd)
    for r in got.collect():
        if r.page_id is not None and r.page_id < 20:
            assert r.main_text == extract(r.html).removeprefix("Read our paper every day\n").removesuffix("\nAll rights kept")
            assert r.main_text.startswith(f"Story {r.page_id}\n")
        else:
            assert r.main_text == extract(r.html or "")
    assert html_text.page_text(df.limit(0)).count() == 0


def test_skeletons_of_equal_pages_are_equal():
    assert skeleton(PAGE) == skeleton(PAGE) and len({len(x) for x in skeleton(PAGE)}) == 1


def test_markup_in_quotes_and_deep_or_broken_pages_take_linear_time():
    assert extract('<p a="x>y">attr</p><p b=\'<b>\' c=it\'s>gt</p>') == "attr\ngt"
    assert extract('<p a="never closed>x</p><p>y</p>').endswith("y")
    start = time.time()
    n = 40_000
    for page in ("<b>" * n + "</i>" * n, "<b>" * n + "<article>" + "<i>" * n + "</b>" * n, '<a b="' * n, "<i>" * n + "<p></p>" * n, "<a " * n, "<!-- " * n):
        extract(page)
    assert time.time() - start < 20
    a, b = skeleton("<div>" * 10_000 + "<p>a"), skeleton("<div>" * 9_000 + "<p>b</p>" + "<div>" * 1_000 + "c")
    assert len(match(a[:2], b[:2])) == 10_001


def story(rng, k):
    return [" ".join(rng.choice("river stone bridge quiet seven lamp under water".split()) for _ in range(rng.randint(6, 30))) + f" {k}." for _ in range(rng.randint(2, 9))]


def site(rng, k, wrap):
    """A page and its text: a menu of varying links, an advert, the story, reader links; no tag or name says which is which."""
    link = lambda: f'<li><a href="/{rng.randrange(99)}">{rng.choice(["Home", "News", "Sport", "Money"])} {rng.randrange(99)}</a></li>'
    text = story(rng, k)
    body = "".join(f"<p>{t}</p>" for t in text)
    page = f"<body><div class=a><ul>{''.join(link() for _ in range(5))}</ul></div><div class=b>Buy {rng.randrange(999)}</div>{wrap[0]}<h1>Story {k}</h1>{body}{wrap[1]}<div class=c><ul>{link()}{link()}</ul></div><div>Same line</div></body>"
    return page, "\n".join([f"Story {k}", *text])


def test_the_wrapper_alone_finds_the_content(spark):
    """Without declared parts: every page against the story it was made of."""
    rng = random.Random(7)
    rows, want = [], {}
    for host, wrap in (("a.example", ("<div class=main>", "</div>")), ("b.example", ("<section><div>", "</div></section>"))):
        for k in range(20):
            page, text = site(rng, k, wrap)
            want[host, k] = text
            rows.append((k, f"http://{host}/{k}", page))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.url.split("/")[2], r.page_id): r.main_text for r in html_text.page_text(df, declared=False).collect()}
    assert got == want
    few = html_text.page_text(df, declared=False, least=50).collect()
    assert all("Same line" in r.main_text for r in few)


def plain_wrapper(trees, least):
    """The wrapper of one host from whole trees in memory: brute force over every reference node."""
    ref = trees[0]
    aligned = [match(t[:2], ref[:2]) for t in trees]
    constant = set()
    for j in range(len(ref[0])):
        texts = [t[2][i] for t, pairs in zip(trees, aligned, strict=True) for i, at in pairs.items() if at == j and t[2][i]]
        if len(texts) >= least and texts.count(ref[2][j]) >= html_text.CONSTANT * len(texts):
            constant.add(j)
    return constant


def test_template_nodes_equal_brute_force(spark):
    rng = random.Random(9)
    pages = [site(rng, k, ("<div>", "</div>"))[0] for k in range(15)]
    pages += [p.replace("Same line", "Other line") for p in pages[:1]]
    rows = [("h", k, 0, tuple(skeleton(p, False))) for k, p in enumerate(pages)]
    trees = spark.createDataFrame(rows, f"host string, h1 long, h2 long, tree struct<{html_text.SKELETON.replace(' array', ': array')}>")
    got = html_text.templates(trees).collect()
    assert len(got) == 1 and set(got[0].template) == plain_wrapper([skeleton(p, False) for p in pages], html_text.MIN_PAGES) != set()


def test_query_contract(spark, tmp_path):
    from quire.llm import queries

    rows = [(1, "http://a/1", PAGE), (2, None, None), (3, "http://a/3", "<p>\U0001f389 x</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op6_html_text(spark, str(tmp_path))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert {r.page_id: (r.text, r.n_chars) for r in got.collect()} == {1: (extract(PAGE), len(extract(PAGE))), 2: ("", 0), 3: ("\U0001f389 x", 3)}
