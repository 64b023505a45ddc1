import random
import time

import pytest

from capstrata.llm import htmltext as X

text = lambda html: X.main_text(X.parse(html), set())


@pytest.mark.parametrize("html,want", [
    ("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("a<b>b</b>c<br>d", "abc d"), ("<p> x \n\t y&nbsp;z </p>", "x y z"),
    ("<article><p>&lt;tag&gt; &amp;amp; &#233;&#xe9; &eacute &am &copy;</p>", "<tag> &amp; éé é &am ©"),
    ("<nav>menu</nav><article><h1>T</h1><p>one</p></article><footer>f</footer>", "T one"),
    ("<body><header>site</header><main><header><h1>T</h1></header><p>x</p><aside>s</aside></main></body>", "T x"),
    ("<article><p>x</p><form>send <input></form><script>var a='<p>no</p>';</script><style>p{}</style></article>", "x"),
    ("<article>x<script>never closed <p>y", "x"), ("<!-- c <p>no</p> --><p>a<!-- d -->b</p><!-- open", "ab"),
    ("<article><p>x</p><section class='comments'><article><p>reader</p></article></section></article>", "x"),
    ("<div id=cookie-notice>ok?</div><div class='post'><p>x</p></div><div class='sidebar-right'>s</div>", "x"),
    ("<div class=ad>buy</div><p>x</p><div role=banner>b</div><p hidden>h</p><p style='display: none'>n</p>", "x"),
    ("<div class='page no-sidebar ad-free'><h1>T</h1><p>x</p><div class='sidebar'>s</div></div>", "T x"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("<P CLASS=\"a>b\">x</P >y", "x y"), ("<p>a < b and c > d</p>", "a < b and c > d"), ("</p></div>x", "x"), ("<p>x<", "x<"), ("<a href='x>y", "y"),
    ("<head><title>T</title></head><body>x", "x"), ("<template>t</template><noscript>n</noscript>x<svg><text>v</text></svg>", "x"),
])
def test_main_text(html, want):
    assert text(html) == want


@pytest.mark.parametrize("html,want", [
    ("<main><h1>T</h1><p>the text</p><article class=card><h3>other</h3></article><article class=card><h3>more of it</h3></article></main>", "T the text other more of it"),
    ("<body><div><p>a long text of its own</p></div><article>short</article></body>", "a long text of its own short"),
    ("<div><p>a long text of its own</p></div><div class='post'>card</div>", "a long text of its own card"),
    ("<body><div>welcome to the site</div><article><h1>T</h1>x</article></body>", "T x"),
    ("<body><div>site</div><article>one one</article><article>two two</article></body>", "one one two two"),
    ("<main><div>intro</div><article>all of the text</article></main><div>a very long list of other things on this site</div>", "all of the text"),
])
def test_region_holds_the_text(html, want):
    assert text(html) == want


def test_deep_and_long_pages():
    assert text("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    words = " ".join(f"w{i}" for i in range(100000))
    assert text(f"<article><p>{words}</p></article>") == words
    assert text("<a b=\"" * 2000) is not None


def test_work_grows_with_the_page():
    """Stray tags, deep cards and headlines in megabytes: each took a time that grows with the square of the page."""
    n = 100000
    start = time.perf_counter()
    assert text("<div>" * n + "x" + "</foo>" * n) == "x"
    assert text("<b><table>" + "<div>" * n + "x" + "</b>" * n) == "x"
    assert text("<div>" * n + "<article>card</article>" * n + "</div>" * n + "<h1>T</h1>") == "card " * n + "T"
    assert text("<h1>T</h1>" * n + "<article>card</article>" * n) == "T " * n + " ".join(["card"] * n)
    assert time.perf_counter() - start < 60


def pages(seed):
    """Two sites with templates of their own, in elements that no name gives away; a third, small site."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = " ".join(word() for _ in range(30))
    out = []
    for site, n in (("one.example", 40), ("two.example", 25), ("small.example", 3)):
        top, end = f"Welcome to {site}", f"About {site} and its makers"
        for i in range(n):
            body = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(3)]
            if i % 2:
                body.insert(1, shared)
            paragraphs = "".join(f"<p>{b}</p>" for b in body)
            inner = f"<article>{paragraphs}<div class=x1>Read more from {site}</div></article>" if i % 3 else paragraphs
            html = f"<html><body><div><span>{top}</span></div>{inner}<div><p>{end}</p></div></body>"
            want = " ".join(body)
            if site == "small.example":
                want = " ".join([*body, f"Read more from {site}"]) if i % 3 else " ".join([top, *body, end])
            out.append((len(out), f"https://user@{site}:80/p{i}", html, want))
    return out


def test_templates_are_counted_per_host(frame):
    rows = pages(0)
    df = frame([(i, u, h, "old") for i, u, h, _ in rows] + [(500, None, None, "old"), (501, None, "<p>x</p>", "old"), (0, rows[0][1], rows[0][2], "old")], "page_id long, url string, html string, text string")
    got = X.extract_text(df, "page_id", "url", "html")
    assert got.columns == ["page_id", "url", "html", "text"]
    found = sorted((r.page_id, r.text) for r in got.collect())
    assert found == sorted([(i, w) for i, _, _, w in rows] + [(500, ""), (501, "x"), (0, rows[0][3])])


def test_templates_of_short_pages_and_hot_hosts(frame):
    def page(i):
        menu = "<div><p>menu of the news section</p></div>" if i % 6 == 0 else ""
        body = "x" if i == 0 else " ".join(f"w{i}v{k}" for k in range(20))
        return f"<body>{menu}<div><span>see our notice</span></div><p>{body}</p></body>", body
    made = [page(i) for i in range(360)]
    df = frame([(i, "https://hot.example/p", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in X.extract_text(df, "page_id", "url", "html").collect()}
    assert got == {i: body for i, (_, body) in enumerate(made)}


def test_empty(frame):
    assert X.extract_text(frame([], "page_id long, url string, html string"), "page_id", "url", "html").collect() == []
