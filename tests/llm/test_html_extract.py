import html
import random
import re

import pytest

from cinegrid.llm import html_extract
from cinegrid.llm.html_extract import extract, importances, parse

CASES = [
    (None, ""), ("", ""), ("plain text &amp; more", "plain text & more"),
    ("<body><nav>m</nav><p>a<br>b  <i>c</i>d</p>tail<footer>f</footer>", "a b cd\ntail"),
    ("<div class='ad'>x<article><h1>T &lt;1&gt;</h1><p>one<p class=ad>no<p>two<ul><li>f<li>g</ul></article>", "T <1>\none\ntwo\nf\ng"),
    ("<article><header><h1>T</h1></header><p>a</p><section class='comments'><p>bad</p></section><form>f</form><aside>z</aside>b</article><p>out", "T\na\nb"),
    ("<article><p>a<script>if (a<b) {'</p>'}</script>b<!-- <p>no --> c</p><style>p{}</style></article>", "a b c"),
    ("<main><table><tr><td>1<td>2</table><blockquote>q</blockquote></main><div id=cookie-notice>x</div>", "1\n2\nq"),
    ("<article><p>x <a href='a>b' title=\"<p>\">link</a> y</p></article", "x link y"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<article><p>" + "w &eacute; " * 30000 + "</p></article>", ("w é " * 30000).strip()),
    ("<article><h2 id='related-work'>Related work</h2><section id='social-history'>s</section><div class='search-results-analysis'>r</div><div class='share-buttons'>x</div><div id=comments>c</div><p>f(x) = <math><mi>y</mi></math></p></article>", "Related work\ns\nr\nf(x) = y"),
    ("<div class='search-results-analysis'>r</div><p>t <label>no</label></p><p>a&nbsp; b</p>", "t\na b"),
    ("<p>a < b and c > d</p><p hidden>h</p><div role=navigation>n</div>", "a < b and c > d"),
]


@pytest.mark.parametrize("parts", [1, 3])
def test_pages(spark, parts):
    rows = [(i, f"http://h{i}.com/", page) for i, (page, _) in enumerate(CASES)] + [(99, None, CASES[3][0]), (99, None, CASES[3][0])]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host").repartition(parts)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = CASES[r.page_id][1] if r.page_id < 99 else CASES[3][1]
        assert (r.text, r.n_chars) == (want, len(want)), r.page_id


def test_repeated_content_is_dropped_on_large_sites_only(spark):
    page = "<body><div class=top><p>Welcome to our site</p></div><div class=x><p>story {0} words {0}</p><p>more {0}</p></div><div class=end><p>All rights reserved</p></div>"
    rows = [(i, "http://big.com/a", page.format(i)) for i in range(40)] + [(100, "http://small.com/", page.format(7))]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "story 3 words 3\nmore 3"
    assert got[100] == "Welcome to our site\nstory 7 words 7\nmore 7\nAll rights reserved"


def test_importance_against_brute_force(spark):
    from collections import Counter
    from html.parser import HTMLParser
    from math import log

    class Tree(HTMLParser):
        """Blocks (path, text) and children (path, names) of well-formed pages of div, article and p."""

        def __init__(self):
            super().__init__()
            self.stack, self.blocks, self.elements, self.leaf = [((), [])], [], [], None

        def handle_starttag(self, tag, attrs):
            self.stack[-1][1].append(tag)
            if tag == "p":
                self.leaf = "p"
            else:
                self.stack.append(((*self.stack[-1][0], (tag, dict(attrs).get("class", ""))), []))

        def handle_endtag(self, tag):
            if tag == "p":
                self.leaf = None
            else:
                path, names = self.stack.pop()
                self.elements.append((path, tuple(names)))

        def handle_data(self, data):
            if data.strip():
                self.blocks.append((self.stack[-1][0], data.strip()))

    def entropy(counts):
        n = sum(counts.values())
        return 1.0 if n == 1 else (log(n) - sum(c * log(c) for c in counts.values()) / n) / log(n)

    rng = random.Random(3)
    rows, trees = [], {}
    for i in range(40):
        host = rng.choice(["a.com", "b.com"])
        page = "".join(f"<div class='{rng.choice('xy')}'>" + "".join(f"<p>{rng.choice(['same', 'alike', str(i)])}</p>" for _ in range(rng.randint(1, 3))) + "</div>" for _ in range(3))
        page += f"<div class=my-search-view><p>{rng.choice(['one', 'two', str(i)])}</p></div><article><p>{rng.choice(['same', f'story {i}'])}</p></article>"
        rows.append((f"http://{host}/", page))
        t = Tree()
        t.feed(page)
        trees.setdefault(host, {})[page] = t
    want = Counter()
    for host, pages in trees.items():
        content, shown = {}, {}
        for t in pages.values():
            for path, text in t.blocks:
                content.setdefault(path, Counter())[text] += 1
            for path, names in t.elements:
                shown.setdefault(path, Counter())[names] += 1
        for path, counts in content.items():
            times = min(sum(counts.values()), len(pages))
            shows = 0.1 * entropy(shown[path]) + 0.9 * entropy(counts)
            want[host, round((times * shows + 3 * (path[0][1] != "my-search-view")) / (times + 3), 9)] += 1
    df = spark.createDataFrame(rows, "url string, html string").selectExpr("substring(url, 8, 5) as host", "html")
    assert Counter((r.host, round(r.importance, 9)) for r in importances(df).collect()) == want


def test_suspects_are_judged_by_their_site(spark):
    page = "<body><div class=search-results-analysis><p>finding {0}</p></div><p>text {0}</p></body>"
    rows = [(i, "http://big.com/a", page.format(i)) for i in range(40)] + [(100, "http://small.com/", page.format(7)), (101, None, page.format(8))]
    rows += [(200 + i, "http://same.com/a", page.replace("finding {0}", "all you can find").format(i)) for i in range(40)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "finding 3\ntext 3" and got[100] == "text 7" and got[101] == "text 8" and got[203] == "text 3"


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_one_page_are_no_template(spark):
    page = "<article><p>the same story on a mirrored page</p></article>"
    rows = [(i, "http://big.com/a", page) for i in range(30)]
    assert {r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"the same story on a mirrored page"}


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        article = source[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p)


def test_hostile_markup_is_linear():
    parse("<a '" * 20000), parse("<" * 50000), parse("<!--" * 20000), parse("</div>" * 20000), parse("<script>" * 5000)
    assert parse("")[0] == []


@pytest.mark.parametrize("name", html_extract.MUTED)
def test_unclosed_muted_elements_lose_no_block(name):
    def got(page):
        return html_extract.main_text(html_extract.parse(page)[0], set(), True)

    assert got(f"<article><p>First.</p><{name}>x<p>Second.</p></article>") == "First.\nSecond."
    assert got(f"<article><p>One <{name} a='>'>x</{name}> two.</p><{name}>y<p>Three.</p><{name}>z</{name}><p>Four.</p></article>") == "One two.\nThree.\nFour."
    assert got(f"<article><p>One <{name}/> two.</p><search><p>Find</p></search></article>") == "One two."
