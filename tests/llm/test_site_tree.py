import math
import re
import time
from html import unescape

from feedweave.llm import site_tree as st

PAGES = "page_id long, url string, html string, host string, noise string, text string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def texts(spark, rows, **kw):
    return {r.page_id: r.text for r in st.extract_text(table(spark, rows), **kw).collect()}


def test_unnamed_boilerplate_goes_by_entropy(spark):
    """No class or tag tells it: boxes repeated over the pages of a host go, the host's articles stay; copies of a page too."""
    rows = []
    for h in ("a.example", "b.example:8080"):
        for k in range(60):
            own = f"Story {k if k % 10 else 0} of {h}"
            rows.append((
                len(rows), f"https://User@{h}/p{k}",
                f"<html><body><div class=x1><p>Welcome to {h}<ul><li>Home<li>About</ul></div><section><h2>{own}</h2><p>Text&nbsp;&amp; more {own}<p>end</section>"
                f"<div class=x2>Tip number {k % 6}</div></body></html>",
            ))
    got = texts(spark, rows)
    for i, url, html in rows:
        own = re.search("<h2>(.*?)</h2>", html)[1]
        assert got[i] == f"{own}\nText & more {own}\nend"


def test_hosts_of_one_page_keep_all_but_noise_by_role(spark):
    """Whatever else the table holds."""
    page = lambda k: f"<body><div class=top>Menu</div><nav>links</nav><main><p>unique {k}</p></main></body>"
    rows = [(k, f"http://h{k}.example/", page(k)) for k in range(30)]
    assert texts(spark, rows) == {k: f"Menu\nunique {k}" for k in range(30)}
    assert texts(spark, rows[:1]) == {0: "Menu\nunique 0"}


def test_names_of_the_frame_and_of_what_holds_the_article(spark):
    """A name with a noise word in it removes no page."""
    blocks = lambda s: [t for _, t in st.Page(s).blocks]
    frames = [
        "<body class='home no-sidebar'><p>{}</p></body>", "<body class=sidebar><p>{}</p></body>", "<div class='content has-comments'><p>{}</p></div>",
        "<main class='with-menu'><p>{}</p></main>", "<article class='post related-tag-news'><p>{}</p></article>",
        "<div class=page-with-ads><div class=widget-area><article><p>{}</p></article></div></div>", "<div class=menu><main><p>{}</p></main></div>",
    ]
    assert all(blocks(f.format("story")) == ["story"] for f in frames)
    assert blocks("<div class=comments><article class=comment-body>rude</article></div><div class=site-footer>f</div><div id=cookie-notice>c</div>ok") == ["ok"]
    assert blocks("<div class=widget-area>before<article><p>story</article>after</div>") == ["before", "story", "after"]
    rows = [(k, f"http://theme.example/{k}", frames[0].format(f"story {k}")) for k in range(60)]
    assert texts(spark, rows) == {k: f"story {k}" for k in range(60)}


def test_hostile_pages_take_linear_time():
    for part in ('<p "', "<div>", "<li>", "<ul><li>", "<p '>", "<!", "<!-- ", "</div>", "<table><tr><td>", "<div class='a-b' \"", "<td>"):
        start = time.perf_counter()
        st.Page(part * (1_000_000 // len(part)))
        assert time.perf_counter() - start < 5, part


def test_importance_is_the_entropy_of_the_paper(spark):
    rows = [(k, "http://one.example/", f"<body><div><p>{t}</p></div></body>") for k, t in enumerate("aaab")]
    node = st.style_trees(table(spark, rows)).filter("host is not null and content is not null").first()
    assert node.path == "/body/div" and math.isclose(node.content, 1 - (math.log(3) / math.log(4) + 0) / 2)


def test_roles_and_markup():
    blocks = lambda s: [t for _, t in st.Page(s).blocks]
    assert blocks("<header>site</header><article><header><h1>T</h1></header><p>a<p>b<br>c</article><footer>f</footer>") == ["T", "a", "b c"]
    assert blocks("<p>x<script>if (a<b) '</p>'</script>y<style>p{}</style>z<!-- <p>no --><p>w") == ["xyz", "w"]
    assert blocks("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert blocks("<table><tr><td>a<td>b<tr><th>c</table>") == ["a", "b", "c"]
    assert blocks('<div class="comment-list"><p>rude</p></div><div id=Ads>buy</div><form><p>q</p></form><p>ok</p>') == ["ok"]
    assert blocks("a < b &lt;i&gt; &amp;amp; &copy; &#233; &bogus; <b>bold</b>er") == ["a < b <i> &amp; © é &bogus; bolder"]
    assert blocks('<p title="a>b">x</p><p class=\'y>z</p>') == ["x", "z"]
    assert blocks("") == blocks("<>") [1:] == blocks("<!-- never closed <p>x") == []
    assert blocks("<script>never closed <p>x") == []
    assert blocks("  \n one \t two three ") == ["one two three"]


def test_awkward_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 10
    long = "<p>" + "word " * 100_000
    rows = [(1, None, None), (2, "not a url", ""), (None, "http://x.example", "<p>no id</p>"), (4, "http://x.example", deep), (5, "http://x.example", long), (4, "http://x.example", deep)]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in st.extract_text(table(spark, rows)).collect()), key=str)
    want = [(1, None, "", 0), (2, "not a url", "", 0), (None, "http://x.example", "no id", 5), (5, "http://x.example", ("word " * 100_000).strip(), 499_999)]
    assert [r for r in got if r[0] != 4] == sorted(want, key=str)
    assert sum(r[0] == 4 for r in got) == 2
    assert st.extract_text(table(spark, [])).count() == 0


def test_copies_of_pages_keep_their_text(spark):
    page = lambda k: f"<body><div class=x1>Same for all</div><section><p>story {k}</p></section></body>"
    rows = [(k, f"http://one.example/{k}", "<body><p>all the same</body>") for k in range(60)]
    rows += [(100 + k, f"http://ten.example/{k}", page(k % 10) + f"<!-- {k} -->") for k in range(1000)]
    rows += [(2000 + k, f"http://mirror{k}.example/", "<body><main>mirrored</main></body>") for k in range(60)]
    rows += [(3000 + k, "http://x.example", "<div>" * 3000 + "deep") for k in range(2)]
    got = texts(spark, rows)
    assert all(got[k] == "all the same" for k in range(60)) and all(got[2000 + k] == "mirrored" for k in range(60))
    assert all(got[100 + k] == f"story {k % 10}" for k in range(1000))
    assert got[3000] == got[3001] == "deep"


def test_small_hosts_do_not_depend_on_others(spark):
    """Hosts of 2 to 49 pages lose their own boxes and keep articles with a shared line, alone or among other hosts."""
    page = lambda h, k: f"<body><div class=box{h}><p>About {h}</div><section><p>story {k} of {h}<p>The end</section></body>"
    rows = [(100 * h + k, f"http://small{h}.example/{k}", page(h, k)) for h in (2, 3, 6, 15, 49) for k in range(h)]
    others = [(10_000 + k, f"http://other{k // 2}.example/{k}", f"<body><div class=o{k}>other {k}</div><section>text {k}</section></body>") for k in range(3000)]
    want = {i: f"story {i % 100} of {i // 100}\nThe end" for i, _, _ in rows}
    assert texts(spark, rows) == want
    got = texts(spark, rows + others)
    assert {i: got[i] for i in want} == want


def test_nesting_of_any_depth(spark):
    """Unnamed boxes beside an article are told from it however deep both are."""
    page = lambda k, d: "<body>" + "<div>" * d + f"<div class=x1>Same for all</div><section><p>story {k}</p></section>" + "</div>" * d
    rows = [(100 * d + k, f"http://deep{d}.example/{k}", page(k, d)) for d in (1, 11, 40, 400) for k in range(60)]
    assert texts(spark, rows) == {i: f"story {i % 100}" for i, _, _ in rows}
    paths = [p for p, _ in st.Page("<div class=abc>" * 2000 + "x<p>y" + "<div>z").blocks]
    assert paths[0] == paths[1] != paths[2] and max(map(len, paths)) < 600


def test_whole_table_of_pages(spark):
    """The text between the article tags, by plain replacement."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in st.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.sub("</?(h1|p|br)>", "\n", re.sub("</?b>", "", re.search("<article>(.*)</article>", r.html, re.S)[1]))
        want = "\n".join(t for t in (" ".join(unescape(line).split()) for line in inner.split("\n")) if t)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)
