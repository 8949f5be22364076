import json
import re

import pytest

from dockside.llm import html_extract
from dockside.llm.html_extract import extract_text

PAGE_TYPE = "page_id long, url string, html string, host string, text int, wrapper string"


@pytest.fixture(scope="module")
def extract(spark):
    def run(rows):
        frame = spark.createDataFrame([(*r, "h", 1, "w") for r in rows], PAGE_TYPE).repartition(3)
        return {r.page_id: r for r in extract_text(frame).collect()}

    return run


SEMANTIC = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p><p>no';</script></head>"
    "<body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- <p>gone</p> --><div class=\"ad big\">Buy</div>"
    "<article><header><h1>Caf&eacute; &amp; {n}</h1></header><p><b>One\n\t two<br>three<p>Four &lt;b&gt; {n}</p>"
    "<form><input value=x>Name</form><aside>Side</aside><div class='comments'><p>Rude</p></div>"
    "<ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table></article>"
    "<footer>&copy; me <p>foot</p></footer>"
)


def test_marked_article(extract):
    got = extract([(i, f"http://a.example/{i}", SEMANTIC.replace("{n}", str(i))) for i in range(4)])
    for i, row in got.items():
        blocks = [f"Café & {i}", "One two three", f"Four <b> {i}", "x", "y", "1 2", "3"]
        assert row.text == "\n\n".join(blocks) and row.n_chars == len(row.text)


PLAIN = (
    "<html><body><div id=header><a href=/>Site</a></div><div class=layout><div class=col2><p>Latest: <a href=x>y</a></p></div>"
    "<div class=body><h2>Head {n}</h2><p>{t}</p><p>And more {n} of it, here and there.</p>"
    "<div>Read our terms</div></div></div><div class=bottom>All rights reserved</div></body></html>"
)


def test_article_without_a_mark_is_found_by_the_wrapper(extract):
    rows = [
        (i, f"http://b.example/{i}", PLAIN.replace("{n}", f"no {i}").replace("{t}", f"word{i} " * (9 + i)))
        for i in range(8)
    ]
    for i, row in extract(rows).items():
        text = " ".join([f"word{i}"] * (9 + i))
        assert row.text == f"Head no {i}\n\n{text}\n\nAnd more no {i} of it, here and there."


def test_odd_pages(extract):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [
        (1, "http://c.example/1", None),
        (2, None, ""),
        (3, "no url", "just text"),
        (4, "http://d.example/", "<p>a<p>b &am &#65; &nbsp;c</b></div>"),
        (5, "http://e.example/", deep),
        (6, "http://f.example/", "<article>" + "<p>long text here</p>" * 4000 + "</article>"),
        (7, "http://g.example/", "<article><p>x <a href=\"y>z</p><p>w</article>"),
        (8, "http://h.example/", "<article><p>kept</p><script>if (a<b) {"),
        (None, "http://i.example/", "<article>q</article>"),
    ]
    got = extract(rows + [rows[5]])
    assert got[1].text == got[2].text == "" and got[1].n_chars == 0
    assert got[3].text == "just text"
    assert got[4].text == "a\n\nb &am A c"
    assert got[5].text == "deep"
    assert got[6].text.count("\n\n") == 3999
    assert got[7].text.startswith("x")
    assert got[8].text == "kept"
    assert got[None].text == "q"


def test_empty_table(extract):
    assert extract([]) == {}


def test_given_pages(spark):
    folder = "/root/testdata/sf0.001"
    rows = extract_text(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    import html

    for row in rows:
        inner = re.search("<article>(.*?)</article>", pages[row.page_id], re.S).group(1)
        blocks = re.split("</?(?:p|h1)>", inner)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in blocks]
        assert row.text == "\n\n".join(b for b in blocks if b)
    assert len(rows) == len(pages)


STORY = "<h1>Head {n}</h1><p>Story {n} goes on for a while, told here {n} times.</p><p>And it ends {n}.</p>"
TOLD = "Head {n}\n\nStory {n} goes on for a while, told here {n} times.\n\nAnd it ends {n}."


@pytest.mark.parametrize(
    "layout",
    [
        "<main class='content has-sidebar'>{s}</main>",
        "<div class='no-sidebar'>{s}</div>",
        "<article class='post tag-legal category-social'>{s}</article>",
        "<div class='elementor-widget-container'>{s}</div>",
        "<div id='comment-content'>{s}</div>",
        # Names that do say something else.
        "<main class='legal'>{s}</main>",
        "<div class='widget'>{s}</div>",
        "<div class='widget'><article>{s}</article></div>",
        "<article><div class='widget'>{s}</div></article>",
        "<form action=x><div class=top><a href=y>Site</a></div><div class=b>{s}</div></form>",
        "<form action=x><article>{s}</article><div class=comments><article>Rude {n}</article></div></form>",
    ],
)
def test_names_that_only_seem_to_say_something_else(extract, layout):
    page = "<body><nav>Menu</nav>" + layout + "<div class='comments'><p>So {n}</p></div></body>"
    pages = [page.replace("{s}", STORY).replace("{n}", f"no{i}") for i in range(6)]
    got = extract([(i, "http://n.example/", p) for i, p in enumerate(pages)])
    for i, row in got.items():
        assert row.text == TOLD.replace("{n}", f"no{i}")


def test_a_doubtful_article_among_clear_ones(extract):
    pages = ["<body><div>Top</div><article>" + STORY + "</article></body>"] * 8
    pages += ["<body><div>Top</div><form><article class=legal>" + STORY + "</article></form></body>"]
    got = extract([(i, "http://o.example/", p.replace("{n}", f"no{i}")) for i, p in enumerate(pages)])
    for i, row in got.items():
        assert row.text == TOLD.replace("{n}", f"no{i}")


@pytest.mark.parametrize(
    "icon",
    [
        "<svg class='icon'/>",
        "<svg class=icon />",
        "<math display='block'/>",
        "<svg><svg><path d='M0'/></svg><text>leak</text></svg>",
        "<svg><title/><style/><path/></svg>",
        "<svg><path d='M0'>",
        "<svg><foreignObject><p>leak</p></foreignObject><text>leak</text></svg>",
        "<math><mrow><mi>x</mi></mrow></math>",
        "<template><p>leak</p><template>leak</template><p>leak</p></template>",
        "<SVG viewBox='0 0 1 1'><script>'</svg>'</script><text>leak</text></SVG>",
    ],
)
def test_text_after_an_icon(extract, icon):
    page = f"<article><p>One</p>{icon}<p>Two</p><p>Three</p></article><footer>end</footer>"
    tail = f"<article><p>One</p><div>{icon}</div><p>Two</p></article>"
    got = extract([(1, "http://s.example/1", page), (2, "http://t.example/1", tail)])
    assert got[1].text == "One\n\nTwo\n\nThree"
    assert got[2].text == "One\n\nTwo"


def test_deep_elements_close_themselves(extract):
    for inner in ("<div>", "<div><span>", "<p>"):
        end = "".join(f"</{t}>" for t in reversed(re.findall(r"\w+", inner)))
        deep = inner * 160 + "deep" + end * 160
        page = f"<div><article><p>first</p>{deep}<p>rest</p></article></div><div>other</div>"
        nav = f"<article><p>first</p>{'<div>' * 160}<nav>menu</nav>deep{'</div>' * 160}<p>rest</p></article>"
        got = extract([(1, "http://p.example/", page), (2, "http://q.example/", nav)])
        assert got[1].text == got[2].text == "first\n\ndeep\n\nrest"


def test_many_names_lose_nothing(extract):
    def page(i):
        names = "".join(f"<div class='{a}{b}{c}'><a href=x>{i}</a></div>" for a in letters for b in letters for c in letters[i % 9 :])
        return f"<body>{names}<div class='zz{letters[i]}' role=main><div>Story of {i}, and so on.</div></div></body>"

    letters = "abcdefghijk"
    got = extract([(i, "http://r.example/", page(i)) for i in range(9)])
    for i, row in got.items():
        assert row.text == f"Story of {i}, and so on."


def test_parts_are_taken_together_not_cut():
    from dockside.llm.html_extract import MOST_PARTS, fewer

    parts = [["e", f"x{i % 700}.n{i}", False, 1 + i % 3, i % 2, [["#", i, 1, 10, 0, i]]] for i in range(3000)]
    found = fewer(parts)
    assert len(found) <= MOST_PARTS

    def characters(held):
        return sum(p[3] if p[0] == "#" else characters(p[5]) for p in held)

    assert characters(found) == 30000


def test_a_host_of_two_templates(extract):
    told = "<div class=story>" + STORY + "</div>"
    teasers = "".join(f"<article><h2><a href=x>More {i}</a></h2><p>Teaser {i} {{n}}.</p></article>" for i in "abc")
    pages = ["<body><div class=top>Top {n}</div><article>" + STORY + "</article></body>"] * 6
    pages += ["<body><div class=top>Top {n}</div>" + told + f"<div class=more>{teasers}</div></body>"] * 6
    pages += ["<body><div class=top>Top {n}</div>" + told + "</body>"]
    got = extract([(i, "http://u.example/", p.replace("{n}", f"no{i}")) for i, p in enumerate(pages)])
    assert len(got) == 13
    for i, row in got.items():
        assert row.text == TOLD.replace("{n}", f"no{i}")


def test_the_sites_own_paragraphs_go(extract):
    page = "<article>" + STORY + "<h3>Our terms</h3><ul><li>Be kind</ul></article>"
    rows = [(i, "http://v.example/", page.replace("{n}", f"no{i}")) for i in range(6)]
    # One article in frames that differ has no such text.
    framed = "<div>Seen {n} times</div><article>" + STORY + "</article>"
    rows += [(10 + i, "http://w.example/", framed.replace("{n}", str(i), 1).replace("{n}", "9")) for i in range(6)]
    got = extract(rows)
    for i in range(6):
        assert got[i].text == TOLD.replace("{n}", f"no{i}")
        assert got[10 + i].text == TOLD.replace("{n}", "9")


MIXED = (
    "<html><body><article><h1>Title {i}</h1><p>Story {i} begins {w}.</p><h2>Comments on plan {i}</h2>"
    "<p>It goes on {w} with <a href=x>a link</a>.</p><h3>Related stories</h3><ul class=more>"
    "<li><a href=/{i}1>Other tale {i}</a><li><a href=/{i}2>One more {i}</a></ul><p>Rest {i} of it {w}.</p>"
    "<ul><li>Point {i}<li>See <a href=y>there</a> for {i}</ul>"
    "<ol class=links><li><a href=/{i}3>Far {i}</a></ol>"
    "<section class=voices><div><h3>Responses:</h3></div><div class=one><p>I {i} disagree {w}</p></div>"
    "<div class=one><h4>Ann</h4><p>Me, too {i}</p></div></section></article></body></html>"
)


def articles(pages, wrapper=True):
    """Each page's article by the wrapper of them all, or by an empty one."""
    merged, blocks = None, []
    for page in pages:
        held: list = []
        root = html_extract.parse(page)
        new = {"n": 1, "pages": [hash(page)], "parts": html_extract.wrapper_of(root, "", held)}
        merged = new if merged is None else html_extract.merge_hosts(merged, new)
        blocks.append(held)
    chooser = html_extract.Chooser(html_extract.prepared(json.dumps(merged) if wrapper else None))
    return [chooser.article(*zip(*held)) for held in blocks]


def test_comments_and_lists_of_links_in_an_article_go_by_the_wrapper(extract):
    filled = [(i, MIXED.replace("{i}", str(i)).replace("{w}", f"w{i} " * (i + 3))) for i in range(8)]
    want = {}
    for i, _ in filled:
        w = " ".join([f"w{i}"] * (i + 3))
        want[i] = "\n\n".join(
            [
                f"Title {i}", f"Story {i} begins {w} .", f"Comments on plan {i}", f"It goes on {w} with a link.",
                f"Rest {i} of it {w} .", f"Point {i}", f"See there for {i}",
            ]
        )
    got = extract([(i, f"http://mixed.example/{i}", page) for i, page in filled])
    assert {i: r.text for i, r in got.items()} == want
    pages = [page for _, page in filled]
    assert articles(pages) == list(want.values())
    assert all("disagree" in text and "Far" in text for text in articles(pages, wrapper=False))


def test_a_heading_that_only_one_page_has_stays(extract):
    """Headings say nothing unless the host repeats them."""
    page = "<article><h1>T {i}</h1><p>Text {i}</p><section><h2>{h}</h2><p>Part {i}</p></section></article>"
    heads = ["Responses", "Comments", "Method", "Method", "Method", "Method", "Method", "Read on"]
    rows = [
        (i, f"http://heads.example/{i}", page.replace("{i}", str(i)).replace("{h}", h)) for i, h in enumerate(heads)
    ]
    got = extract(rows)
    assert all(r.text == f"T {i}\n\nText {i}\n\n{heads[i]}\n\nPart {i}" for i, r in got.items())
