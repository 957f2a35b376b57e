"""Wrapper induction: no article lost, any depth, reruns agree, alignment and texts against brute force."""

import random
from functools import lru_cache

import pytest
from veristrata.llm import wrapper


@pytest.mark.parametrize(
    "html",
    [
        '<div class="layout has-sidebar"><article><p>Own text</p></article></div>',
        '<article class="post comments-open"><p>Own text</p></article>',
        '<div class="page-with-header"><main><p>Own text</p></main></div>',
        '<main class="search-engines"><p>Own text</p></main>',
        '<form id="aspnetForm"><div id="sidebar-wrapper"><article><p>Own text</p></article></div></form>',
        '<main class="ads"><div class="sidebar"><article><p>Own text</p></article></div><aside><article>Teaser</article></aside></main>',
        '<div class="layout has-sidebar"><article class="post"><p>Own text</p></article><section class="comments"><article><p>Reader</p></article></section></div>',
        '<article style="overflow:hidden" data-state="hidden"><div data-role="menu" style="overflow: hidden"><p>Own text</p></div></article>',
        '<article><div class="entry-header"><h1>Own text</h1></div><div class="entry-footer">Tags</div><p hidden>no</p><p style="display: none">no</p><p aria-hidden="true">no</p></article>',
        '<article><header class="post-header"><h1>Own text</h1></header><nav>on</nav><div id="share-buttons">share</div><aside>side</aside></article>',
        '<main><p>Own text</p><section class="comments"><article><p>Reader</p></article></section></main>',
    ],
)
def test_no_word_drops_the_article(html):
    assert wrapper.extract(f"<body>{html}<footer>end</footer></body>", None) == "Own text"


@pytest.mark.parametrize("tag", ["b", "div", "ul", "section"])
def test_any_depth(spark, tag):
    html = "<body>" + f"<{tag}>" * 5000 + "deep {0}" + f"</{tag}>" * 5000 + "</body>"
    rows = [(i, f"http://deep.org/{i}", html.format(i)) for i in range(4)]
    got = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == [f"deep {i}" for i in range(4)]


def _naive(a, b):
    if a.key != b.key:
        return 0

    @lru_cache(None)
    def best(i, j):
        if not i or not j:
            return 0
        return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + _naive(a.kids[i - 1], b.kids[j - 1]))

    return 1 + best(len(a.kids), len(b.kids))


def _tree(r, depth=0):
    kids = [_tree(r, depth + 1) for _ in range(r.randint(0, 3 if depth < 3 else 0))]
    return wrapper.Shape((r.choice("abc") if depth else "r", ""), kids, r.randint(0, 9), 0)


def test_matching_equals_brute_force():
    r = random.Random(4)
    for _ in range(150):
        a, b = _tree(r), _tree(r)
        assert wrapper.Sizes().of(a, b) == _naive(a, b)
        both = wrapper.merge(a, b)
        assert both.nodes == a.nodes + b.nodes - _naive(a, b) and both.letters == a.letters + b.letters
        again = wrapper.load(wrapper.dump(both))
        assert again.code == both.code and wrapper.dump(again) == wrapper.dump(both)


def _site(seed, n):
    """Pages of one generator and the text that a reader would call theirs."""
    r = random.Random(seed)
    notices = [("<p>Subscribe to our daily letter now.</p>", 1), ("<div class=box>Constant box beside a varying one</div>", 0), ("<h2>Read on</h2>", 1), ("<section class=note><p>Terms of this site apply</p></section>", 0)]
    rows, want = [], {}
    for i in range(n):
        words = lambda k: " ".join(f"w{r.randint(0, 999)}" for _ in range(k))  # noqa: E731, B023
        blocks = [(f"<h1>{(t := words(3))}</h1>", t)]
        for _ in range(r.randint(2, 5)):
            text = words(r.randint(4, 12))
            blocks.append((r.choice(["<p>{0}</p>", "<div>{0}</div>", "<blockquote>{0}</blockquote>"]).format(text), text))
        body = "".join(b for b, _ in blocks[:2]) + notices[0][0] + "".join(b for b, _ in blocks[2:]) + "".join(x for x, _ in notices[1:])
        html = f"<html><body><header><a href=/>Home</a></header><div class='layout has-sidebar'><article class='post comments-open'>{body}</article><aside>{words(3)}</aside></div><footer>f</footer></body></html>"
        rows.append((i, f"https://site{seed}.org/{i}", html))
        want[i] = "\n".join(t for _, t in blocks)
    return rows, want


def test_texts_equal_the_generators_and_reruns_agree(spark):
    rows, want = _site(1, 30)
    pages = spark.createDataFrame(rows + rows[:5] * 20, "page_id long, url string, html string")
    first = {}
    for parts in (1, 3, 11):
        got = wrapper.main_text(pages.repartition(parts)).collect()
        assert len(got) == 130 and all(g.text == want[g.page_id] for g in got)
        tree = {r.host: (bytes(r.wrapper), r.constant) for r in wrapper.induce(pages.repartition(parts)).collect()}
        assert tree == first or not first
        first = tree


def test_constant_paragraph_on_eight_pages(spark):
    rows = [(i, f"http://eight.org/{i}", f"<body><article><h1>T{i}</h1><p>{'own words %d ' % i * 5}</p><p>Subscribe to our daily letter now.</p><div>{'one two %d ' % i * 3}</div><div>Constant division</div></article></body>") for i in range(8)]
    for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert "Subscribe" not in r.text and "Constant" not in r.text and r.text.count("\n") == 2


def test_near_copies_keep_their_text(spark):
    long = "the longest paragraph of all of them " * 4
    rows = [(i, f"http://near.org/{i}", f"<body><article><h1>Same title</h1><p>{long}</p><p>Second of {i % 7}</p><p>Third</p></article></body>") for i in range(12)]
    for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.split("\n") == ["Same title", long.strip(), f"Second of {r.page_id % 7}", "Third"]


def test_long_page_and_clashing_columns(spark):
    html = "<body><article>" + "".join(f"<p>word {i}</p>" for i in range(60_000)) + "</article></body>"
    rows = wrapper.main_text(spark.createDataFrame([(1, "http://long.org/", html, "x", 2)], "page_id long, url string, html string, text string, n_chars int")).collect()
    assert rows[0].text.count("\n") == 59_999 and rows[0].n_chars == len(rows[0].text)
