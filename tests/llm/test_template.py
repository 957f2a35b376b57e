"""What is template: a text on most distinct pages of a host, and only where a page holds that text."""

from veristrata.llm import wrapper


def _texts(spark, pages):
    rows = [(i, f"http://one.org/{i}", page) for i, page in enumerate(pages)]
    return {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def _page(i, block):
    return f"<body><nav>at {i}</nav><article><h1>Title {i}</h1><p>{f'own words of page{i} ' * 6}</p>{block}</article></body>"


def test_copies_do_not_vote_and_other_texts_stay(spark):
    copy = "<body><nav>at {0}</nav><article><h1>Same</h1><p>" + "same words " * 9 + "</p><div class=box>Box of the copies</div></article></body>"
    got = _texts(spark, [copy.format(i) for i in range(20)] + [_page(i, f"<div class=box>Box number {i}</div>") for i in range(20, 24)])
    assert all(got[i].endswith("\nBox of the copies") for i in range(20))
    assert all(got[i].endswith(f"\nBox number {i}") for i in range(20, 24))


def test_three_pages_are_no_large_share(spark):
    got = _texts(spark, [_page(i, "<section class=rare>Shared by three</section>" if i < 3 else "") for i in range(40)])
    assert all(got[i].endswith("\nShared by three") for i in range(3))


def test_constant_block_goes_where_it_stands(spark):
    got = _texts(spark, [_page(i, f"<div class=box>{'Other text' if i == 0 else 'One text on all'}</div>") for i in range(12)])
    assert got[0].endswith("\nOther text") and not any("One text on all" in got[i] for i in range(1, 12))


def test_constant_paragraphs_and_headings_go(spark):
    end = "<p>Read us daily</p><p class=outro>One outro on all pages</p><h2>More</h2><ul><li>item {0}<li>kept item</ul>"
    got = _texts(spark, [_page(i, end.format(i)) for i in range(12)] + [_page(0, end.format(0))] * 60)
    assert len(got) == 72
    for i, text in got.items():
        n = i if i < 12 else 0
        assert text.split("\n") == [f"Title {n}", " ".join([f"own words of page{n}"] * 6), f"item {n}", "kept item"]
