"""Container blocks of markdown, by examples."""

import pytest
from veristrata.sources import markdown, scans


def _b(text):
    return [(kind, value) for _, kind, _, value, _, _ in markdown.blocks(text)]


def test_nested_lists_quotes_and_fences():
    text = "# T\n\n- one\n  more\n\n  second paragraph\n  - inner\n    1. deep\n  ```\n  - no item\n  ```\n- two\n\nafter"
    assert _b(text) == [("title", "T"), ("list_item", "one more"), ("list_item", "inner"), ("list_item", "deep"), ("list_item", "two"), ("paragraph", "after")]
    spans = {v: (a, z) for _, _, _, v, a, z in markdown.blocks(text)}
    assert spans["one more"] == (3, 11) and spans["inner"] == (7, 8) and spans["two"] == (12, 12)
    assert _b("> quoted\nlazy line\n> - item in quote\n>   goes on\n>\n> end\n\nout") == [("paragraph", "quoted lazy line"), ("list_item", "item in quote goes on"), ("paragraph", "end"), ("paragraph", "out")]
    assert _b("- a\n\n      code in item\n\n  > quote in item\n- b") == [("list_item", "a"), ("list_item", "b")]
    assert _b("- - x\n  - y") == [("list_item", "x"), ("list_item", "x"), ("list_item", "y")]


def test_fences_hide_what_they_hold():
    assert _b("````\n```\n# no\n````\ntext") == [("paragraph", "text")]
    assert _b("~~~ python\n- no\n```\n~~~\n> ```\n> | a |\nout of it") == [("paragraph", "out of it")]
    assert _b("para\n```\nopen to the end\n\n- no") == [("paragraph", "para")]
    assert _b("    - code\n\n    more\n\ntext\n    goes on") == [("paragraph", "text goes on")]


def test_headings_paths_and_kinds():
    text = "Title\n=====\n\n## Abstract ##\nshort\n\nMethods\n---\n### Sub\nFigure 2 shows\n\nTable 1: x\n\n# Again\nTable of\n\n## References\n1. ref\n\nA. Author"
    got = [(k, p, v) for _, k, p, v, _, _ in markdown.blocks(text)]
    assert got == [("title", [], "Title"), ("abstract", ["Abstract"], "short"), ("figure_caption", ["Methods", "Sub"], "Figure 2 shows"), ("table_caption", ["Methods", "Sub"], "Table 1: x"), ("paragraph", [], "Table of"), ("list_item", ["References"], "ref"), ("reference", ["References"], "A. Author")]
    assert _b("####### seven\n#none\n# \nx") == [("paragraph", "####### seven #none"), ("paragraph", "x")]


def test_what_breaks_into_a_paragraph():
    assert _b("text\n- item") == [("paragraph", "text"), ("list_item", "item")]
    assert _b("text\n2. no item\n1. item") == [("paragraph", "text 2. no item"), ("list_item", "item")]
    assert _b("text\n***\nnext\n-\nlast") == [("paragraph", "text"), ("paragraph", "last")]  # the second is a heading
    assert _b("* * *\n- x\n---\ny") == [("list_item", "x"), ("paragraph", "y")]


def test_tables():
    text = "| a | b |\n|---|:-:|\n| 1 | two \\| three |\n4 | 5\n\n| not | one |\n| x |"
    assert _b(text) == [("table", "a | b | 1 | two | three | 4 | 5"), ("paragraph", "| not | one | | x |")]
    assert _b("- | a |\n  |---|\n  | 1 |") == [("list_item", "a"), ("table", "a | 1")]


def test_items_without_text_are_an_error(spark):
    with pytest.raises(markdown.NoText):
        markdown.blocks("- \n\ntext")
    docs = spark.createDataFrame([(1, "# T\n- a\n  - b"), (2, None)], "id long, text string")
    rows = scans.parse_blocks(docs, "commonmark").collect()
    assert [(r.id, r.block_type, r.text) for r in sorted(rows, key=lambda r: r.block_index)] == [(1, "title", "T"), (1, "list_item", "a"), (1, "list_item", "b")]
