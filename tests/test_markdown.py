"""The Markdown parser on small texts: containers, leaves, lines, and no text that it fails on."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions.markdown import blocks, inline
from corpusmill.operators import chunking
from corpusmill.queries.documents import as_markdown


def told(text):
    return [(b.kind, b.text) for b in blocks(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("> a\n> b\nlazy\n\nc", [("prose", "a b lazy"), ("prose", "c")]),
        ("> # h\n> > deep\n> - x\n>   y", [("prose", "h deep x y")]),
        ("- a\n- b\n  more\n\n  second\n\n- c\n\nend", [("prose", "a b more second c"), ("prose", "end")]),
        ("1. a\n   - b\n     - c\n2. d", [("prose", "a b c d")]),
        ("- a\n* b", [("prose", "a"), ("prose", "b")]),
        ("text\n2. not a list\n- a list", [("prose", "text 2. not a list"), ("prose", "a list")]),
        ("- ```\n  code\n  ```\n- b", [("prose", "``` code ``` b".replace(" ", "\n", 2).replace("``` b", "``` b"))]),
        ("```py\nx\n\n# no heading\n```\nafter", [("code", "```py\nx\n\n# no heading\n```"), ("prose", "after")]),
        ("~~~\nopen to the end", [("code", "```\nopen to the end\n```")]),
        ("````\n```\n````", [("code", "```\n```\n```")]),
        ("   ```\n   x\n     y\n   ```", [("code", "```\nx\n  y\n```")]),
        ("    indented\n\n    more\n\ntext", [("code", "```\nindented\n\nmore\n```"), ("prose", "text")]),
        ("para\n    not code", [("prose", "para not code")]),
        ("# A #\n## B##\n#no\n####### no", [("heading", "A"), ("heading", "B##"), ("prose", "#no ####### no")]),
        ("Two\nlines\n---\nx\n===", [("heading", "Two lines"), ("heading", "x")]),
        ("a\n\n---\n\n* * *\nb", [("prose", "a"), ("prose", "b")]),
        ("| a | b |\n|---|---|\n| 1 \\| 2 | *3* |\n\nend", [("table", "a b\n1 | 2 3"), ("prose", "end")]),
        ("a | b\n- | -\nno | table\n> q", [("table", "a b\nno table"), ("prose", "q")]),
        ("a | b\n---|---|---", [("prose", "a | b ---|---|---")]),
        ("<div>\n<b>x</b>\n</div>\n\ny", [("html", "<div> <b>x</b> </div>"), ("prose", "y")]),
        ("<!-- a\n\nb -->\ny", [("html", "<!-- a  b -->"), ("prose", "y")]),
        ("[ref]: http://x 'title'\n\nsee [it][ref]", [("prose", "see it")]),
        ("a\r\nb\rc", [("prose", "a b c")]),
        ("", []),
        (" \n\t\n", []),
    ],
)
def test_blocks(text, want):
    assert told(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("**bold** and *it* and ***both*** and ~~gone~~", "bold and it and both and gone"),
        ("snake_case stays, _this_ goes, 2 * 3 stays", "snake_case stays, this goes, 2 * 3 stays"),
        ("`*code*` ``a ` b``", "`*code*` ``a ` b``"),
        ("![alt](i.png) [![in](a)](b) [t](u(v)) <http://a.b>", "alt in t http://a.b"),
        (r"\*no\* &amp; &lt;", "*no* & <"),
        ("[not a link] (x)", "[not a link] (x)"),
    ],
)
def test_inline(text, want):
    assert inline(text) == want


def test_lines_are_where_blocks_come_from():
    text = "# A\n\npara\nmore\n\n```\nx\n```\n> q\n\nT\n=\n- i\n  j\n"
    assert [(b.kind, b.first, b.last) for b in blocks(text)] == [("heading", 0, 0), ("prose", 2, 3), ("code", 5, 7), ("prose", 8, 8), ("heading", 10, 11), ("prose", 12, 13)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab -*_#>|`~=1.)\n\t[]()<!:\\", max_size=120))
def test_no_text_fails_and_no_word_is_made_up(text):
    found = list(blocks(text))
    lines = text.replace("\r", "\n").split("\n")
    assert all(0 <= b.first <= b.last < len(lines) for b in found)
    assert all(x.last < y.first for x, y in zip(found, found[1:]))
    assert sum(b.text.count("a") for b in found) <= text.count("a")


def test_deep_and_long():
    assert told(">" * 3000 + " x")[0][0] == "prose"
    assert len(list(blocks("para\n\n" * 20000))) == 20000
    assert told("- " * 500 + "x")[0][0] == "prose"


def test_heading_path_is_a_fold(spark):
    text = "# A\n\none\n\n### C\n\ntwo\n\n## B\n\nthree\n\n# D\n\n## E\n\n```\nx\n```\n"
    df = spark.createDataFrame([(1, text), (2, "# only\n\n## headings"), (3, None), (4, "> # quoted\n\nx")], "id int, t string")
    got = {}
    for r in chunking.chunk_markdown(df, "t").orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append((r.heading_path, r.text, r.chunk_start_word, r.chunk_end_word))
    assert got[1] == [("# A", "one", 2, 3), ("# A | ### C", "two", 5, 6), ("# A | ## B", "three", 8, 9), ("# D | ## E", "```\nx\n```", 13, 16)]
    assert got[2] == [(None, "# only ## headings", 0, 4)] and 3 not in got
    assert got[4] == [(None, "quoted x", 0, 2)]
    lines = chunking.with_blocks(df, "t").where("id = 1").select(F.inline("~blocks")).collect()
    assert [(r.kind, r.level, r.first_line) for r in lines][:3] == [("heading", 1, 0), ("prose", 0, 2), ("heading", 3, 4)]


def test_layout_takes_time_by_length(spark):
    """Ten tokens a line; no line copies all tokens."""
    docs = spark.createDataFrame([(1, 23), (2, 3), (3, 200_000)], "doc_id long, n int")
    docs = docs.select("doc_id", F.array_join(F.transform(F.sequence(F.lit(1), "n"), lambda i: i.cast("string")), " ").alias("text"))
    as_markdown(docs.where("doc_id < 3")).collect()
    began = time.time()
    got = {r.doc_id: r.text.split("\n") for r in as_markdown(docs).collect()}
    assert time.time() - began < 10
    assert got[1][3] == "1 2 3 4 5" and got[2][3] == "" and "> 11 12 13 14 15" in got[1] and "~~~py" in got[2]
    assert [len(x.split()) for x in got[3][3:5003]] == [10] * 5000 and got[3][5002].endswith(" 50000")


def test_lines_of_letters_are_text():
    text = "\n".join(["five plain words of text"] * 40_000)
    began = time.process_time()
    assert told(text) == [("prose", text.replace("\n", " "))]
    assert time.process_time() - began < 1.5
    assert told("a\n    b\n\n    c\nd | e\n--|--\nf") == [("prose", "a b"), ("code", "```\nc\n```"), ("table", "d e\nf")]
