"""Layout of pages against expected text, and words against a plain parser."""

from html.parser import HTMLParser

from tests.llm.conftest import rows_of
from veilspan.llm import html_layout as hl


def test_blocks_and_lists():
    got = hl.visible_text(
        "<title>x</title><p>One  two<b>three</b><p>Four<br>five<ul><li>a<li>b<ol><li>c<li value=7>d</ol><li>e</ul><div>tail"
    )
    assert got == "One twothree\n\nFour\nfive\n\n- a\n- b\n   1. c\n   7. d\n- e\n\ntail"


def test_tables():
    got = hl.visible_text(
        "<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>wide<tr>"
        "<td rowspan=2>tall<td>1<tr><td>2</table>after"
    )
    assert got == "Cap\nName       Qty\napple pie  3\nwide\ntall       1\n           2\n\nafter"
    inner = "<table><tr><td>a<table><tr><td>b<td>c</table><td>d</table>"
    assert hl.visible_text(inner).split() == ["a", "d", "b", "c"]


def test_hidden_parts():
    got = hl.visible_text(
        "<style>.k, #q {display: none} b{color:red}</style><div style='display:none'>no</div><div hidden>no</div>"
        "<p class='z k'>no<p id=q>no<template>no</template><script>var x='</p>no';</script><!-- no -->"
        "<div>in <span style='visibility:hidden'>no <i style='visibility: visible'>yes</i></span> out</div>"
        "<details><summary>S</summary>no</details><dialog>no</dialog><textarea>t &amp; u</textarea>"
    )
    assert got.split() == ["in", "yes", "out", "S", "t", "&", "u"]


def test_broken_markup():
    assert hl.visible_text("a < b & c <p <b>d</p></i></table>e") == "a < b & c\n\nd\n\ne"
    assert hl.visible_text("<p>a<!-- never ends").split() == ["a"]
    assert hl.visible_text("<a href='unclosed>x</a> y").split()[-1] == "y"
    deep = "<div>" * 5000 + "x" + "<table><tr><td>" * 300 + "y"
    assert hl.visible_text(deep).split() == ["x", "y"]
    assert hl.visible_text("<pre>  a\n   b\n</pre>") == "  a\n   b"


class Words(HTMLParser):
    """Text outside script, style and title, with blanks for tags that break lines."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def _tag(self, tag, step):
        self.skip += step * (tag in ("script", "style", "title"))
        if tag in hl.BLOCKS | {"br", "td", "th"}:
            self.out.append(" ")

    def handle_starttag(self, tag, attrs):
        self._tag(tag, 1)

    def handle_endtag(self, tag):
        self._tag(tag, -1)

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_words_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in hl.html_text(pages).collect():
        plain = Words()
        plain.feed(sources[r.page_id])
        plain.close()
        assert [w for w in r.text.split() if w != "-"] == [w for w in "".join(plain.out).split() if w != "-"]
        assert r.n_lines == len(r.text.split("\n"))


def test_odd_rows(spark):
    rows = [(0, None, "a"), (1, "", "b"), (2, "plain & simple", "c"), (2, "plain &amp; simple", "d"), (None, "<p>x", "e")]
    rows.append((3, "<p>" + "long " * 200_000, "f"))
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = hl.html_text(pages)
    assert rows_of(got.filter("page_id <> 3 OR page_id IS NULL"), "page_id", "text", "n_lines") == sorted(
        [(0, "", 0), (1, "", 0), (2, "plain & simple", 1), (2, "plain & simple", 1), (None, "x", 1)], key=repr
    )
    assert len(got.filter("page_id = 3").first().text.split()) == 200_000
    assert hl.html_text(pages.limit(0)).count() == 0
