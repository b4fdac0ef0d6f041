"""What style sheets hide, wide and deep tables, and pages with very many open tags."""

import time

import pytest

from veilspan.llm.html_layout import build_tree, visible_text


@pytest.mark.parametrize(("sheet", "shown"), [
    (".a{display:none}", False), ("@media print {.a{display:none}}", True), ("@media screen{.a{display:none}}", False),
    ("@media print, screen {.a{display:none}}", False), ("@media (max-width: 600px) {.a{display:none}}", True),
    ("@supports (display: grid) {.a{display:none}}", False), ("@keyframes x {from{display:none} p{display:none}}", True),
    (".a{display:none} .a{display:block}", True), (".a{display:block} .a{display:none}", False),
    ("#i{display:block} .a{display:none}", True), (".a{display:none!important} #i{display:block}", False), ("p.a{display:none} #i{display:block}", True),
    (".a{display:none; color:red; display:inline}", True), (".a{visibility:hidden}", False), (".a{visibility:hidden} #i{visibility:visible}", True),
    ("@import url(x.css); /* .b{} */ .a { color:red; display : none }", False), ("} .a{display:none", True), (".b .a{display:none}", True),
    ("@media print{@media screen{.a{display:none}}} .b{display:none}", True),
])
def test_sheets(sheet, shown):
    text = visible_text(f"<style>{sheet}</style><p>start<p class=a id=i>word</p>end")
    assert ("word" in text) == shown and "start" in text and "end" in text


def test_own_style_and_sheet():
    sheet = "<style>.a{display:none} .b{display:none!important} .c{display:block} div{visibility:hidden}</style>"
    page = sheet + '<p class=a style="display:block">one<p class=b style="display:block">two<p class=c hidden>three'
    page += '<div>four<span style="visibility:visible">five</span></div><p hidden>six'
    text = visible_text(page)
    assert [w in text for w in "one two three four five six".split()] == [True, False, True, False, True, False]


@pytest.mark.parametrize("part", ["<div>", "<span>", "</b>", "<span></b>", "<li>", "<b><i>", "<p><span>"])
def test_many_tags_take_linear_time(part):
    begun = time.process_time()
    build_tree(part * (200_000 // part.count("<")))
    assert time.process_time() - begun < 12


def test_wide_cells_keep_columns():
    wide = "word " * 30 + "end"
    page = f"<table><tr><td>{wide}<td>one<tr><td>short<td>two<tr><td>{'x' * 500}<td>three</table>"
    lines = visible_text(page).split("\n")
    assert [line.split()[-1] for line in lines] == ["one", "two", "three"]
    assert {line.rindex(line.split()[-1]) for line in lines} == {502}


def test_blanks_of_wide_columns_are_bounded():
    page = f"<table><tr><td>{'x' * 300_000}<td>one" + "<tr><td>a<td>b" * 5_000 + "</table>"
    text = visible_text(page)
    assert text.split() == ["x" * 300_000, "one"] + ["a", "b"] * 5_000
    assert len(text) < 20 * len(page)


def test_deep_tables_are_laid_out():
    depth = 60
    page = "<table><tr><td>a<td>" * depth + "<table><tr><td>left<td>right<tr><td>l<td>r</table>" + "</table>" * depth
    lines = [line for line in visible_text(page).split("\n") if "right" in line or line.endswith("r")]
    assert len(lines) == 2 and lines[0].index("right") == lines[1].rindex("r")
