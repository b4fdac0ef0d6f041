"""Text of drawings and formulas."""

from veilspan.llm import html_layout as hl


def test_formula():
    got = hl.visible_text(
        "<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>no</annotation>"
        "<annotation-xml><p>no</p></annotation-xml></semantics></math> holds"
    )
    assert got == "so x=2 holds"


def test_drawing():
    got = hl.visible_text(
        "<p>before</p><svg><title>no</title><desc>no</desc><defs><text>no</text></defs><symbol><text>no</text></symbol>"
        "<metadata>no</metadata><defs/><title/><rect width=1 /><text>first <tspan>label</tspan></text><text>second</text>"
        "<text display='none'>no</text><style>text {fill: red}</style>"
        "<foreignObject><div>inner <b>html</b></div></foreignObject></svg><p>after</p>"
    )
    assert got.split("\n") == ["before", "", "first label", "second", "inner html", "", "after"]
    assert hl.visible_text("<svg/>tail <desc>shown</desc>") == "tail shown"
