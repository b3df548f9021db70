"""Pages with raw elements left open."""

import pytest

from textassay.llm import dom


def said(html):
    return [t for _, t in dom.parse(html).blocks]


@pytest.mark.parametrize("tag", ["<svg width=1 />", '<svg class="a"/>', "<SVG/>", "<svg>", "<iframe src=x>", "<select>", "<template>", "<noscript>"])
def test_open_elements_take_nothing_with_them(tag):
    assert said(f"<p>one</p>{tag}<p>two</p><p>three</p>") == ["one", "two", "three"]


def test_closed_elements_are_skipped():
    assert said("<p>one</p><svg/><p>two</p><svg><text>no</text></svg><p>three</p>") == ["one", "two", "three"]
    for name in sorted(dom.RAW):
        assert said(f"<p>one</p><{name}>no</{name}><p>two</p>") == ["one", "two"], name
    assert said("<p>one</p><iframe src=x/>no</iframe><p>two</p>") == ["one", "two"]
    for name in sorted(dom.TEXT_ONLY):
        assert said(f"<p>one</p><{name}>no<p>two</p>") == ["one"], name
