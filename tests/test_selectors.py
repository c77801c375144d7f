import pytest

from siteloom.sources import html, selectors

PAGE = """<html><body><nav class="top bar"><a id=a href=x lang=en-US>1</a><a id=b>2</a></nav>
<main><p id=p></p><div class=card data-k="v w"><button id=c disabled>3</button><span>s</span><input id=d required type=email></div><a id=e>4</a></main></body></html>"""


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("a", "abe"), ("nav a", "ab"), ("body > a", ""), ("main > a", "e"), ("nav > a + a", "b"), ("p ~ a", "e"), ("p + a", ""), ("button ~ input", "d"), ("body .card > *", "cd"),
        (".top.bar a#b", "b"), ("[data-k~=w] button", "c"), ("[lang|=en]", "a"), ("[type^='em']", "d"), ("[type$=\"ail\"]", "d"), ("[type*=zz]", ""), ("[required]", "d"),
        ("a:first-child", "a"), ("a:last-child", "be"), ("a:not(#a)", "be"), ("a:nth-child(2n+1)", "ae"), ("a:nth-of-type(2)", "b"), ("input:nth-child(-n+3)", "d"), (":disabled", "c"),
        ("a:only-of-type", "e"), ("a:link", "a"), ("html body main a", "e"), ("main div a", ""), ("a:visited", ""), ("a >", ""), ("> a", ""), ("a::before", ""), ("a[", ""), ("", ""), ("div button.x", ""),
    ],
)
def test_selectors_match(given, want):
    tree = html.Tree(PAGE)
    found = selectors.selector(given)
    got = [x.get("id") for x in tree.elements if x.is_control() and found and found.matches(x)]
    assert "".join(got) == want
    # What the last compound names leads to the rule.
    rules = selectors.StateRules(f"{given}:hover {{ color: red }}", html.TRACKED) if given else None
    if rules and found and not given.endswith(">"):
        assert "".join(x.get("id") for x in tree.elements if x.is_control() and rules.of(x)) == want


def test_later_rules_win_and_at_rules_are_left_out():
    css = "@import 'x'; a:hover { color: red; color: blue } @media print { a:hover { color: black } b { } } @font-face { x: y } nav a:hover { opacity: 1 } a:focus-within { color: /* x */ green"
    rules = selectors.StateRules(css, html.TRACKED)
    x = next(x for x in html.Tree(PAGE).elements if x.tag == "a")
    assert rules.of(x) == {("hover", "color"): "blue", ("hover", "opacity"): "1", ("focus", "color"): "green"}
