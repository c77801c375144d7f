"""CSS selectors matched against parsed elements, and a page's state rules in the order of its style sheets.

A selector is a list of compounds with the combinators between them. It is matched from its last compound up and to
the left; rules are looked up by what that compound names, so an element meets only rules that may hold for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

Test = Callable[["object"], bool]

_SIMPLE = re.compile(
    r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]
    |:(?P<pseudo>[\w-]+)(?:\((?P<arg>[^()]*)\))?""",
    re.VERBOSE,
)
_BETWEEN = re.compile(r"\s*([>+~])\s*|(\s+)")
_NTH = re.compile(r"\s*(?:(?P<a>[+-]?\d*)n\s*(?P<b>[+-]\s*\d+)?|(?P<only>[+-]?\d+))\s*")

_COMPARED: dict[str, Callable[[str, str], bool]] = {
    "=": lambda own, given: own == given,
    "~=": lambda own, given: given in own.split(),
    "|=": lambda own, given: own == given or own.startswith(given + "-"),
    "^=": lambda own, given: bool(given) and own.startswith(given),
    "$=": lambda own, given: bool(given) and own.endswith(given),
    "*=": lambda own, given: bool(given) and given in own,
}
_FIELDS = ("input", "button", "select", "textarea")
_PLAIN: dict[str, Test] = {
    "first-child": lambda x: x.index == 1,
    "last-child": lambda x: x.parent.newest is x,
    "only-child": lambda x: x.index == 1 and x.parent.newest is x,
    "first-of-type": lambda x: x.nth == 1,
    "last-of-type": lambda x: x.nth == x.parent.tags[x.tag],
    "only-of-type": lambda x: x.parent.tags[x.tag] == 1,
    "empty": lambda x: x.newest is None and not "".join(x.own_text),
    "root": lambda x: x.tag == "html",
    "disabled": lambda x: x.tag in _FIELDS and "disabled" in x.attributes,
    "enabled": lambda x: x.tag in _FIELDS and "disabled" not in x.attributes,
    "checked": lambda x: "checked" in x.attributes,
    "required": lambda x: "required" in x.attributes,
    "optional": lambda x: x.tag in ("input", "select", "textarea") and "required" not in x.attributes,
    "link": lambda x: x.tag == "a" and "href" in x.attributes,
    "any-link": lambda x: x.tag == "a" and "href" in x.attributes,
}


def _nth(text: str) -> Callable[[int], bool] | None:
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip(), text)
    if not (m := _NTH.fullmatch(text)):
        return None
    if m["only"]:
        return lambda i: i == int(m["only"])
    a = int(m["a"] + "1" if m["a"] in ("", "+", "-") else m["a"])
    b = int((m["b"] or "0").replace(" ", ""))
    return lambda i: i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0


def _test(m: re.Match) -> Test | None:
    if m["tag"]:
        tag = m["tag"].lower()
        return (lambda x: True) if tag == "*" else lambda x: x.tag == tag
    if m["id"]:
        return lambda x: x.get("id") == m["id"]
    if m["cls"]:
        return lambda x: m["cls"] in x.get("class").split()
    if m["attr"]:
        name, given = m["attr"].lower(), next((y for y in (m["dq"], m["sq"], m["bare"]) if y is not None), "")
        if not m["op"]:
            return lambda x: name in x.attributes
        return lambda x: name in x.attributes and _COMPARED[m["op"]](x.get(name), given)
    kind, given = m["pseudo"].lower(), m["arg"]
    if given is None:
        return _PLAIN.get(kind)
    if kind == "not":
        inner = compound(given.strip())
        return None if inner is None else lambda x: not all(t(x) for t in inner)
    counted = _nth(given) if kind in ("nth-child", "nth-of-type") else None
    if counted is None:
        return None
    return lambda x: counted(x.index if kind == "nth-child" else x.nth)


def compound(text: str) -> list[Test] | None:
    """The tests of one compound selector; null if it holds anything else."""
    tests, at = [], 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        test = _test(m) if m and not (m["tag"] and at) else None
        if test is None:
            return None
        tests.append(test)
        at = m.end()
    return tests or None


class Selector:
    """A selector of compounds; ``key`` is what an element must have to be worth a look: an id, a class, a tag or nothing."""

    def __init__(self, parts: list[list[Test]], combinators: list[str], key: tuple[str, str]):
        self.parts, self.combinators, self.key = parts, combinators, key

    def matches(self, x) -> bool:
        return self._from(x, len(self.parts) - 1)

    def _from(self, x, at: int) -> bool:
        if not x.parent or not all(t(x) for t in self.parts[at]):
            return False
        if at == 0:
            return True
        kind = self.combinators[at - 1]
        y = x.parent if kind in (" ", ">") else x.previous
        while y is not None and y.parent is not None:
            if self._from(y, at - 1):
                return True
            if kind in (">", "+"):
                return False
            y = y.parent if kind == " " else y.previous
        return False


def selector(text: str) -> Selector | None:
    """A complex selector; null if a part of it isn't known here, which then matches nothing."""
    texts, combinators, at, depth = [""], [], 0, 0
    while at < len(text):
        depth += (text[at] in "[(") - (text[at] in "])")
        if not depth and (m := _BETWEEN.match(text, at)):
            combinators.append(m[1] or " ")
            texts.append("")
            at = m.end()
        else:
            texts[-1] += text[at]
            at += 1
    parts = [compound(x) for x in texts]
    if any(x is None for x in parts):
        return None
    found = [m for m in _SIMPLE.finditer(re.sub(r"\(.*?\)|\[.*?\]", "", texts[-1]))]
    for kind in ("id", "cls", "tag"):
        if named := next((m[kind] for m in found if m[kind] and m[kind] != "*"), None):
            return Selector(parts, combinators, (kind, named.lower() if kind == "tag" else named))
    return Selector(parts, combinators, ("", ""))


def style_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selector list, declarations) of the rules at the top of a style sheet. Blocks of at-rules are passed over whole."""
    css, at = re.sub(r"/\*.*?\*/", "", css, flags=re.DOTALL), 0
    while (opened := css.find("{", at)) >= 0:
        head, depth, end = css[at:opened].rsplit(";", 1)[-1].strip(), 1, opened + 1
        while depth and end < len(css):
            depth += (css[end] == "{") - (css[end] == "}")
            end += 1
        if not head.startswith("@"):
            yield head, css[opened + 1 : end - (depth == 0)]
        at = end


class StateRules:
    """The hover and focus rules of a style sheet, with what of ``tracked`` properties each declares."""

    def __init__(self, css: str, tracked: tuple[str, ...]):
        self.rules: list[tuple[Selector, str, dict[str, str]]] = []
        self.by_key: dict[tuple[str, str], list[int]] = {}
        for heads, body in style_rules(css):
            pairs = (x.partition(":") for x in body.split(";"))
            declared = {k.strip().lower(): v.strip() for k, _, v in pairs if k.strip().lower() in tracked and v.strip()}
            for head in heads.split(",") if declared else ():
                state = "hover" if ":hover" in head else "focus" if ":focus" in head else ""
                base = re.sub(r":hover|:focus(-visible|-within)?", "", head).strip()
                if state and base and (found := selector(base)):
                    self.by_key.setdefault(found.key, []).append(len(self.rules))
                    self.rules.append((found, state, declared))

    def of(self, x) -> dict[tuple[str, str], str]:
        """(state, property) to value for an element; later rules win."""
        keys = {("", ""), ("tag", x.tag), ("id", x.get("id")), *(("cls", c) for c in x.get("class").split())}
        found: dict[tuple[str, str], str] = {}
        for i in sorted(i for k in keys for i in self.by_key.get(k, ())):
            rule, state, declared = self.rules[i]
            if rule.matches(x):
                found |= {(state, k): v for k, v in declared.items()}
        return found
