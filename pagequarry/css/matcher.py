"""Matching of selectors in trees, right to left, with each parent's sibling numbers counted once."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pagequarry.css.parser import Complex, Selector, parse
from pagequarry.html.tree import DOCUMENT, ELEMENT, TEXT, Node, _ascii_lower

_BLANKS = re.compile(r"[ \t\n\f\r]+")


def attribute_matches(value: str | None, op: str, want: str, fold: bool) -> bool:
    if value is None:
        return False
    if fold:
        value, want = _ascii_lower(value), _ascii_lower(want)
    if op == "":
        return True
    if op == "=":
        return value == want
    if op == "~=":
        return want != "" and want in _BLANKS.split(value)
    if op == "|=":
        return value == want or value.startswith(want + "-")
    if want == "":
        return False
    return value.startswith(want) if op == "^=" else value.endswith(want) if op == "$=" else want in value


def nth_matches(index: int, a: int, b: int) -> bool:
    return index == b if a == 0 else (index - b) % a == 0 and (index - b) // a >= 0


class _Context:
    def __init__(self, scope: Node | None):
        self.scope = scope
        self.numbers: dict[int, dict[int, tuple[int, int, int, int]]] = {}

    def number(self, n: Node) -> tuple[int, int, int, int]:
        """1-based places among sibling elements: from the start, from the end, and both among its type."""
        if n.parent is None:
            return 1, 1, 1, 1
        known = self.numbers.get(id(n.parent))
        if known is None:
            own = [c for c in n.parent.children if c.kind == ELEMENT]
            seen: dict[tuple, int] = {}
            first = []
            for c in own:
                seen[(c.ns, c.name)] = k = seen.get((c.ns, c.name), 0) + 1
                first.append(k)
            known = {id(c): (i + 1, len(own) - i, k, seen[(c.ns, c.name)] - k + 1) for i, (c, k) in enumerate(zip(own, first))}
            self.numbers[id(n.parent)] = known
        return known[id(n)]


def _test(t: tuple, n: Node, ctx: _Context) -> bool:
    kind = t[0]
    if kind == "type":
        return n.name == (t[1] if n.ns == "html" else t[2])
    if kind == "any":
        return True
    if kind == "class":
        return t[1] in n.class_list
    if kind == "id":
        return n.id == t[1]
    if kind == "attr":
        return attribute_matches(n.attrs.get(t[1]), t[2], t[3], t[4])
    if kind == "nth":
        return nth_matches(ctx.number(n)[2 * t[3] + t[4]], t[1], t[2])
    if kind == "only":
        return ctx.number(n)[2 * t[1] : 2 * t[1] + 2] == (1, 1)
    if kind == "not":
        return not any(_complex(c, n, ctx) for c in t[1].parts)
    if kind == "empty":
        return not any(c.kind in (ELEMENT, TEXT) for c in n.children)
    if kind == "root":
        return n.parent is not None and n.parent.kind == DOCUMENT
    return n is ctx.scope if ctx.scope is not None else n.parent is not None and n.parent.kind == DOCUMENT  # scope


def _previous(n: Node) -> Iterator[Node]:
    return (s for s in n.prev_siblings() if s.kind == ELEMENT)


def _complex(c: Complex, n: Node, ctx: _Context, at: int = -1) -> bool:
    at = at if at >= 0 else len(c.compounds) - 1
    if not all([_test(t, n, ctx) for t in c.compounds[at]]):
        return False
    if at == 0:
        return True
    how = c.combinators[at - 1]
    if how in "+~":
        for s in _previous(n):
            if _complex(c, s, ctx, at - 1):
                return True
            if how == "+":
                return False
        return False
    up = n.parent
    while up is not None and up.kind == ELEMENT:  # a template's contents have no parent element
        if _complex(c, up, ctx, at - 1):
            return True
        if how == ">":
            return False
        up = up.parent
    return False


def _selector(s: str | Selector) -> Selector:
    return parse(s) if isinstance(s, str) else s


def matches(selector: str | Selector, node: Node, scope: Node | None = None) -> bool:
    ctx = _Context(scope)
    return node.kind == ELEMENT and any(_complex(c, node, ctx) for c in _selector(selector).parts)


def select(scope: Node, selector: str | Selector) -> Iterator[Node]:
    """Matching descendants of ``scope``, without itself, in document order and once each."""
    parts, ctx = _selector(selector).parts, _Context(scope)
    for n in scope.descendants():
        if n.kind == ELEMENT and n is not scope and any(_complex(c, n, ctx) for c in parts):
            yield n


def select_first(scope: Node, selector: str | Selector) -> Node | None:
    return next(select(scope, selector), None)
