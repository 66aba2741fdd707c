"""HTML text of trees, by the standard's fragment serialisation with scripting off."""

from __future__ import annotations

from pagequarry.html.tree import COMMENT, DOCTYPE, ELEMENT, TEXT, Node

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("style script xmp iframe noembed noframes plaintext".split())


def _text(s: str) -> str:
    return s.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def _value(s: str) -> str:
    return s.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace('"', "&quot;")


def _write(node: Node, out: list[str], itself: bool) -> None:
    for opens, n in node.traverse():
        if n is node and not itself:
            continue
        if n.kind == ELEMENT:
            if opens:
                out.append(f"<{n.name}" + "".join([f' {k}="{_value(v)}"' for k, v in n.attrs.items()]) + ">")
            elif n.name not in VOID:
                out.append(f"</{n.name}>")
        elif not opens:
            continue
        elif n.kind == TEXT:
            out.append(n.text if n.parent is not None and n.parent.kind == ELEMENT and n.parent.name in RAW else _text(n.text))
        elif n.kind == COMMENT:
            out.append(f"<!--{n.text}-->")
        elif n.kind == DOCTYPE:
            out.append(f"<!DOCTYPE {n.name}>")


def inner_html(node: Node) -> str:
    out: list[str] = []
    _write(node, out, False)
    return "".join(out)


def outer_html(node: Node) -> str:
    out: list[str] = []
    _write(node, out, True)
    return "".join(out)
