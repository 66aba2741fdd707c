import pytest

from pagequarry.css import SelectorError, matches, parse, select, select_first
from pagequarry.html import inner_html, outer_html, parse_document, parse_fragment, tree


def frag(s):
    return inner_html(parse_fragment(s).root)


@pytest.mark.parametrize("given, want", [
    ("<article><p><b>X<br><p>Y</p></article><footer>F</footer>", "<article><p><b>X<br></b></p><p><b>Y</b></p></article><footer><b>F</b></footer>"),
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
    ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "<b></b><b>bbb</b><table><tbody><tr><td>aaa</td></tr></tbody></table><b>ccc</b>"),
    ("<a href=x>1<a href=y>2", '<a href="x">1</a><a href="y">2</a>'),
    ("<select><option>1<option>2</select>x", "<select><option>1</option><option>2</option></select>x"),
    ("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>", "<ul><li>1</li><li>2<ul><li>3</li></ul></li><li>4</li></ul>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("a &amp b &am; &notit; &#65;&#x42;", "a &amp; b &amp;am; ¬it; AB"),
    ('<a href="?a=1&copy=2&amp;b">z</a>', '<a href="?a=1&amp;copy=2&amp;b">z</a>'),
    ("<textarea>\n<p></textarea>", "<textarea>&lt;p&gt;</textarea>"),
    ("<script>var t='</p>';</script>", "<script>var t='</p>';</script>"),
    ("<!--a--><!-->x<!doctype html></>y<?pi?>", "<!--a--><!---->xy<!--?pi?-->"),
    ("<h1>a<h2>b</h2>", "<h1>a</h1><h2>b</h2>"),
    ("<svg><g/><title>t</title></svg><p>x", "<svg><g></g><title>t</title></svg><p>x</p>"),
    ("<div a=1 A=2 b='x' c>", '<div a="1" b="x" c=""></div>'),
    ("x</p>y</br>", "x<p></p>y<br>"),
    ("<div a=\"x", ""),
    ("1 < 2 <3", "1 &lt; 2 &lt;3"),
    ("<b><b><b><b><p>x", "<b><b><b><b><p>x</p></b></b></b></b>"),
    ("<p><b><b><b><b>x<p>y", "<p><b><b><b><b>x</b></b></b></b></p><p><b><b><b>y</b></b></b></p>"),
    ("<table><tr><td>1<td>2<tr><th>3</table>", "<table><tbody><tr><td>1</td><td>2</td></tr><tr><th>3</th></tr></tbody></table>"),
    ("a\xa0b", "a&nbsp;b"),
    ("", ""),
])
def test_construction(given, want):
    assert frag(given) == want


def test_documents():
    root = parse_document("<!-- c --><title>abc</title>").root
    assert outer_html(root) == "<html><head><title>abc</title></head><body></body></html>"
    doc = parse_document("<!DOCTYPE html><html a=1><body class=x><p>t</body></html><!--z--><html b=2><body class=y id=q>")
    assert outer_html(doc.root) == '<html a="1" b="2"><head></head><body class="x" id="q"><p>t</p></body></html>'
    assert doc.quirks_mode == "no-quirks" and parse_document("x").quirks_mode == "quirks"
    assert [n.kind for n in doc.tree.children] == ["doctype", "element", "comment"]
    assert select_first(doc.root, "#q").name == "body"  # merged attributes count
    assert outer_html(parse_document(None).root) == "<html><head></head><body></body></html>"


def test_long_and_deep_pages():
    deep = parse_document("<div>" * 3000 + "x")
    assert sum(1 for _ in deep.tree.descendants()) == 3005
    assert outer_html(deep.root).count("<div>") == 3000
    assert len(parse_document("<p>" + "x" * 1_000_000).root.inner_text) == 1_000_000


def test_tree_axes_and_edits():
    a = tree("a", ("b", "d", "e"), "c")
    names = lambda ns: "".join(n.name for n in ns)
    assert [("O" if o else "C") + n.name for o, n in a.traverse()] == "Oa Ob Od Cd Oe Ce Cb Oc Cc Ca".split()
    b, c = a.children
    assert names(a.descendants()) == "abdec" and names(b.last_child.ancestors()) == "ba"
    assert names(c.prev_siblings()) == "b" and names(b.next_siblings()) == "c" and names(a.first_children()) == "bd" and names(a.last_children()) == "c"
    assert b.has_siblings and b.has_children and not a.has_siblings and a.insert_before(tree("x")) is None
    c.take_children(b)
    assert [x.parent.name for x in c.children] == ["c", "c"] and not b.children
    c.prepend(tree("p"))
    c.children[1].insert_after(tree("q"))
    c.children[0].insert_before(tree("o"))
    assert names(c.children) == "opdqe" and c.children[1].detach().parent is None and names(c.children) == "odqe"
    three = tree("t", "1", "2", "3")
    a.take_children(three)
    assert {n.parent for n in a.children[-3:]} == {a}
    assert tree("a", ("b", "c")).same_as(tree("a", ("b", "c"))) and not tree("a", "b", "c").same_as(tree("a", ("b", "c")))


PAGE = '<div id=a class="x Y x"><b>1</b><span><span><b>2</b></span><b lang=en-US>3</b></span></div><p>q<p title="A b">z<template><i>t</i></template>'


@pytest.mark.parametrize("selector, want", [
    ("div > span", "23"), ("b", "1 2 3"), ("span b", "2 3"), ("div > *", "1 23"), ("b:first-child", "1 2"), ("p + p", "zt"), ("p ~ p", "zt"), ("[lang|=en]", "3"), ("[lang|=EN]", "3"), ("[title~=b]", "zt"),
    ("[title~='']", ""), ("[title^='']", ""), ("[title^=a]", ""), ("[title^=a i]", "zt"), (".Y", "123"), (".y", ""), ("#a", "123"), ("#A", ""), ("html", ""), (":root", ""), ("html > body > p", "q zt"), ("i", "t"), ("template i", ""),
    ("b, span b, b", "1 2 3"), ("b:nth-child(2n+1)", "1 2"), ("b:nth-child(-n+1)", "1 2"), ("p:nth-last-of-type(1)", "zt"), ("p:only-of-type", ""), ("b:not(:first-child)", "3"), ("b:not(span > b)", "1"), ("DIV", "123"), ("span:only-child", ""),
])
def test_selectors(selector, want):
    assert " ".join(n.inner_text for n in select(parse_document(PAGE).root, selector)) == want
    assert parse(str(parse(selector))) == parse(selector)


def test_scope_and_accessors():
    root = parse_fragment("<div><b>1</b><span><span><b>2</b></span><b>3</b></span></div>").root
    span = select_first(root, "div > span")
    assert select_first(span, ":scope > b").inner_text == "3" and select_first(span, "div b").inner_text == "2"
    assert not matches("span", root) and not list(select(root, ":root"))
    n = select_first(parse_document(PAGE).root, "div")
    assert n.classes == ["Y", "x"] and n.has_class("y") and n.attr("ID") is None and n.attr("id") == "a"
    assert select_first(parse_document("<link href=x>").root, "link").is_link


@pytest.mark.parametrize("bad, kind", [
    ("<failing selector>", "unexpected-token"), ("", "empty"), ("a >", "dangling-combinator"), ("> a", "dangling-combinator"), ("a:hover", "unsupported-pseudo"), ("::before", "unsupported-pseudo"), (":is(a)", "unsupported-pseudo"),
    (":has(a)", "unsupported-pseudo"), ("a,,b", "empty"), ("[a", "bad-attribute"), ("ns|a", "unknown-namespace"), ("a)", "unexpected-token"), (":nth-child(x)", "bad-nth"), (":nth-child(1 of a)", "bad-nth"), ("#1", "unexpected-token"),
])
def test_selector_errors(bad, kind):
    with pytest.raises(SelectorError) as e:
        parse(bad)
    assert e.value.kind == kind
