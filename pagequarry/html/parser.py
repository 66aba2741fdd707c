"""Tokenizer and tree construction of the HTML standard, scripting on, without framesets.

Never raises on any input; what the standard calls parse errors is collected in part."""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

from pagequarry.html.tree import COMMENT, DOCTYPE, DOCUMENT, ELEMENT, FRAGMENT, TEXT, Node

_ = frozenset
FORMATTING = _("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = _("h1 h2 h3 h4 h5 h6".split())
SPECIAL = _(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select "
    "source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
BLOCKS = _("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul".split())
SCOPE = _("applet caption html table td th marquee object template".split())
LIST_SCOPE = SCOPE | {"ol", "ul"}
BUTTON_SCOPE = SCOPE | {"button"}
TABLE_SCOPE = _("html table template".split())
IMPLIED = _("dd dt li optgroup option p rb rp rt rtc".split())
HEAD_TAGS = _("base basefont bgsound link meta noframes noscript script style template title".split())
VOIDS = _("area br embed img keygen wbr".split())
RCDATA, RAWTEXT = _({"title", "textarea"}), _("style xmp iframe noembed noframes script noscript".split())
BREAKOUT = _(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SPACE = " \t\n\f\r"
QUIRKS = re.compile(r"^(?:-//w3c//dtd html (?:3|4\.0 (?:frameset|transitional))|-//ietf//dtd html|html$|-//w3c//dtd w3 html)", re.I)

_TAG = re.compile(r"<(/?)([A-Za-z][^\t\n\f\r />]*)")
_ATTR = re.compile(r"[\t\n\f\r /]*(?:(>)|([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^\t\n\f\r >]*)))?)")
_REF = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z0-9]+;?)")
_DOCTYPE = re.compile(r"\s*([^\s>]*)\s*(?:(public|system)\s*(?:\"([^\">]*)\"?|'([^'>]*)'?)?\s*(?:\"([^\">]*)\"?|'([^'>]*)'?)?)?", re.I)


def _in_value(s: str) -> str:
    if "&" not in s:
        return s

    def one(m: re.Match) -> str:
        ref = m.group()
        if ref[1] == "#" or ref.endswith(";"):
            return unescape(ref)
        following = s[m.end() : m.end() + 1]
        return html5[ref[1:]] if ref[1:] in html5 and following != "=" else ref

    return _REF.sub(one, s)


class Document:
    """A parsed page: ``tree`` (a document or fragment node), ``errors`` and ``quirks_mode``."""

    def __init__(self, tree: Node, errors: list[str], quirks_mode: str):
        self.tree, self.errors, self.quirks_mode = tree, errors, quirks_mode

    @property
    def root(self) -> Node:
        for c in self.tree.children:
            if c.kind == ELEMENT:
                return c
        raise ValueError("a tree without a root element")


class _Marker:
    pass


MARKER = _Marker()


class _Builder:
    def __init__(self, fragment: bool):
        self.top = Node(FRAGMENT if fragment else DOCUMENT)
        self.errors: list[str] = []
        self.quirks = "no-quirks"
        self.stack: list[Node] = []
        self.active: list = []
        self.head: Node | None = None
        self.form: Node | None = None
        self.mode = self.initial
        self.after_text = self.in_body
        self.raw: str | None = None  # the tokenizer reads text up to this end tag
        self.foster = self.skip_newline = False
        self.templates: list = []
        self.fragment = fragment
        if fragment:
            root = Node(ELEMENT, "html", ns="html")
            self.top.append(root)
            self.stack.append(root)
            self.mode = self.in_body

    # places and insertions
    @property
    def current(self) -> Node:
        return self.stack[-1]

    def place(self, target: Node | None = None) -> tuple[Node, Node | None]:
        """Parent, and the child before which to insert (None: at the end)."""
        target = target or self.current
        if self.foster and target.name in ("table", "tbody", "tfoot", "thead", "tr"):
            for i in range(len(self.stack) - 1, -1, -1):
                n = self.stack[i]
                if n.name == "template":
                    return n.children[0], None
                if n.name == "table":
                    return (n.parent, n) if n.parent is not None else (self.stack[i - 1], None)
            return self.stack[0], None
        if target.name == "template" and target.ns == "html":
            return target.children[0], None
        return target, None

    @staticmethod
    def put(node: Node, where: tuple[Node, Node | None]) -> None:
        parent, before = where
        if before is None:
            parent.append(node)
        else:
            before.insert_before(node)

    def text(self, data: str) -> None:
        parent, before = self.place()
        if parent.kind == DOCUMENT:
            return
        last = parent.last_child if before is None else before.prev_sibling
        if last is not None and last.kind == TEXT:
            last.text += data
        else:
            self.put(Node(TEXT, text=data), (parent, before))

    def comment(self, data: str, parent: Node | None = None) -> None:
        self.put(Node(COMMENT, text=data), (parent, None) if parent else self.place())

    def element(self, name: str, attrs: dict[str, str], ns: str = "html") -> Node:
        node = Node(ELEMENT, name, attrs=attrs, ns=ns)
        if name == "template" and ns == "html":
            node.append(Node(FRAGMENT))
        self.put(node, self.place())
        self.stack.append(node)
        return node

    # the stack
    def has(self, names, stop=SCOPE) -> bool:
        for n in reversed(self.stack):
            if n.ns == "html":
                if n.name in names:
                    return True
                if n.name in stop:
                    return False
            elif n.name in ("foreignObject", "desc", "title", "mi", "mo", "mn", "ms", "mtext", "annotation-xml"):
                return False
        return False

    def holds(self, name: str) -> bool:
        return any(n.name == name and n.ns == "html" for n in self.stack)

    def pop_to(self, names) -> None:
        while self.stack:
            n = self.stack.pop()
            if n.ns == "html" and n.name in names:
                break

    def back_to(self, names) -> None:
        while self.current.name not in names:
            self.stack.pop()

    def implied(self, but: str = "") -> None:
        while self.current.name in IMPLIED and self.current.name != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.has(("p",), BUTTON_SCOPE):
            self.implied("p")
            self.pop_to(("p",))

    # active formatting elements
    def reconstruct(self) -> None:
        a = self.active
        if not a or a[-1] is MARKER or a[-1] in self.stack:
            return
        i = len(a) - 1
        while i > 0 and a[i - 1] is not MARKER and a[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(a)):
            a[k] = self.element(a[k].name, dict(a[k].attrs))

    def push_active(self, node: Node) -> None:
        same = []
        for n in reversed(self.active):
            if n is MARKER:
                break
            if n.name == node.name and n.attrs == node.attrs:
                same.append(n)
        if len(same) >= 3:
            self._drop(same[-1])
        self.active.append(node)

    def _drop(self, node: Node) -> None:
        self.active = [n for n in self.active if n is not node]

    def to_marker(self) -> None:
        while self.active and self.active.pop() is not MARKER:
            pass

    def adoption(self, name: str) -> None:
        if self.current.name == name and self.current.ns == "html" and not any(n is self.current for n in self.active):
            self.stack.pop()
            return
        for _ in range(8):
            fmt = None
            for n in reversed(self.active):
                if n is MARKER:
                    break
                if n.name == name:
                    fmt = n
                    break
            if fmt is None:
                return self.any_end(name)
            at = next((i for i, n in enumerate(self.stack) if n is fmt), None)
            if at is None:
                return self._drop(fmt)
            if not self._in_scope_node(fmt):
                return None
            far = next((n for n in self.stack[at + 1 :] if n.name in SPECIAL and n.ns == "html"), None)
            if far is None:
                del self.stack[at:]
                return self._drop(fmt)
            ancestor = self.stack[at - 1]
            mark = next(i for i, n in enumerate(self.active) if n is fmt)
            i = next(i for i, n in enumerate(self.stack) if n is far)
            last, inner = far, 0
            while True:
                i -= 1
                inner += 1
                node = self.stack[i]
                if node is fmt:
                    break
                k = next((k for k, n in enumerate(self.active) if n is node), None)
                if inner > 3 and k is not None:
                    del self.active[k]
                    mark -= k < mark
                    k = None
                if k is None:
                    del self.stack[i]
                    continue
                new = Node(ELEMENT, node.name, attrs=dict(node.attrs), ns="html")
                self.active[k] = self.stack[i] = new
                if last is far:
                    mark = k + 1
                new.append(last)
                last = new
            last.detach()
            self.put(last, self.place(ancestor))
            new = Node(ELEMENT, fmt.name, attrs=dict(fmt.attrs), ns="html")
            new.take_children(far)
            far.append(new)
            k = next(k for k, n in enumerate(self.active) if n is fmt)
            del self.active[k]
            self.active.insert(mark - (k < mark), new)
            self.stack = [n for n in self.stack if n is not fmt]
            self.stack.insert(next(i for i, n in enumerate(self.stack) if n is far) + 1, new)
        return None

    def _in_scope_node(self, node: Node) -> bool:
        for n in reversed(self.stack):
            if n is node:
                return True
            if n.ns == "html" and n.name in SCOPE:
                return False
        return False

    def any_end(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            n = self.stack[i]
            if n.name == name and n.ns == "html":
                self.implied(name)
                i = next(k for k, x in enumerate(self.stack) if x is n) if n in self.stack else i
                del self.stack[i:]
                return
            if n.name in SPECIAL and n.ns == "html":
                return

    def reset(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i].name
            if name == "select":
                self.mode = self.in_select
            elif name in ("td", "th") and i:
                self.mode = self.in_cell
            elif name == "tr":
                self.mode = self.in_row
            elif name in ("tbody", "thead", "tfoot"):
                self.mode = self.in_table_body
            elif name == "caption":
                self.mode = self.in_caption
            elif name == "colgroup":
                self.mode = self.in_colgroup
            elif name == "table":
                self.mode = self.in_table
            elif name == "template":
                self.mode = self.templates[-1] if self.templates else self.in_body
            elif name == "head" and i:
                self.mode = self.in_head
            elif name == "body" or self.fragment and i == 0:
                self.mode = self.in_body
            elif name == "html":
                self.mode = self.before_head if self.head is None else self.after_head
            else:
                continue
            return

    # tokens: (kind, name or data, attributes, self-closing), kinds S E T C D and Z for the end
    def feed(self, kind: str, name: str, attrs=None, closed: bool = False) -> None:
        if self.skip_newline:
            self.skip_newline = False
            if kind == "T" and name.startswith("\n"):
                name = name[1:]
                if not name:
                    return
        if kind == "D" and self.mode != self.initial:
            self.errors.append("Unexpected doctype")
            return
        if self.stack and self.current.ns != "html" and kind != "Z" and not self._html_in_foreign(kind, name):
            self.foreign(kind, name, attrs, closed)
        else:
            self.mode(kind, name, attrs, closed)

    def _html_in_foreign(self, kind: str, name: str) -> bool:
        n = self.current
        if n.ns == "svg" and n.name in ("foreignObject", "desc", "title"):
            return kind in "ST"
        return n.ns == "math" and n.name in ("mi", "mo", "mn", "ms", "mtext") and (kind == "T" or kind == "S" and name not in ("mglyph", "malignmark"))

    def foreign(self, kind, name, attrs, closed) -> None:
        if kind == "T":
            self.text(name)
        elif kind == "C":
            self.comment(name)
        elif kind == "S":
            if name in BREAKOUT or name == "font" and {"color", "face", "size"} & set(attrs):
                while self.current.ns != "html" and not self._html_in_foreign("S", name):
                    self.stack.pop()
                self.mode(kind, name, attrs, closed)
                return
            ns = self.current.ns
            name = {"foreignobject": "foreignObject", "lineargradient": "linearGradient", "radialgradient": "radialGradient", "clippath": "clipPath", "textpath": "textPath"}.get(name, name) if ns == "svg" else name
            self.element(name, attrs, ns)
            if closed:
                self.stack.pop()
        else:
            for i in range(len(self.stack) - 1, 0, -1):
                n = self.stack[i]
                if n.ns == "html":
                    self.mode(kind, name, attrs, closed)
                    return
                if n.name.lower() == name:
                    del self.stack[i:]
                    return

    def _blank_then_rest(self, data: str) -> tuple[str, str]:
        rest = data.lstrip(SPACE)
        return data[: len(data) - len(rest)], rest

    def initial(self, kind, name, attrs, closed) -> None:
        if kind == "T":
            name = name.lstrip(SPACE)
            if not name:
                return
        if kind == "C":
            return self.comment(name, self.top)
        if kind == "D":
            node = Node(DOCTYPE, attrs[0])
            node.public_id, node.system_id = attrs[1] or "", attrs[2] or ""
            self.top.append(node)
            if attrs[0] != "html" or attrs[1] and QUIRKS.match(attrs[1]) or attrs[3]:
                self.quirks = "quirks"
            elif attrs[1] and re.match(r"-//w3c//dtd (?:xhtml 1\.0|html 4\.01) (?:frameset|transitional)", attrs[1], re.I):
                self.quirks = "limited-quirks" if "xhtml" in attrs[1].lower() or attrs[2] else "quirks"
            self.mode = self.before_html
            return None
        self.errors.append("Unexpected token")
        self.quirks = "quirks"
        self.mode = self.before_html
        return self.mode(kind, name, attrs, closed)

    def before_html(self, kind, name, attrs, closed) -> None:
        if kind == "C":
            return self.comment(name, self.top)
        if kind == "T":
            name = name.lstrip(SPACE)
            if not name:
                return None
        if kind == "E" and name not in ("head", "body", "html", "br"):
            return None
        root = Node(ELEMENT, "html", attrs=attrs if kind == "S" and name == "html" else {}, ns="html")
        self.top.append(root)
        self.stack.append(root)
        self.mode = self.before_head
        if not (kind == "S" and name == "html"):
            self.mode(kind, name, attrs, closed)
        return None

    def before_head(self, kind, name, attrs, closed) -> None:
        if kind == "T":
            name = name.lstrip(SPACE)
            if not name:
                return None
        if kind == "C":
            return self.comment(name)
        if kind == "S" and name == "html":
            return self.in_body(kind, name, attrs, closed)
        if kind == "E" and name not in ("head", "body", "html", "br"):
            return None
        own = kind == "S" and name == "head"
        self.head = self.element("head", attrs if own else {})
        self.mode = self.in_head
        if not own:
            self.mode(kind, name, attrs, closed)
        return None

    def in_head(self, kind, name, attrs, closed) -> None:
        if kind == "T":
            blank, name = self._blank_then_rest(name)
            if blank:
                self.text(blank)
            if not name:
                return None
        elif kind == "C":
            return self.comment(name)
        elif kind == "S":
            if name == "html":
                return self.in_body(kind, name, attrs, closed)
            if name in ("base", "basefont", "bgsound", "link", "meta"):
                self.element(name, attrs)
                self.stack.pop()
                return None
            if name in RCDATA or name in RAWTEXT:
                return self.raw_element(name, attrs)
            if name == "template":
                self.element(name, attrs)
                self.active.append(MARKER)
                self.mode = self.in_template
                self.templates.append(self.in_template)
                return None
            if name == "head":
                return None
        elif kind == "E":
            if name == "head":
                self.stack.pop()
                self.mode = self.after_head
                return None
            if name == "template":
                if self.holds("template"):
                    while self.current.name in IMPLIED or self.current.name in ("caption", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
                        self.stack.pop()
                    self.pop_to(("template",))
                    self.to_marker()
                    if self.templates:
                        self.templates.pop()
                    self.reset()
                return None
            if name not in ("body", "html", "br"):
                return None
        self.stack.pop()
        self.mode = self.after_head
        return self.mode(kind, name, attrs, closed)

    def raw_element(self, name, attrs) -> None:
        self.element(name, attrs)
        self.raw = name
        self.after_text = self.mode
        self.mode = self.in_text

    def in_text(self, kind, name, attrs, closed) -> None:
        if kind == "T":
            self.text(name)
            return
        self.stack.pop()
        self.mode = self.after_text
        if kind == "Z":
            self.mode(kind, name, attrs, closed)

    def after_head(self, kind, name, attrs, closed) -> None:
        if kind == "T":
            blank, name = self._blank_then_rest(name)
            if blank:
                self.text(blank)
            if not name:
                return None
        elif kind == "C":
            return self.comment(name)
        elif kind == "S":
            if name == "html":
                return self.in_body(kind, name, attrs, closed)
            if name == "body":
                self.element(name, attrs)
                self.mode = self.in_body
                return None
            if name in HEAD_TAGS:
                self.stack.append(self.head)
                self.in_head(kind, name, attrs, closed)
                self.stack = [n for n in self.stack if n is not self.head]
                return None
            if name == "head":
                return None
        elif kind == "E":
            if name == "template":
                return self.in_head(kind, name, attrs, closed)
            if name not in ("body", "html", "br"):
                return None
        self.element("body", {})
        self.mode = self.in_body
        return self.mode(kind, name, attrs, closed)

    def in_body(self, kind, name, attrs, closed) -> None:
        if kind == "T":
            self.reconstruct()
            self.text(name)
        elif kind == "C":
            self.comment(name)
        elif kind == "S":
            self.start_in_body(name, attrs, closed)
        elif kind == "E":
            self.end_in_body(name, attrs, closed)
        elif self.templates:
            self.in_template(kind, name, attrs, closed)

    def start_in_body(self, name, attrs, closed) -> None:
        if name in BLOCKS:
            self.close_p()
            self.element(name, attrs)
        elif name in FORMATTING:
            if name == "a":
                for n in reversed(self.active):
                    if n is MARKER:
                        break
                    if n.name == "a":
                        self.adoption("a")
                        self._drop(n)
                        self.stack = [x for x in self.stack if x is not n]
                        break
            self.reconstruct()
            if name == "nobr" and self.has(("nobr",)):
                self.adoption("nobr")
                self.reconstruct()
            self.push_active(self.element(name, attrs))
        elif name in ("html", "body"):
            if name == "html":
                if self.templates:
                    return
                at = self.stack[0]
            elif len(self.stack) > 1 and self.stack[1].name == "body" and not self.templates:
                at = self.stack[1]
            else:
                return
            for k, v in attrs.items():
                at.attrs.setdefault(k, v)
        elif name == "li":
            self._close_item(("li",))
            self.element(name, attrs)
        elif name in ("dd", "dt"):
            self._close_item(("dd", "dt"))
            self.element(name, attrs)
        elif name in HEADINGS:
            self.close_p()
            if self.current.name in HEADINGS:
                self.stack.pop()
            self.element(name, attrs)
        elif name in VOIDS:
            self.reconstruct()
            self.element(name, attrs)
            self.stack.pop()
        elif name in ("title",) or name in HEAD_TAGS and name != "noscript":
            self.in_head("S", name, attrs, closed)
        elif name in ("pre", "listing"):
            self.close_p()
            self.element(name, attrs)
            self.skip_newline = True
        elif name == "form":
            if self.form is None or self.holds("template"):
                self.close_p()
                node = self.element(name, attrs)
                if not self.holds("template"):
                    self.form = node
        elif name == "table":
            if self.quirks != "quirks":
                self.close_p()
            self.element(name, attrs)
            self.mode = self.in_table
        elif name == "hr":
            self.close_p()
            self.element(name, attrs)
            self.stack.pop()
        elif name == "input":
            self.reconstruct()
            self.element(name, attrs)
            self.stack.pop()
        elif name in ("param", "source", "track"):
            self.element(name, attrs)
            self.stack.pop()
        elif name == "image":
            self.start_in_body("img", attrs, closed)
        elif name == "textarea":
            self.raw_element(name, attrs)
            self.skip_newline = True
        elif name == "xmp":
            self.close_p()
            self.reconstruct()
            self.raw_element(name, attrs)
        elif name in ("iframe", "noembed", "noscript"):
            self.raw_element(name, attrs)
        elif name == "plaintext":
            self.close_p()
            self.element(name, attrs)
            self.raw = "plaintext"
        elif name == "button":
            if self.has(("button",)):
                self.implied()
                self.pop_to(("button",))
            self.reconstruct()
            self.element(name, attrs)
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.element(name, attrs)
            self.active.append(MARKER)
        elif name == "select":
            self.reconstruct()
            self.element(name, attrs)
            self.mode = self.in_select
        elif name in ("optgroup", "option"):
            if self.current.name == "option":
                self.stack.pop()
            self.reconstruct()
            self.element(name, attrs)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.has(("ruby",)):
                self.implied("rtc" if name in ("rp", "rt") else "")
            self.element(name, attrs)
        elif name in ("svg", "math"):
            self.reconstruct()
            self.element(name, attrs, name)
            if closed:
                self.stack.pop()
        elif name in ("caption", "col", "colgroup", "frame", "frameset", "head", "tbody", "td", "tfoot", "th", "thead", "tr"):
            self.errors.append("Unexpected start tag")
        else:
            self.reconstruct()
            self.element(name, attrs)

    def _close_item(self, names) -> None:
        for n in reversed(self.stack):
            if n.name in names:
                self.implied(n.name)
                self.pop_to((n.name,))
                break
            if n.name in SPECIAL and n.name not in ("address", "div", "p"):
                break
        self.close_p()

    def end_in_body(self, name, attrs, closed) -> None:
        if name in FORMATTING:
            self.adoption(name)
        elif name == "p":
            if not self.has(("p",), BUTTON_SCOPE):
                self.element("p", {})
            self.close_p()
        elif name in ("body", "html"):
            if self.has(("body",)):
                self.mode = self.after_body
                if name == "html":
                    self.mode("E", name, attrs, closed)
        elif name == "form":
            if self.holds("template"):
                if self.has(("form",)):
                    self.implied()
                    self.pop_to(("form",))
                return
            node, self.form = self.form, None
            if node is not None and self._in_scope_node(node):
                self.implied()
                self.stack = [n for n in self.stack if n is not node]
        elif name == "li":
            if self.has(("li",), LIST_SCOPE):
                self.implied("li")
                self.pop_to(("li",))
        elif name in BLOCKS or name in ("button", "listing", "pre", "dd", "dt"):
            if self.has((name,)):
                self.implied(name if name in ("dd", "dt") else "")
                self.pop_to((name,))
        elif name in HEADINGS:
            if self.has(HEADINGS):
                self.implied()
                self.pop_to(HEADINGS)
        elif name in ("applet", "marquee", "object"):
            if self.has((name,)):
                self.implied()
                self.pop_to((name,))
                self.to_marker()
        elif name == "br":
            self.start_in_body("br", {}, False)
        elif name == "template":
            self.in_head("E", name, attrs, closed)
        else:
            self.any_end(name)

    def fostered(self, kind, name, attrs, closed) -> None:
        self.foster = True
        self.in_body(kind, name, attrs, closed)
        self.foster = False

    def in_table(self, kind, name, attrs, closed) -> None:
        if kind == "T":
            if name.strip(SPACE):
                self.fostered(kind, name, attrs, closed)
            else:
                self.text(name)
        elif kind == "C":
            self.comment(name)
        elif kind == "S":
            if name == "caption":
                self.back_to(TABLE_SCOPE)
                self.active.append(MARKER)
                self.element(name, attrs)
                self.mode = self.in_caption
            elif name in ("colgroup", "col"):
                self.back_to(TABLE_SCOPE)
                self.element("colgroup", attrs if name == "colgroup" else {})
                self.mode = self.in_colgroup
                if name == "col":
                    self.mode(kind, name, attrs, closed)
            elif name in ("tbody", "tfoot", "thead", "td", "th", "tr"):
                self.back_to(TABLE_SCOPE)
                own = name in ("tbody", "tfoot", "thead")
                self.element(name if own else "tbody", attrs if own else {})
                self.mode = self.in_table_body
                if not own:
                    self.mode(kind, name, attrs, closed)
            elif name == "table":
                if self.has(("table",), TABLE_SCOPE):
                    self.pop_to(("table",))
                    self.reset()
                    self.mode(kind, name, attrs, closed)
            elif name in ("style", "script", "template"):
                self.in_head(kind, name, attrs, closed)
            elif name == "input" and attrs.get("type", "").lower() == "hidden":
                self.element(name, attrs)
                self.stack.pop()
            elif name == "form":
                if self.form is None and not self.holds("template"):
                    self.form = self.element(name, attrs)
                    self.stack.pop()
            else:
                self.fostered(kind, name, attrs, closed)
        elif kind == "E":
            if name == "table":
                if self.has(("table",), TABLE_SCOPE):
                    self.pop_to(("table",))
                    self.reset()
            elif name == "template":
                self.in_head(kind, name, attrs, closed)
            elif name not in ("body", "caption", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr"):
                self.fostered(kind, name, attrs, closed)
        else:
            self.in_body(kind, name, attrs, closed)

    def in_caption(self, kind, name, attrs, closed) -> None:
        ends = kind == "E" and name in ("caption", "table") or kind == "S" and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr")
        if ends:
            if self.has(("caption",), TABLE_SCOPE):
                self.implied()
                self.pop_to(("caption",))
                self.to_marker()
                self.mode = self.in_table
                if name != "caption" or kind == "S":
                    self.mode(kind, name, attrs, closed)
        elif not (kind == "E" and name in ("body", "col", "colgroup", "html", "tbody", "td", "tfoot", "th", "thead", "tr")):
            self.in_body(kind, name, attrs, closed)

    def in_colgroup(self, kind, name, attrs, closed) -> None:
        if kind == "T":
            blank, name = self._blank_then_rest(name)
            if blank:
                self.text(blank)
            if not name:
                return
        elif kind == "C":
            self.comment(name)
            return
        elif kind == "S" and name == "col":
            self.element(name, attrs)
            self.stack.pop()
            return
        elif kind in "SE" and name == "template":
            self.in_head(kind, name, attrs, closed)
            return
        elif kind == "E" and name == "col":
            return
        if self.current.name == "colgroup":
            self.stack.pop()
            self.mode = self.in_table
            if not (kind == "E" and name == "colgroup"):
                self.mode(kind, name, attrs, closed)
        elif kind == "Z":
            self.in_body(kind, name, attrs, closed)

    def in_table_body(self, kind, name, attrs, closed) -> None:
        scope = ("tbody", "tfoot", "thead", "template", "html")
        if kind == "S" and name in ("tr", "td", "th"):
            self.back_to(scope)
            self.element("tr", attrs if name == "tr" else {})
            self.mode = self.in_row
            if name != "tr":
                self.mode(kind, name, attrs, closed)
        elif kind == "E" and name in ("tbody", "tfoot", "thead"):
            if self.has((name,), TABLE_SCOPE):
                self.back_to(scope)
                self.stack.pop()
                self.mode = self.in_table
        elif kind == "S" and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead") or kind == "E" and name == "table":
            if self.has(("tbody", "tfoot", "thead"), TABLE_SCOPE):
                self.back_to(scope)
                self.stack.pop()
                self.mode = self.in_table
                self.mode(kind, name, attrs, closed)
        elif not (kind == "E" and name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr")):
            self.in_table(kind, name, attrs, closed)

    def in_row(self, kind, name, attrs, closed) -> None:
        scope = ("tr", "template", "html")
        if kind == "S" and name in ("td", "th"):
            self.back_to(scope)
            self.element(name, attrs)
            self.mode = self.in_cell
            self.active.append(MARKER)
        elif kind == "E" and name in ("tr", "table", "tbody", "tfoot", "thead") or kind == "S" and name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
            if not self.has(("tr",), TABLE_SCOPE) or kind == "E" and name in ("tbody", "tfoot", "thead") and not self.has((name,), TABLE_SCOPE):
                return
            self.back_to(scope)
            self.stack.pop()
            self.mode = self.in_table_body
            if not (kind == "E" and name == "tr"):
                self.mode(kind, name, attrs, closed)
        elif not (kind == "E" and name in ("body", "caption", "col", "colgroup", "html", "td", "th")):
            self.in_table(kind, name, attrs, closed)

    def _close_cell(self) -> None:
        self.implied()
        self.pop_to(("td", "th"))
        self.to_marker()
        self.mode = self.in_row

    def in_cell(self, kind, name, attrs, closed) -> None:
        if kind == "E" and name in ("td", "th"):
            if self.has((name,), TABLE_SCOPE):
                self.implied()
                self.pop_to((name,))
                self.to_marker()
                self.mode = self.in_row
        elif kind == "S" and name in ("caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr"):
            if self.has(("td", "th"), TABLE_SCOPE):
                self._close_cell()
                self.mode(kind, name, attrs, closed)
        elif kind == "E" and name in ("table", "tbody", "tfoot", "thead", "tr"):
            if self.has((name,), TABLE_SCOPE):
                self._close_cell()
                self.mode(kind, name, attrs, closed)
        elif not (kind == "E" and name in ("body", "caption", "col", "colgroup", "html")):
            self.in_body(kind, name, attrs, closed)

    def in_select(self, kind, name, attrs, closed) -> None:
        if kind == "T":
            self.text(name)
        elif kind == "C":
            self.comment(name)
        elif kind == "S":
            if name in ("option", "optgroup"):
                if self.current.name == "option":
                    self.stack.pop()
                if name == "optgroup" and self.current.name == "optgroup":
                    self.stack.pop()
                self.element(name, attrs)
            elif name == "hr":
                self.element(name, attrs)
                self.stack.pop()
            elif name in ("select", "input", "keygen", "textarea") or name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th") and self.has(("table",), TABLE_SCOPE):
                self.pop_to(("select",))
                self.reset()
                if name != "select":
                    self.mode(kind, name, attrs, closed)
            elif name in ("script", "template"):
                self.in_head(kind, name, attrs, closed)
        elif kind == "E":
            if name == "optgroup":
                if self.current.name == "option" and self.stack[-2].name == "optgroup":
                    self.stack.pop()
                if self.current.name == "optgroup":
                    self.stack.pop()
            elif name == "option":
                if self.current.name == "option":
                    self.stack.pop()
            elif name == "select":
                self.pop_to(("select",))
                self.reset()
            elif name in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th") and self.has((name,), TABLE_SCOPE):
                self.pop_to(("select",))
                self.reset()
                self.mode(kind, name, attrs, closed)
            elif name == "template":
                self.in_head(kind, name, attrs, closed)
        else:
            self.in_body(kind, name, attrs, closed)

    def in_template(self, kind, name, attrs, closed) -> None:
        if kind in "TC":
            self.in_body(kind, name, attrs, closed)
        elif kind == "S" and name in HEAD_TAGS or kind == "E" and name == "template":
            self.in_head(kind, name, attrs, closed)
        elif kind == "S":
            mode = {"caption": self.in_table, "colgroup": self.in_table, "tbody": self.in_table, "tfoot": self.in_table, "thead": self.in_table, "col": self.in_colgroup, "tr": self.in_table_body, "td": self.in_row, "th": self.in_row}.get(name, self.in_body)
            if self.templates:
                self.templates[-1] = mode
            self.mode = mode
            self.mode(kind, name, attrs, closed)
        elif kind == "Z" and self.holds("template"):
            self.pop_to(("template",))
            self.to_marker()
            if self.templates:
                self.templates.pop()
            self.reset()
            self.mode(kind, name, attrs, closed)

    def after_body(self, kind, name, attrs, closed) -> None:
        if kind == "C":
            self.comment(name, self.stack[0])
        elif kind == "T" and not name.strip(SPACE) or kind == "S" and name == "html":
            self.in_body(kind, name, attrs, closed)
        elif kind == "E" and name == "html":
            self.mode = self.after_all
        elif kind != "Z":
            self.mode = self.in_body
            self.mode(kind, name, attrs, closed)

    def after_all(self, kind, name, attrs, closed) -> None:
        if kind == "C":
            self.comment(name, self.top)
        elif kind == "T" and not name.strip(SPACE) or kind == "S" and name == "html":
            self.in_body(kind, name, attrs, closed)
        elif kind != "Z":
            self.mode = self.in_body
            self.mode(kind, name, attrs, closed)


def _run(b: _Builder, html: str) -> None:
    s = html.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    at, n, feed = 0, len(s), b.feed
    while at < n:
        if b.raw:
            name, b.raw = b.raw, None
            end = None if name == "plaintext" else re.compile(rf"</{name}(?=[\t\n\f />])", re.I).search(s, at)
            data = s[at : end.start()] if end else s[at:]
            if data:
                feed("T", unescape(data) if name in RCDATA else data)
            at = end.start() if end else n
            if not end:
                b.errors.append("Unexpected end of raw text")
            elif b.mode == b.in_text:
                at = s.find(">", end.end()) + 1 or n
                feed("E", name)
            continue
        lt = s.find("<", at)
        while lt >= 0 and not (s[lt + 1 : lt + 2].isascii() and s[lt + 1 : lt + 2].isalpha() or s[lt + 1 : lt + 2] in ("/", "!", "?")):
            lt = s.find("<", lt + 1)
        if lt < 0:
            lt = n
        if lt > at:
            data = s[at:lt]
            feed("T", unescape(data) if "&" in data else data)
            at = lt
            continue
        tag = _TAG.match(s, at)
        if tag:
            attrs: dict[str, str] = {}
            p, closed = tag.end(), False
            while True:
                m = _ATTR.match(s, p)
                if m is None:
                    p = None
                    break
                if m.group(1):
                    closed = s[m.end() - 2] == "/"
                    p = m.end()
                    break
                key = m.group(2).lower()
                value = m.group(3) if m.group(3) is not None else m.group(4) if m.group(4) is not None else m.group(5)
                if m.end() == m.end(2) and re.match(r"[\t\n\f ]*=[\t\n\f ]*[\"']", s[m.end() :][:64]):
                    p = None  # a quote that is never closed
                    break
                attrs.setdefault(key, _in_value(value) if value else "")
                p = m.end()
            if p is None:
                b.errors.append("Unexpected end of file in a tag")
                break
            at = p
            name = tag.group(2).lower()
            if tag.group(1):
                feed("E", name)
            else:
                feed("S", name, attrs, closed)
            continue
        if s.startswith("<!--", at):
            if s.startswith(">", at + 4) or s.startswith("->", at + 4):
                feed("C", "")
                at = s.index(">", at) + 1
                continue
            end = re.compile(r"--!?>").search(s, at + 4)
            feed("C", s[at + 4 : end.start()] if end else s[at + 4 :])
            at = end.end() if end else n
        elif s[at + 2 : at + 9].lower() == "doctype" and s[at + 1] == "!":
            end = s.find(">", at)
            m = _DOCTYPE.match(s[at + 9 : end if end >= 0 else n])
            first = m.group(3) if m.group(3) is not None else m.group(4)
            second = m.group(5) if m.group(5) is not None else m.group(6)
            public = (m.group(2) or "").lower() == "public"
            feed("D", "", (m.group(1).lower(), first if public else None, second if public else first, end < 0 or not m.group(1)))
            at = end + 1 if end >= 0 else n
        elif s.startswith("</>", at):
            at += 3
        elif s.startswith("</", at) and at + 2 >= n:
            feed("T", "</")
            at = n
        else:
            end = s.find(">", at)
            feed("C", s[at + (1 if s[at + 1] == "?" else 2) : end if end >= 0 else n])
            at = end + 1 if end >= 0 else n
    b.raw = None
    feed("Z", "", {})


def parse_document(html: str | None) -> Document:
    b = _Builder(False)
    _run(b, html or "")
    return Document(b.top, b.errors, b.quirks)


def parse_fragment(html: str | None) -> Document:
    """As the inside of a ``body``: a fragment node with one ``html`` element that holds the nodes."""
    b = _Builder(True)
    _run(b, html or "")
    return Document(b.top, b.errors, b.quirks)
