"""Nodes of a document tree, with the usual axes and edits."""

from __future__ import annotations

from collections.abc import Iterator

DOCUMENT, FRAGMENT, DOCTYPE, COMMENT, TEXT, ELEMENT, PI = "document", "fragment", "doctype", "comment", "text", "element", "pi"


class Node:
    """``kind`` is one of the constants above.  ``name`` is an element's local name, a doctype's name or an
    instruction's target; ``text`` is the text of texts, comments and instructions."""

    __slots__ = ("kind", "name", "ns", "attrs", "text", "parent", "children", "public_id", "system_id")

    def __init__(self, kind: str, name: str | None = None, text: str | None = None, attrs: dict[str, str] | None = None, ns: str | None = None):
        self.kind, self.name, self.text, self.ns = kind, name, text, ns
        self.attrs = attrs if attrs is not None else {}
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.public_id = self.system_id = None

    def __repr__(self) -> str:
        return f"<{self.kind} {self.name or ''}{'' if self.text is None else repr(self.text[:30])}>"

    # properties of elements
    @property
    def id(self) -> str | None:
        return self.attrs.get("id")

    @property
    def class_list(self) -> list[str]:
        """In source order, possibly with repetitions."""
        return self.attrs["class"].split() if "class" in self.attrs else []

    @property
    def classes(self) -> list[str]:
        """Distinct and sorted."""
        return sorted(set(self.class_list))

    def has_class(self, name: str) -> bool:
        """Without regard to ASCII case."""
        want = _ascii_lower(name)
        return any(_ascii_lower(c) == want for c in self.class_list)

    def attr(self, name: str) -> str | None:
        return self.attrs.get(name)

    @property
    def is_link(self) -> bool:
        return self.kind == ELEMENT and self.name == "link"

    def texts(self) -> Iterator[str]:
        for n in self.descendants():
            if n.kind == TEXT:
                yield n.text or ""

    @property
    def inner_text(self) -> str:
        return "".join(self.texts())

    # axes
    def _place(self) -> int:
        for i, c in enumerate(self.parent.children):
            if c is self:
                return i
        raise ValueError("a node that its parent doesn't know")

    @property
    def prev_sibling(self) -> Node | None:
        if self.parent is None:
            return None
        i = self._place()
        return self.parent.children[i - 1] if i else None

    @property
    def next_sibling(self) -> Node | None:
        if self.parent is None:
            return None
        i = self._place() + 1
        return self.parent.children[i] if i < len(self.parent.children) else None

    @property
    def first_child(self) -> Node | None:
        return self.children[0] if self.children else None

    @property
    def last_child(self) -> Node | None:
        return self.children[-1] if self.children else None

    @property
    def has_children(self) -> bool:
        return bool(self.children)

    @property
    def has_siblings(self) -> bool:
        return self.parent is not None and len(self.parent.children) > 1

    def ancestors(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def prev_siblings(self) -> Iterator[Node]:
        if self.parent is not None:
            yield from reversed(self.parent.children[: self._place()])

    def next_siblings(self) -> Iterator[Node]:
        if self.parent is not None:
            yield from self.parent.children[self._place() + 1 :]

    def first_children(self) -> Iterator[Node]:
        n = self.first_child
        while n is not None:
            yield n
            n = n.first_child

    def last_children(self) -> Iterator[Node]:
        n = self.last_child
        while n is not None:
            yield n
            n = n.last_child

    def traverse(self) -> Iterator[tuple[bool, Node]]:
        """(True, node) where a node opens and (False, node) where it closes; ends once and for all."""
        stack: list[tuple[bool, Node]] = [(True, self)]
        while stack:
            opens, n = stack.pop()
            yield opens, n
            if opens:
                stack.append((False, n))
                stack += [(True, c) for c in reversed(n.children)]

    def descendants(self) -> Iterator[Node]:
        """In document order, beginning with the node itself."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.children)

    # edits
    def detach(self) -> Node:
        if self.parent is not None:
            del self.parent.children[self._place()]
            self.parent = None
        return self

    def append(self, child: Node) -> Node:
        child.detach()
        child.parent = self
        self.children.append(child)
        return child

    def prepend(self, child: Node) -> Node:
        child.detach()
        child.parent = self
        self.children.insert(0, child)
        return child

    def insert_before(self, sibling: Node) -> Node | None:
        """Puts ``sibling`` before this node; None, and nothing done, if this node has no parent."""
        if self.parent is None:
            return None
        sibling.detach()
        sibling.parent = self.parent
        self.parent.children.insert(self._place(), sibling)
        return sibling

    def insert_after(self, sibling: Node) -> Node | None:
        if self.parent is None:
            return None
        sibling.detach()
        sibling.parent = self.parent
        self.parent.children.insert(self._place() + 1, sibling)
        return sibling

    def take_children(self, other: Node) -> None:
        """All children of ``other`` move to the end of this node's."""
        for c in other.children:
            c.parent = self
        self.children += other.children
        other.children = []

    def same_as(self, other: Node) -> bool:
        """Equal in structure and values."""
        a, b = list(self.traverse()), list(other.traverse())
        key = lambda e: (e[0], e[1].kind, e[1].name, e[1].ns, e[1].text, e[1].attrs)
        return len(a) == len(b) and all(key(x) == key(y) for x, y in zip(a, b))


def _ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else "".join(c.lower() if c.isascii() else c for c in s)


def tree(value: str, *children) -> Node:
    """A tree of elements from nested tuples: ``tree("a", ("b", "c"), "d")``."""
    node = Node(ELEMENT, value)
    for c in children:
        node.append(tree(*c) if isinstance(c, tuple) else tree(c))
    return node
