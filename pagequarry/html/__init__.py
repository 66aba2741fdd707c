"""HTML trees: nodes, parsing by the HTML standard's tree construction, and serialisation."""

from pagequarry.html.parser import Document, parse_document, parse_fragment
from pagequarry.html.serialize import inner_html, outer_html
from pagequarry.html.tree import Node, tree

__all__ = ["Document", "Node", "inner_html", "outer_html", "parse_document", "parse_fragment", "tree"]
