"""Extraction from a column of HTML: one parse a page, in Arrow batches, whatever is asked for."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType

from pagequarry.css import parse, select, select_first
from pagequarry.html import Document, inner_html, outer_html, parse_document, parse_fragment
from pagequarry.html.tree import DOCTYPE, ELEMENT, TEXT, Node

_S = StringType()
ELEMENT_TYPE = StructType([
    StructField("pos", IntegerType()), StructField("name", _S), StructField("id", _S), StructField("classes", ArrayType(_S)),
    StructField("attrs", MapType(_S, _S)), StructField("inner_text", _S), StructField("inner_html", _S), StructField("html", _S),
])
NODE_TYPE = StructType([
    StructField("node_id", IntegerType()), StructField("parent_id", IntegerType()), StructField("pre", IntegerType()), StructField("post", IntegerType()), StructField("depth", IntegerType()),
    StructField("sib_idx", IntegerType()), StructField("el_idx", IntegerType()), StructField("el_idx_rev", IntegerType()), StructField("type_idx", IntegerType()), StructField("type_idx_rev", IntegerType()),
    StructField("tree_root", IntegerType()), StructField("parent_kind", _S), StructField("empty", BooleanType()), StructField("kind", _S), StructField("ns", _S), StructField("name", _S),
    StructField("id", _S), StructField("classes", ArrayType(_S)), StructField("attrs", MapType(_S, _S)), StructField("text", _S),
])


def element_row(n: Node, pos: int) -> list:
    """In the order of ELEMENT_TYPE."""
    return [pos, n.name, n.id, n.classes, list(n.attrs.items()), n.inner_text, inner_html(n), outer_html(n)]


def _accessor(what: str):
    if what.startswith("attr:"):
        name = what[5:]
        return lambda n: n.attr(name)
    if what.startswith("has_class:"):
        name = what[10:]
        return lambda n: str(n.has_class(name)).lower()
    return {"text": lambda n: n.inner_text, "inner_html": inner_html, "html": outer_html, "name": lambda n: n.name, "id": lambda n: n.id, "classes": lambda n: " ".join(n.classes)}[what]


class Spec:
    """What to take from a page: ``selector``, ``what`` (text, html, inner_html, name, id, classes, attr:NAME,
    has_class:NAME or count) and ``many`` (all matches as an array, else the first or null)."""

    def __init__(self, selector: str, what: str = "text", many: bool = False):
        self.selector, self.what, self.many = parse(selector), what, many
        if what != "count":
            _accessor(what)
        self.type = IntegerType() if what == "count" else ArrayType(_S) if many else _S

    def take(self, scope: Node):
        if self.what == "count":
            return sum(1 for _ in select(scope, self.selector))
        get = _accessor(self.what)
        if self.many:
            return [get(n) for n in select(scope, self.selector)]
        n = select_first(scope, self.selector)
        return None if n is None else get(n)


def _mapped(df: DataFrame, html_col: str, keep: list[str], added: StructType, rows) -> DataFrame:
    """``keep`` columns of ``df`` beside the rows (values in the order of ``added``) that ``rows(html)`` gives for each page."""
    slim = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("__html"))
    schema = StructType([*slim.schema.fields[:-1], *added.fields])
    arrow = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 64):  # a page may have many rows
                batch = big.slice(at, 64)
                found, of = [], []
                for k, html in enumerate(batch.column(len(keep)).to_pylist()):
                    more = rows(html)
                    found += more
                    of += [k] * len(more)
                cells = [batch.column(i).take(pa.array(of, pa.int32())) for i in range(len(keep))]
                cells += [pa.array(values, f.type) for f, values in zip(arrow, zip(*found) if found else [()] * len(arrow))]
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return slim.mapInArrow(run, schema)


def extract(df: DataFrame, specs: dict[str, Spec | str], html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row a page with one column for each spec; a plain string is a selector whose first text is taken.
    A null page is an empty one."""
    own = {k: v if isinstance(v, Spec) else Spec(v) for k, v in specs.items()}
    keep = [c for c in df.columns if c != html_col] if keep is None else keep

    def rows(html: str | None):
        root = parse_document(html).root
        return [[s.take(root) for s in own.values()]]

    return _mapped(df, html_col, keep, StructType([StructField(k, s.type) for k, s in own.items()]), rows)


def select_elements(df: DataFrame, selector: str, html_col: str = "html", keep: list[str] | None = None, fragment: bool = False, within: str | None = None) -> DataFrame:
    """One row for each matching element, ``pos`` from 1; ``within``: the selector is applied inside each match
    of that one in turn (``scope`` numbers them)."""
    parsed, outer = parse(selector), parse(within) if within else None
    keep = [c for c in df.columns if c != html_col] if keep is None else keep
    added = StructType([*([StructField("scope", IntegerType())] if outer else []), *ELEMENT_TYPE.fields])

    def rows(html: str | None):
        root = (parse_fragment if fragment else parse_document)(html).root
        if outer is None:
            return [element_row(n, i) for i, n in enumerate(select(root, parsed), 1)]
        return [[k, *element_row(n, i)] for k, s in enumerate(select(root, outer), 1) for i, n in enumerate(select(s, parsed), 1)]

    return _mapped(df, html_col, keep, added, rows)


_POST, _SIB, _EL, _EL_REV, _TYPE, _TYPE_REV = (NODE_TYPE.names.index(c) for c in ("post", "sib_idx", "el_idx", "el_idx_rev", "type_idx", "type_idx_rev"))


def node_rows(doc: Document) -> list[list]:
    """One row for each node, in document order and with its values in the order of NODE_TYPE; ``pre`` and ``post``
    enclose those of its descendants."""
    out: list[list] = []
    open_: list[tuple[Node, list, int, int, list]] = []  # with the row, its number, that of its tree's root and its children
    parent = parent_id = parent_kind = None
    clock = 0
    for opens, n in doc.tree.traverse():
        if opens:
            kind, i = n.kind, len(out)
            root = parent[3] if parent and kind != "fragment" else i
            id_ = classes = attrs = None
            if kind == ELEMENT:
                id_, classes, attrs = n.id, n.classes, list(n.attrs.items())
            elif kind == DOCTYPE:
                attrs = [("public_id", n.public_id or ""), ("system_id", n.system_id or "")]
            empty = not any(c.kind in (ELEMENT, TEXT) for c in n.children)
            row = [i, parent_id, clock, None, len(open_), None, None, None, None, None, root, parent_kind, empty, kind, n.ns, n.name, id_, classes, attrs, n.text]
            if parent:
                parent[4].append((n, row))
            out.append(row)
            parent = (n, row, i, root, [])
            open_.append(parent)
            parent_id, parent_kind = i, kind
        else:
            _, row, _, _, children = open_.pop()
            row[_POST] = clock
            own = 0
            types: dict[tuple, list[list]] = {}
            for k, (c, r) in enumerate(children):
                r[_SIB] = k
                if c.kind == ELEMENT:
                    own += 1
                    r[_EL] = own
                    types.setdefault((c.ns, c.name), []).append(r)
            for same in types.values():
                for k, r in enumerate(same):
                    r[_EL_REV], r[_TYPE], r[_TYPE_REV] = own + 1 - r[_EL], k + 1, len(same) - k
            parent = open_[-1] if open_ else None
            parent_id, parent_kind = (parent[2], parent[0].kind) if parent else (None, None)
        clock += 1
    return out


def explode_nodes(df: DataFrame, html_col: str = "html", key: str = "page_id", fragment: bool = False) -> DataFrame:
    """The node table: (``key``, NODE_TYPE columns).  What reads it more than once parses each time; store it first
    (``durable.stored``)."""
    parse_ = parse_fragment if fragment else parse_document
    return _mapped(df, html_col, [key], NODE_TYPE, lambda html: node_rows(parse_(html)))


def page_facts(df: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Parse results of each page: quirks mode, number of errors, nodes and elements."""
    keep = [c for c in df.columns if c != html_col] if keep is None else keep
    added = StructType([StructField("quirks_mode", _S), StructField("n_errors", LongType()), StructField("n_nodes", LongType()), StructField("n_elements", LongType())])

    def rows(html: str | None):
        doc = parse_document(html)
        kinds = [n.kind for n in doc.tree.descendants()]
        return [[doc.quirks_mode, len(doc.errors), len(kinds), kinds.count(ELEMENT)]]

    return _mapped(df, html_col, keep, added, rows)
