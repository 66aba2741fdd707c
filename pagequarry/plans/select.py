"""Selectors as relational plans over a node table: a compound is a filter, a combinator a left semi join
from the right, ``:not`` of a complex selector an anti join.  No Python runs; a sibling or child step joins
on equal keys, a descendant step on equal trees with a range as residual."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.css.parser import Complex, Selector, parse
from pagequarry.html.tree import DOCUMENT, ELEMENT

KEYS = ["node_id", "parent_id", "pre", "post", "tree_root", "el_idx"]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _attribute(t: tuple) -> Column:
    _, name, op, want, fold, _ = t
    value = F.try_element_at("attrs", F.lit(name))
    have = value.isNotNull()
    if op == "":
        return have
    if fold:
        value, want = _lower(value), "".join(c.lower() if c.isascii() else c for c in want)
    w = F.lit(want)
    if op == "=":
        test = value == w
    elif op == "|=":
        test = (value == w) | value.startswith(want + "-")
    elif want == "":
        return F.lit(False)
    elif op == "~=":
        test = F.array_contains(F.split(value, "[ \t\n\f\r]+"), want)
    else:
        test = value.startswith(want) if op == "^=" else value.endswith(want) if op == "$=" else F.contains(value, w)
    return have & F.coalesce(test, F.lit(False))


def _simple(t: tuple) -> Column | None:
    """The test as a condition on a node's own row; None if it needs a join."""
    kind = t[0]
    if kind == "type":
        return F.col("name") == F.when(F.col("ns") == "html", F.lit(t[1])).otherwise(F.lit(t[2]))
    if kind == "any":
        return F.lit(True)
    if kind == "id":
        return F.coalesce(F.col("id") == t[1], F.lit(False))
    if kind == "class":
        return F.array_contains("classes", t[1])
    if kind == "attr":
        return _attribute(t)
    if kind == "nth":
        i, (a, b) = F.col(["el_idx", "el_idx_rev", "type_idx", "type_idx_rev"][2 * t[3] + t[4]]), t[1:3]
        return i == b if a == 0 else ((i - b) % a == 0) & ((i - b) / a >= 0)
    if kind == "only":
        p = "type_idx" if t[1] else "el_idx"
        return (F.col(p) == 1) & (F.col(f"{p}_rev") == 1)
    if kind == "empty":
        return F.col("empty")
    if kind in ("root", "scope"):  # of a whole page the scope is its root element
        return F.col("parent_kind") == DOCUMENT
    if all(len(c.compounds) == 1 for c in t[1].parts):
        inner = [[_simple(x) for x in c.compounds[0]] for c in t[1].parts]
        if all(x is not None for own in inner for x in own):
            return ~reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, own) for own in inner])
    return None


def _compound(nodes: DataFrame, tests: tuple[tuple, ...], key: str) -> DataFrame:
    out = nodes.where(F.col("kind") == ELEMENT)
    later = []
    for t in tests:
        c = _simple(t)
        if c is None:
            later.append(t)
        else:
            out = out.where(c)
    for t in later:
        out = out.join(_any(nodes, t[1], key), [key, "node_id"], "left_anti")
    return out


def _complex(nodes: DataFrame, c: Complex, key: str) -> DataFrame:
    left = _compound(nodes, c.compounds[0], key)
    for how, tests in zip(c.combinators, c.compounds[1:]):
        a = left.select(F.col(key).alias("_k"), *[F.col(x).alias(f"_{x}") for x in KEYS])
        right = _compound(nodes, tests, key)
        on = F.col(key) == F.col("_k")
        if how == ">":
            on = on & (F.col("parent_id") == F.col("_node_id"))
        elif how == " ":
            on = on & (F.col("tree_root") == F.col("_tree_root")) & (F.col("pre") > F.col("_pre")) & (F.col("post") < F.col("_post"))
        elif how == "+":
            on = on & (F.col("parent_id") == F.col("_parent_id")) & (F.col("el_idx") == F.col("_el_idx") + 1)
        else:
            on = on & (F.col("parent_id") == F.col("_parent_id")) & (F.col("el_idx") > F.col("_el_idx"))
        left = right.join(a, on, "left_semi")
    return left


def _any(nodes: DataFrame, selector: Selector, key: str) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [_complex(nodes, c, key).select(key, "node_id") for c in selector.parts])


def select_nodes(nodes: DataFrame, selector: str | Selector, key: str = "page_id") -> DataFrame:
    """The rows of the node table that match, the pages' root elements left out; order by ``pre``."""
    parsed = parse(selector) if isinstance(selector, str) else selector
    below = F.col("depth") > 1  # the scope, which is the root element, is never a result
    if len(parsed.parts) == 1:
        return _complex(nodes, parsed.parts[0], key).where(below)
    return nodes.where(below).join(_any(nodes, parsed, key), [key, "node_id"], "left_semi")


def inner_text(nodes: DataFrame, of: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, inner_text) of the nodes ``of`` a node table."""
    own = of.select(key, "node_id", F.col("pre").alias("_pre"), F.col("post").alias("_post"))
    texts = nodes.where("kind = 'text'").select(F.col(key).alias("_k"), F.col("pre").alias("_at"), "text")
    met = own.join(texts, (F.col(key) == F.col("_k")) & (F.col("_at") > F.col("_pre")) & (F.col("_at") < F.col("_post")), "left")
    got = met.groupBy(key, "node_id").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("_at", "text")))).alias("t"))
    return got.select(key, "node_id", F.array_join(F.col("t.text"), "").alias("inner_text"))


def axis(nodes: DataFrame, name: str, key: str = "page_id", of: DataFrame | None = None) -> DataFrame:
    """(key, node_id, other_id, place): the other nodes on an axis of each node, or of the nodes ``of`` only, ``place``
    from 1 outward or in document order.  Axes: parent, children, ancestors, descendants (with the node itself), next_siblings,
    prev_siblings, first_child, last_child."""
    from pyspark.sql import Window

    a = (nodes if of is None else of).select(key, "node_id", "parent_id", "pre", "post", "sib_idx", "depth")
    b = nodes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in ("node_id", "parent_id", "pre", "post", "sib_idx", "depth")])
    same = F.col(key) == F.col("_k")
    child, family = same & (F.col("_parent_id") == F.col("node_id")), same & (F.col("_parent_id") == F.col("parent_id"))
    on, place = {
        "parent": (same & (F.col("_node_id") == F.col("parent_id")), F.lit(1)),
        "children": (child, F.col("_sib_idx") + 1),
        "ancestors": (same & (F.col("_pre") < F.col("pre")) & (F.col("_post") > F.col("post")), F.col("depth") - F.col("_depth")),
        "descendants": (same & (F.col("_pre") >= F.col("pre")) & (F.col("_post") <= F.col("post")), F.col("_node_id") - F.col("node_id") + 1),
        "next_siblings": (family & (F.col("_sib_idx") > F.col("sib_idx")), F.col("_sib_idx") - F.col("sib_idx")),
        "prev_siblings": (family & (F.col("_sib_idx") < F.col("sib_idx")), F.col("sib_idx") - F.col("_sib_idx")),
        "first_child": (child & (F.col("_sib_idx") == 0), F.lit(1)),
        "last_child": (child, F.lit(1)),
    }[name]
    out = a.join(b, on).select(key, "node_id", F.col("_node_id").alias("other_id"), place.cast("int").alias("place"), "_sib_idx")
    if name == "last_child":
        last = F.row_number().over(Window.partitionBy(key, "node_id").orderBy(F.desc("_sib_idx")))
        out = out.withColumn("_last", last).where("_last = 1").drop("_last")
    return out.drop("_sib_idx")
