"""Scalar functions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIRECTIVES = {"Y": "yyyy", "m": "MM", "d": "dd", "e": "d", "B": "MMMM", "b": "MMM", "h": "MMM", "y": "yy", "j": "DDD", "A": "EEEE", "a": "EEE", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "%": "%", "n": "\n", "t": "\t"}
_LOOSE = {"d": "d", "m": "M", "e": "d", "j": "D"}


def java_pattern(fmt: str, parsing: bool) -> str:
    """A strftime format as a datetime pattern; numbers may be short when parsing."""
    out, i = "", 0
    literal = lambda s: "".join(f"'{c}'" if c.isalpha() else "''" if c == "'" else f"'{c}'" if c in "[]{}#" else c for c in s)
    while i < len(fmt):
        if fmt[i] != "%":
            out += literal(fmt[i])
            i += 1
            continue
        code = fmt[i + 1 : i + 2]
        if code == "-":
            code, i = fmt[i + 2 : i + 3], i + 1
            got = _LOOSE.get(code) or _DIRECTIVES.get(code)
        else:
            got = _LOOSE.get(code) if parsing and code in _LOOSE else _DIRECTIVES.get(code)
        if not got:
            raise ValueError(f"%{code} is not a date directive")
        if parsing and code in "Aa":
            raise ValueError("weekday names can't be parsed")
        out += got
        i += 2
    return out


def parse_date(text: Column, fmt: str, strict: bool = False) -> Column:
    """A DATE; what does not match, trailing text included, is null, or an error if ``strict``."""
    return (F.to_date if strict else F.try_to_date)(text, java_pattern(fmt, True))


def format_date(date: Column, fmt: str) -> Column:
    return F.date_format(date, java_pattern(fmt, False))


def strip(text: Column) -> Column:
    """Without white space at either end, line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def one_line(text: Column, by: str = " ") -> Column:
    return F.regexp_replace(text, r"[\r\n]+", by)


_CLASSES = {"a": "A-Za-z", "d": "0-9", "l": "a-z", "s": r"\s", "u": "A-Z", "w": "A-Za-z0-9", "x": "0-9A-Fa-f", "p": r"\p{Punct}", "c": r"\p{Cntrl}"}


def lua_pattern(pattern: str) -> str:
    """A pattern of the script language of crawlers as a Java regular expression (no %b or %f)."""
    out, i, inside = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "%":
            i += 1
            k = pattern[i]
            low = k.lower()
            if low in _CLASSES:
                body = _CLASSES[low]
                out += (f"[^{body}]" if k.isupper() else body if inside else f"[{body}]")
            elif k in "bf":
                raise ValueError(f"%{k} is not supported")
            else:
                out += re.escape(k)
        elif inside:
            out += c if c in "^-]" else re.escape(c)
            inside = c != "]"
        elif c == "[":
            inside = True
            out += c
            if pattern[i + 1 : i + 2] == "^":
                out += "^"
                i += 1
        elif c == "-":
            out += "*?"
        elif c in "^" and i == 0 or c == "$" and i == len(pattern) - 1 or c in "()*+?.":
            out += c
        else:
            out += re.escape(c)
        i += 1
    return "(?s)" + out


def find(text: Column, pattern: str) -> Column:
    return text.rlike(lua_pattern(pattern))


def match(text: Column, pattern: str, group: int = 1) -> Column:
    """The capture, null where there is no match."""
    return F.when(find(text, pattern), F.regexp_extract(text, lua_pattern(pattern), group))


def has_class(classes: Column, name: str) -> Column:
    """Without regard to ASCII case."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.exists(classes, lambda c: fold(c) == fold(F.lit(name)))


def label_map(labels: Column, values: Column) -> Column:
    """A map of parallel arrays; the last of equal labels counts, a missing label's entry is left out."""
    pairs = F.filter(F.arrays_zip(labels.alias("l"), values.alias("v")), lambda p: p["l"].isNotNull())
    indexed = F.transform(pairs, lambda p, i: F.struct(p["l"].alias("l"), p["v"].alias("v"), i.alias("i")))
    last = F.filter(indexed, lambda p: ~F.exists(indexed, lambda q: (q["l"] == p["l"]) & (q["i"] > p["i"])))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["l"], p["v"])))
