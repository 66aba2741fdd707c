"""Selectors of level 3 (and ``:not`` lists and attribute flags) to an immutable tree.

Pseudo-elements, dynamic pseudo-classes, ``:is``, ``:where``, ``:has``, namespace prefixes and a leading
combinator are errors."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

_IDENT = re.compile(r"-?(?:[A-Za-z_]|[^\x00-\x7f]|\\[^\n])(?:[\w-]|[^\x00-\x7f]|\\[^\n])*|--(?:[\w-]|[^\x00-\x7f]|\\[^\n])*")
_HASH = re.compile(r"(?:[\w-]|[^\x00-\x7f]|\\[^\n])+")
_SPACE = re.compile(r"(?:[ \t\n\r\f]|/\*[\s\S]*?\*/)*")
_STRING = re.compile(r"\"((?:[^\"\\\n]|\\[\s\S])*)\"|'((?:[^'\\\n]|\\[\s\S])*)'")
_NTH = re.compile(r"[ \t\n\r\f]*(?:(odd|even)|([+-]?\d*)n(?:[ \t\n\r\f]*([+-])[ \t\n\r\f]*(\d+))?|([+-]?\d+))[ \t\n\r\f]*$", re.I)
_ESCAPE = re.compile(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n\r\f]?|([\s\S]))")
# attributes whose values HTML compares without regard to case
FOLDED = frozenset(
    "accept accept-charset align alink axis bgcolor charset checked clear codetype color compact declare defer dir direction disabled enctype face frame hreflang http-equiv lang language link media method "
    "multiple nohref noresize noshade nowrap readonly rel rev rules scope scrolling selected shape target text type valign valuetype vlink".split()
)
SIMPLE = {
    "root": ("root",), "empty": ("empty",), "scope": ("scope",), "first-child": ("nth", 0, 1, False, False), "last-child": ("nth", 0, 1, False, True), "only-child": ("only", False),
    "first-of-type": ("nth", 0, 1, True, False), "last-of-type": ("nth", 0, 1, True, True), "only-of-type": ("only", True),
}
NTH = {"nth-child": (False, False), "nth-last-child": (False, True), "nth-of-type": (True, False), "nth-last-of-type": (True, True)}


class SelectorError(ValueError):
    """``kind``: empty, unexpected-end, unexpected-token, unsupported-pseudo, bad-attribute, bad-nth,
    dangling-combinator or unknown-namespace."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Complex:
    """Compounds from left to right; ``combinators[i]`` stands between compounds i and i + 1."""

    compounds: tuple[tuple[tuple, ...], ...]
    combinators: tuple[str, ...]

    def __str__(self) -> str:
        out = _compound(self.compounds[0])
        for c, x in zip(self.combinators, self.compounds[1:]):
            out += (" " if c == " " else f" {c} ") + _compound(x)
        return out


@dataclass(frozen=True)
class Selector:
    parts: tuple[Complex, ...]

    def __str__(self) -> str:
        return ", ".join(map(str, self.parts))


def _quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\a ") + '"'


def _ident(s: str) -> str:
    return re.sub(r"^-?\d|[^\w\-\x80-\U0010ffff]", lambda m: "".join(c if c == "-" else f"\\{ord(c):x} " if c.isdigit() else "\\" + c for c in m.group()), s)


def _nth(a: int, b: int) -> str:
    return str(b) if a == 0 else f"{'' if a == 1 else '-' if a == -1 else a}n" + (f"{b:+d}" if b else "")


def _compound(tests: tuple[tuple, ...]) -> str:
    out = []
    for t in tests:
        if t[0] == "type":
            out.append(_ident(t[2]))
        elif t[0] == "any":
            out.append("*")
        elif t[0] == "id":
            out.append("#" + _ident(t[1]))
        elif t[0] == "class":
            out.append("." + _ident(t[1]))
        elif t[0] == "attr":
            out.append(f"[{_ident(t[1])}" + (f"{t[2]}{_quote(t[3])}" + (f" {t[5]}" if t[5] else "") if t[2] else "") + "]")
        elif t[0] == "not":
            out.append(f":not({t[1]})")
        elif t in SIMPLE.values():
            out.append(":" + next(k for k, v in SIMPLE.items() if v == t))
        else:
            out.append(f":{next(k for k, v in NTH.items() if v == t[3:])}({_nth(t[1], t[2])})")
    return "".join(out)


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        if m.group(1):
            code = int(m.group(1), 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
        return m.group(2)

    return _ESCAPE.sub(one, s) if "\\" in s else s


class _Parser:
    def __init__(self, text: str):
        self.s, self.at = text, 0

    def space(self) -> bool:
        before = self.at
        self.at = _SPACE.match(self.s, self.at).end()
        return self.at > before

    def peek(self) -> str:
        return self.s[self.at : self.at + 1]

    def ident(self) -> str:
        m = _IDENT.match(self.s, self.at)
        if not m:
            c = self.peek()
            raise SelectorError("unexpected-token" if c else "unexpected-end", f"expected a name at {self.at} in {self.s!r}, found {c!r}" if c else f"{self.s!r} ends too early")
        self.at = m.end()
        return _unescape(m.group())

    def selectors(self, inside: bool = False) -> Selector:
        parts = []
        while True:
            parts.append(self.complex(inside))
            if self.peek() != ",":
                break
            self.at += 1
        return Selector(tuple(parts))

    def complex(self, inside: bool) -> Complex:
        self.space()
        compounds, combinators = [self.compound()], []
        while True:
            spaced = self.space()
            c = self.peek()
            if c in ("", ",") or c == ")" and inside:
                return Complex(tuple(compounds), tuple(combinators))
            if c in ">+~":
                self.at += 1
                self.space()
                if self.peek() in ("", ",", ")"):
                    raise SelectorError("dangling-combinator", f"{self.s!r} has nothing after {c!r}")
            elif spaced:
                c = " "
            else:
                raise SelectorError("unexpected-token", f"unexpected {c!r} at {self.at} in {self.s!r}")
            compounds.append(self.compound())
            combinators.append(c)

    def compound(self) -> tuple[tuple, ...]:
        tests: list[tuple] = []
        c = self.peek()
        if c in (">", "+", "~"):
            raise SelectorError("dangling-combinator", f"{self.s!r} has nothing before {c!r}")
        if c in ("", ","):
            raise SelectorError("empty", f"empty selector in {self.s!r}")
        star_bar = re.match(r"(\*|)\|(?!=)", self.s[self.at :])
        if star_bar:
            self.at += star_bar.end()  # any namespace, or none: HTML elements differ in neither here
            c = self.peek()
        if c == "*":
            self.at += 1
            tests.append(("any",))
        elif _IDENT.match(self.s, self.at):
            name = self.ident()
            tests.append(("type", name.lower(), name))
        if tests and re.match(r"\|(?!=)", self.s[self.at :]):
            raise SelectorError("unknown-namespace", f"no namespace prefixes are known: {self.s!r}")
        while True:
            c = self.peek()
            if c == "#":
                m = _HASH.match(self.s, self.at + 1)
                if not m or not _IDENT.fullmatch(m.group()):
                    raise SelectorError("unexpected-token", f"expected a name after # in {self.s!r}")
                self.at = m.end()
                tests.append(("id", _unescape(m.group())))
            elif c == ".":
                self.at += 1
                tests.append(("class", self.ident()))
            elif c == "[":
                self.at += 1
                tests.append(self.attribute())
            elif c == ":":
                self.at += 1
                tests.append(self.pseudo())
            else:
                break
        if not tests:
            raise SelectorError("unexpected-token", f"unexpected {c!r} at {self.at} in {self.s!r}")
        return tuple(tests)

    def attribute(self) -> tuple:
        self.space()
        star = re.match(r"\*?\|(?!=)", self.s[self.at :])
        if star:
            self.at += star.end()
        name = self.ident().lower()
        if re.match(r"\|(?!=)", self.s[self.at :]):
            raise SelectorError("unknown-namespace", f"no namespace prefixes are known: {self.s!r}")
        self.space()
        if self.peek() == "]":
            self.at += 1
            return ("attr", name, "", "", False, "")
        m = re.compile(r"[~|^$*]?=").match(self.s, self.at)
        if not m:
            raise SelectorError("bad-attribute", f"unexpected {self.peek()!r} in the attribute test of {self.s!r}")
        self.at = m.end()
        self.space()
        text = _STRING.match(self.s, self.at)
        if text:
            self.at = text.end()
            value = _unescape(re.sub(r"\\\n", "", text.group(1) if text.group(1) is not None else text.group(2)))
        else:
            value = self.ident()
        self.space()
        flag = ""
        if self.peek() in tuple("iIsS"):
            flag = self.peek().lower()
            self.at += 1
            self.space()
        if self.peek() != "]":
            raise SelectorError("bad-attribute" if self.peek() else "unexpected-end", f"the attribute test of {self.s!r} is not closed")
        self.at += 1
        return ("attr", name, m.group(), value, flag == "i" or not flag and name in FOLDED, flag)

    def pseudo(self) -> tuple:
        if self.peek() == ":":
            raise SelectorError("unsupported-pseudo", f"pseudo-elements are not supported: {self.s!r}")
        name = self.ident().lower()
        if self.peek() != "(":
            if name not in SIMPLE:
                raise SelectorError("unsupported-pseudo", f":{name} is not supported")
            return SIMPLE[name]
        self.at += 1
        if name == "not":
            inner = self.selectors(inside=True)
            self.space()
            if self.peek() != ")":
                raise SelectorError("unexpected-end", f":not( is not closed in {self.s!r}")
            self.at += 1
            return ("not", inner)
        if name not in NTH:
            raise SelectorError("unsupported-pseudo", f":{name}() is not supported")
        end = self.s.find(")", self.at)
        m = _NTH.match(self.s[self.at : end]) if end >= 0 else None
        if not m:
            raise SelectorError("bad-nth", f"bad argument of :{name}() in {self.s!r}")
        self.at = end + 1
        if m.group(1):
            a, b = 2, int(m.group(1).lower() == "odd")
        elif m.group(5):
            a, b = 0, int(m.group(5))
        else:
            a = int(m.group(2) + "1") if m.group(2) in ("", "+", "-") else int(m.group(2))
            b = int((m.group(3) or "") + m.group(4)) if m.group(4) else 0
        return ("nth", a, b, *NTH[name])


@functools.lru_cache(maxsize=4096)
def parse(text: str) -> Selector:
    p = _Parser(text)
    out = p.selectors()
    if p.at < len(text):
        raise SelectorError("unexpected-token", f"unexpected {p.peek()!r} at {p.at} in {text!r}")
    return out
