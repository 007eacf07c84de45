"""Conditions of routes: a small expression language, compiled to a Column on the driver.

Values that are missing are null, and null conditions don't match, which is what an evaluation error means for a route: and, or and not have
the same three-valued logic as the language's error absorption. Fields are typed by what they are compared with, as payloads are JSON.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?u?)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%<>!?:.,()\[\]])|(?P<name>[A-Za-z_]\w*))""")
#: How tightly operators bind.
BINDING = {"?": 1, "||": 2, "&&": 3, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "in": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


class CelError(ValueError):
    """The condition isn't well formed."""


@dataclass
class Node:
    """kind: literal, path, list, call or operator; of: operands; value: literal, names or operator."""

    kind: str
    value: object = None
    of: list[Node] = field(default_factory=list)


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise CelError(f"unexpected {text[at:at + 10]!r}")
            kind = m.lastgroup
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens) or (wanted and self.peek() != wanted):
            raise CelError(f"{wanted or 'more'} expected")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> Node:
        out = self.expression(0)
        if self.at < len(self.tokens):
            raise CelError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def expression(self, least: int) -> Node:
        left = self.unary()
        while (op := self.peek()) in BINDING and BINDING[op] > least:
            self.take()
            if op == "?":
                then = self.expression(0)
                self.take(":")
                left = Node("op", "?", [left, then, self.expression(0)])
            else:
                left = Node("op", op, [left, self.expression(BINDING[op])])
        return left

    def unary(self) -> Node:
        if (op := self.peek()) in ("!", "-"):
            self.take()
            return Node("op", f"unary{op}", [self.unary()])
        return self.member(self.primary())

    def arguments(self, close: str) -> list[Node]:
        out = []
        while self.peek() != close:
            out.append(self.expression(0))
            if self.peek() != close:
                self.take(",")
        self.take(close)
        return out

    def primary(self) -> Node:
        kind, text = self.take()
        if kind == "num":
            return Node("literal", float(text) if re.search("[.eE]", text) else int(text.rstrip("u")))
        if kind == "str":
            return Node("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1]))
        if text == "(":
            out = self.expression(0)
            self.take(")")
            return out
        if text == "[":
            return Node("list", of=self.arguments("]"))
        if kind != "name":
            raise CelError(f"unexpected {text!r}")
        if text in ("true", "false", "null"):
            return Node("literal", {"true": True, "false": False, "null": None}[text])
        if self.peek() == "(":
            self.take()
            return Node("call", text, self.arguments(")"))
        return Node("path", [text])

    def member(self, left: Node) -> Node:
        while (op := self.peek()) in (".", "["):
            self.take()
            if op == "[":
                index = self.expression(0)
                self.take("]")
                if left.kind != "path" or index.kind != "literal":
                    raise CelError("only fields have constant indices")
                left = Node("path", [*left.value, index.value])
                continue
            kind, name = self.take()
            if kind != "name":
                raise CelError(f"a name expected after the point, not {name!r}")
            if self.peek() == "(":
                self.take()
                left = Node("call", name, [left, *self.arguments(")")])
            elif left.kind == "path":
                left = Node("path", [*left.value, name])
            else:
                raise CelError(f"no field {name} here")
        return left


def parse(text: str) -> Node:
    return Parser(text).parse()


Scope = Callable[[list], Column]


def _kind(node: Node) -> str | None:
    """Type of a node as far as it is known: number, string, bool, null or None."""
    if node.kind == "literal":
        v = node.value
        return "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
    if node.kind == "call":
        return "number" if node.value in ("size", "int", "double") else "string" if node.value in ("string", "lowerAscii") else "bool"
    if node.kind == "op":
        if node.value in ("+", "-", "*", "/", "%", "unary-"):
            return "string" if node.value == "+" and "string" in map(_kind, node.of) else "number"
        return None if node.value == "?" else "bool"
    return None


TYPES = {"number": "double", "string": "string", "bool": "boolean"}


def to_column(node: Node, scope: Scope, wanted: str | None = None) -> Column:
    """The node as a Column of the wanted kind (number, string or bool); fields are cast leniently, so a value of another kind is null."""
    if node.kind == "literal":
        return F.lit(float(node.value)) if _kind(node) == "number" else F.lit(node.value)
    if node.kind == "path":
        out = scope(node.value)
        return out.try_cast(TYPES[wanted]) if wanted in TYPES else out
    if node.kind == "op":
        return _operator(node, scope)
    if node.kind == "call":
        return _call(node, scope)
    raise CelError("a list stands only after in")


def _operator(node: Node, scope: Scope) -> Column:
    op, of = node.value, node.of
    if op in ("&&", "||"):
        a, b = (to_column(x, scope, "bool") for x in of)
        return a & b if op == "&&" else a | b
    if op == "unary!":
        return ~to_column(of[0], scope, "bool")
    if op == "unary-":
        return -to_column(of[0], scope, "number")
    if op == "?":
        kind = next((k for k in map(_kind, of[1:]) if k), "string")
        a, b = (to_column(x, scope, kind) for x in of[1:])
        test = to_column(of[0], scope, "bool")
        return F.when(test, a).when(~test, b)
    if op == "in":
        if of[1].kind == "list":
            kind = next((k for k in map(_kind, of[1].of) if k), "string")
            return to_column(of[0], scope, kind).isin([x.value if kind != "number" else float(x.value) for x in of[1].of])
        return F.array_contains(F.from_json(to_column(of[1], scope, "string"), "array<string>"), to_column(of[0], scope, "string"))
    kinds = [k for k in map(_kind, of) if k]
    if op in ("==", "!=") and "null" in kinds:
        other = next((x for x in of if _kind(x) != "null"), of[0])
        missing = to_column(other, scope).isNull()
        return missing if op == "==" else ~missing
    kind = kinds[0] if kinds else ("number" if op in ("-", "*", "/", "%") else "string")
    a, b = (to_column(x, scope, kind) for x in of)
    if op == "+":
        return F.concat(a, b) if kind == "string" else a + b
    return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "%": lambda: F.try_mod(a, b)}[op]()


def _call(node: Node, scope: Scope) -> Column:
    name, of = node.value, node.of
    text = {"startsWith": F.startswith, "endsWith": F.endswith, "contains": F.contains}
    if name in text and len(of) == 2:
        return text[name](to_column(of[0], scope, "string"), to_column(of[1], scope, "string"))
    if name == "matches" and len(of) == 2:
        return F.rlike(to_column(of[0], scope, "string"), to_column(of[1], scope, "string"))
    if name == "has" and len(of) == 1:
        return to_column(of[0], scope).isNotNull()
    if name == "size" and len(of) == 1:
        value = to_column(of[0], scope, "string")
        return F.coalesce(F.json_array_length(value), F.length(value)).cast("double")
    if name in ("int", "double", "string", "bool") and len(of) == 1:
        return to_column(of[0], scope, {"int": "number", "double": "number"}.get(name, name))
    if name in ("exists", "all") and len(of) == 3 and of[1].kind == "path":
        items = F.from_json(to_column(of[0], scope, "string"), "array<string>")
        variable = of[1].value[0]

        def inner(item: Column) -> Column:
            def own(path: list) -> Column:
                if path[0] != variable:
                    return scope(path)
                return item if len(path) == 1 else F.get_json_object(item, json_path(path[1:]))

            return F.coalesce(to_column(of[2], own, "bool"), F.lit(False))

        return F.exists(items, inner) if name == "exists" else F.forall(items, inner)
    raise CelError(f"unknown function {name} of {len(of)}")


def json_path(path: list) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path)


def event_scope(columns: list[str], payload: str = "data") -> Scope:
    """Fields of ``event``: envelope columns by name, everything else by its path in the JSON payload."""

    def of(path: list) -> Column:
        if path[0] != "event" or len(path) < 2:
            raise CelError(f"unknown name {path[0]}")
        if path[1] in columns and path[1] != payload:
            own = F.col(f"`{path[1]}`")
            return own if len(path) == 2 else F.get_json_object(own, json_path(path[2:]))
        return F.get_json_object(F.col(f"`{payload}`"), json_path(path[1:]))

    return of


def compile_condition(text: str, scope: Scope) -> Column:
    """A boolean that is never null. Numbers and strings count as true unless zero or empty."""
    node = parse(text)
    kind = _kind(node)
    value = to_column(node, scope, None if kind else "string")
    if kind == "number":
        value = value != 0
    elif kind == "string" or kind is None and node.kind == "path":
        value = (value != "") & (value != "false") & (value != "0")
    return F.coalesce(value, F.lit(False))
