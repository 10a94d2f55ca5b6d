"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% if e %}..{% elif e %}..{% else %}..{% endif %}   {% for x in e %}..{% endfor %}
    {% generation %}..{% endgeneration %}   {# comment #}

Expressions: strings, whole numbers, true, false, none, names, `a.b` and `a["b"]` (keys of mappings only, never Python
attributes), `==`, `!=`, `~` (joins texts), `and`, `or`, `not`, parentheses, and filters after `|`. In a loop `loop` has
`first`, `last` and `index`. Only filters handed to `compile_template` can be called. A text is parsed into a syntax tree,
constants are folded and dead branches dropped, and every node becomes a closure that yields (text, generated) pairs, so a
loop over an iterator renders without holding it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

Filters = Mapping[str, Callable[[Any], Any]]
Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template text is not in the language, or asks for what the sandbox does not have."""


@dataclass(frozen=True)
class Constant:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Call:
    """A filter or an operator, by name."""

    what: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Branch:
    condition: Any
    then: tuple
    otherwise: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# Lexer and parser

TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
TOKEN = re.compile(r"""\s*(?:("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|().\[\]]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", '"': '"', "'": "'"}
WORDS = {"true": True, "false": False, "none": None}


class Parser:
    def __init__(self, source: str):
        self.parts = [p for p in TAGS.split(source) if p]
        self.at = 0

    def body(self, *ends: str) -> tuple[tuple, str, list]:
        """Nodes up to one of the tags in `ends`; also that tag and what follows it inside."""
        nodes = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if part.startswith("{{"):
                nodes.append(Output(self.expression(tokens(part[2:-2]))))
            elif part.startswith("{%"):
                first, *rest = tokens(part[2:-2]) or [("", "")]
                if first[1] in ends:
                    return tuple(nodes), first[1], rest
                nodes.append(self.block(first[1], rest))
            elif not part.startswith("{#"):
                nodes.append(Output(Constant(part)))
        if "" not in ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return tuple(nodes), "", []

    def block(self, kind: str, rest: list) -> Any:
        if kind == "if":
            condition = self.expression(rest)
            then, end, more = self.body("elif", "else", "endif")
            if end == "elif":
                return Branch(condition, then, (self.block("if", more),))
            otherwise = self.body("endif")[0] if end == "else" else ()
            return Branch(condition, then, otherwise)
        if kind == "for":
            if len(rest) < 3 or rest[0][0] != "name" or rest[1][1] != "in":
                raise TemplateError("a loop is written {% for name in expression %}")
            return Loop(rest[0][1], self.expression(rest[2:]), self.body("endfor")[0])
        if kind == "generation":
            return Generation(self.body("endgeneration")[0])
        raise TemplateError(f"unknown tag {kind!r}")

    def expression(self, found: list) -> Any:
        value, rest = either(found)
        if rest:
            raise TemplateError(f"unexpected {rest[0][1]!r}")
        return value


def tokens(text: str) -> list[tuple[str, Any]]:
    found, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text[at:at + 20]!r}")
        at = m.end()
        string, number, name, sign = m.groups()
        if string is not None:
            found.append(("value", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[0]), string[1:-1], flags=re.S)))
        elif number is not None:
            found.append(("value", int(number)))
        else:
            found.append(("name", name) if name else ("sign", sign))
    return found


def _chain(word: str, part: Callable) -> Callable:
    def parse(found: list):
        value, rest = part(found)
        while rest and rest[0][0] != "value" and rest[0][1] == word:
            right, rest = part(rest[1:])
            value = Call(word, (value, right))
        return value, rest

    return parse


def negation(found: list):
    if found and found[0] == ("name", "not"):
        value, rest = negation(found[1:])
        return Call("not", (value,)), rest
    value, rest = joined(found)
    while rest and rest[0] in (("sign", "=="), ("sign", "!=")):
        right, after = joined(rest[1:])
        value, rest = Call(rest[0][1], (value, right)), after
    return value, rest


def filtered(found: list):
    value, rest = primary(found)
    while rest and rest[0] == ("sign", "|"):
        if len(rest) < 2 or rest[1][0] != "name":
            raise TemplateError("a filter has a name")
        value, rest = Call(f"|{rest[1][1]}", (value,)), rest[2:]
    return value, rest


def primary(found: list):
    if not found:
        raise TemplateError("an expression is missing")
    (kind, word), rest = found[0], found[1:]
    if kind == "value":
        value = Constant(word)
    elif kind == "name":
        value = Constant(WORDS[word]) if word in WORDS else Name(word)
    elif word == "(":
        value, rest = either(rest)
        rest = _closed(rest, ")")
    else:
        raise TemplateError(f"unexpected {word!r}")
    while rest and rest[0] in (("sign", "."), ("sign", "[")):
        if rest[0][1] == ".":
            if len(rest) < 2 or rest[1][0] != "name":
                raise TemplateError("a key follows a dot")
            value, rest = Item(value, Constant(rest[1][1])), rest[2:]
        else:
            key, rest = either(rest[1:])
            value, rest = Item(value, key), _closed(rest, "]")
    return value, rest


def _closed(rest: list, sign: str) -> list:
    if not rest or rest[0] != ("sign", sign):
        raise TemplateError(f"missing {sign}")
    return rest[1:]


joined = _chain("~", filtered)
both = _chain("and", negation)
either = _chain("or", both)

# Folding

OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "~": lambda a, b: as_text(a) + as_text(b),
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def as_text(value: Any) -> str:
    return "" if value is None else str(value)


def _function(what: str, filters: Filters) -> Callable:
    if what in OPERATORS:
        return OPERATORS[what]
    if what[1:] not in filters:
        raise TemplateError(f"unknown filter {what[1:]!r}")
    return filters[what[1:]]


def fold(node: Any, filters: Filters) -> Any:
    """The expression with constant parts computed."""
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Call):
        function, args = _function(node.what, filters), tuple(fold(a, filters) for a in node.args)
        if all(isinstance(a, Constant) for a in args):
            return Constant(function(*(a.value for a in args)))
        return Call(node.what, args)
    return node


def fold_body(body: tuple, filters: Filters) -> tuple:
    """Nodes with constant expressions folded, dead branches dropped and neighbouring constant texts joined."""
    flat: list = []

    def add(node: Any) -> None:
        if isinstance(node, Output) and isinstance(node.value, Constant):
            text = as_text(node.value.value)
            if flat and isinstance(flat[-1], Output) and isinstance(flat[-1].value, Constant):
                text = flat.pop().value.value + text
            if text:
                flat.append(Output(Constant(text)))
        else:
            flat.append(node)

    for node in body:
        if isinstance(node, Output):
            add(Output(fold(node.value, filters)))
        elif isinstance(node, Branch):
            condition = fold(node.condition, filters)
            then, otherwise = fold_body(node.then, filters), fold_body(node.otherwise, filters)
            if isinstance(condition, Constant):
                for n in then if condition.value else otherwise:
                    add(n)
            else:
                add(Branch(condition, then, otherwise))
        elif isinstance(node, Loop):
            add(Loop(node.name, fold(node.over, filters), fold_body(node.body, filters)))
        else:
            add(Generation(fold_body(node.body, filters)))
    return tuple(flat)


# Closures

Scope = dict[str, Any]


def value_closure(node: Any, filters: Filters) -> Callable[[Scope], Any]:
    if isinstance(node, Constant):
        constant = node.value
        return lambda scope: constant
    if isinstance(node, Name):
        name = node.name

        def look_up(scope: Scope) -> Any:
            return scope.get(name)

        return look_up
    if isinstance(node, Item):
        of, key = value_closure(node.of, filters), value_closure(node.key, filters)

        def item(scope: Scope) -> Any:
            mapping = of(scope)
            return mapping.get(key(scope)) if isinstance(mapping, Mapping) else None

        return item
    args = [value_closure(a, filters) for a in node.args]
    if node.what in ("and", "or"):
        left, right = args
        if node.what == "and":
            return lambda scope: left(scope) and right(scope)
        return lambda scope: left(scope) or right(scope)
    function = _function(node.what, filters)
    return lambda scope: function(*(a(scope) for a in args))


def _with_last(values: Any) -> Iterator[tuple[int, Any, bool]]:
    pending, n = [], 0
    for value in values or ():
        if pending:
            yield n, pending.pop(), False
        n += 1
        pending.append(value)
    if pending:
        yield n, pending.pop(), True


def body_closure(body: tuple, filters: Filters, generated: bool = False) -> Callable[[Scope], Iterator[Piece]]:
    parts = [_node_closure(node, filters, generated) for node in body]

    def render(scope: Scope) -> Iterator[Piece]:
        for part in parts:
            yield from part(scope)

    return render


def _node_closure(node: Any, filters: Filters, generated: bool) -> Callable[[Scope], Iterator[Piece]]:
    if isinstance(node, Output):
        value = value_closure(node.value, filters)

        def output(scope: Scope) -> Iterator[Piece]:
            yield as_text(value(scope)), generated

        return output
    if isinstance(node, Generation):
        return body_closure(node.body, filters, True)
    if isinstance(node, Branch):
        condition = value_closure(node.condition, filters)
        then, otherwise = (body_closure(b, filters, generated) for b in (node.then, node.otherwise))
        return lambda scope: (then if condition(scope) else otherwise)(scope)
    over, body, name = value_closure(node.over, filters), body_closure(node.body, filters, generated), node.name

    def loop(scope: Scope) -> Iterator[Piece]:
        for index, value, last in _with_last(over(scope)):
            state = {"first": index == 1, "last": last, "index": index}
            yield from body({**scope, name: value, "loop": state})

    return loop


def parse_template(source: str) -> tuple:
    return Parser(source).body("")[0]


def compile_template(source: str, filters: Filters) -> Callable[[Scope], Iterator[Piece]]:
    """A function from names to (text, generated) pieces."""
    return body_closure(fold_body(parse_template(source), filters), filters)
