"""A small sandboxed template language for chat formats, compiled to Python closures.

    {{ expression | filter }}        writes a value
    {% for x in xs %} ... {% endfor %}
    {% if a %} ... {% elif b %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}   marks what is written inside as generated

Expressions: strings, whole numbers, true, false, none, names, x.key, loop.index0, loop.first, ==, !=,
and, or, not, +, parentheses, filters. A name or key reads a dict entry and nothing else; there are
no calls, no Python attributes and no way to reach an object that was not passed in. Parsing gives
a syntax tree, constant parts are folded, and each node becomes a closure over its children.
Closures are generators of (text, generated) pairs, so a loop may run over an endless iterator.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

_TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{.*?\}\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<text>\"[^\"]*\"|'[^']*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[|.()+]))")
_CONSTANTS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    kind: str
    value: Any = None
    parts: list[Node] = field(default_factory=list)


# ---- expressions


class _Expressions:
    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            if not (found := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at:at + 20]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def accept(self, *signs: str) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.peek() in signs:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return ""

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.accept("or"):
            node = Node("or", parts=[node, self.both()])
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.accept("and"):
            node = Node("and", parts=[node, self.negated()])
        return node

    def negated(self) -> Node:
        return Node("not", parts=[self.negated()]) if self.accept("not") else self.compared()

    def compared(self) -> Node:
        node = self.added()
        if sign := self.accept("==", "!="):
            node = Node(sign, parts=[node, self.added()])
        return node

    def added(self) -> Node:
        node = self.filtered()
        while self.accept("+"):
            node = Node("+", parts=[node, self.filtered()])
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.accept("|"):
            node = Node("filter", self.name(), [node])
        return node

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> Node:
        if self.accept("("):
            node = self.either()
            if not self.accept(")"):
                raise TemplateError("a ) is missing")
        elif self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        else:
            kind, text = self.tokens[self.at]
            self.at += 1
            if kind == "text":
                node = Node("constant", text[1:-1].encode().decode("unicode_escape") if text.isascii() else text[1:-1])
            elif kind == "number":
                node = Node("constant", int(text))
            elif kind == "name":
                node = Node("constant", _CONSTANTS[text]) if text in _CONSTANTS else Node("name", text)
            else:
                raise TemplateError(f"unexpected {text!r}")
        while self.accept("."):
            node = Node("key", self.name(), [node])
        return node


# ---- statements


def parse(source: str) -> Node:
    pieces = _trimmed(_TAG.split(source))
    root, rest = _block(pieces, 0, ())
    if rest < len(pieces):
        raise TemplateError(f"unexpected {pieces[rest]}")
    return root


def _trimmed(pieces: list[str]) -> list[str]:
    """The pieces that are not empty; a tag's inner hyphens take the white space beside it away."""
    out, cut = [""], False
    for piece in pieces:
        if piece.startswith(("{{", "{%")):
            inner = piece[2:-2]
            if inner.startswith("-") and not out[-1].startswith(("{{", "{%")):
                out[-1] = out[-1].rstrip()
            cut = inner.endswith("-")
            out.append(piece[:2] + inner.removeprefix("-").removesuffix("-") + piece[-2:])
        elif piece:
            out.append(piece.lstrip() if cut else piece)
            cut = False
    return [x for x in out if x]


def _statement(piece: str) -> list[str]:
    return piece[2:-2].strip().split(None, 1) if piece.startswith("{%") else []


def _block(pieces: list[str], at: int, ends: tuple[str, ...]) -> tuple[Node, int]:
    block = Node("block")
    while at < len(pieces):
        piece = pieces[at]
        word, *rest = _statement(piece) or [""]
        argument = rest[0] if rest else ""
        if word in ends and word:
            return block, at
        at += 1
        if piece.startswith("{{"):
            block.parts.append(Node("write", parts=[_Expressions(piece[2:-2]).whole()]))
        elif not piece.startswith("{%"):
            block.parts.append(Node("write", parts=[Node("constant", piece)]))
        elif word == "set":
            name, _, value = argument.partition("=")
            block.parts.append(Node("set", name.strip(), [_Expressions(value).whole()]))
        elif word == "for":
            if not (found := re.fullmatch(r"(\w+)\s+in\s+(.+)", argument, re.S)):
                raise TemplateError(f"unexpected {piece}")
            body, at = _until(pieces, at, ("endfor",))
            block.parts.append(Node("for", found[1], [_Expressions(found[2]).whole(), body]))
            at += 1
        elif word == "generation":
            body, at = _until(pieces, at, ("endgeneration",))
            block.parts.append(Node("generation", parts=[body]))
            at += 1
        elif word == "if":
            node, at = _branches(pieces, at, argument)
            block.parts.append(node)
        else:
            raise TemplateError(f"unexpected {piece}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return block, at


def _until(pieces: list[str], at: int, ends: tuple[str, ...]) -> tuple[Node, int]:
    return _block(pieces, at, ends)


def _branches(pieces: list[str], at: int, condition: str) -> tuple[Node, int]:
    then, at = _block(pieces, at, ("elif", "else", "endif"))
    word, *rest = _statement(pieces[at])
    otherwise = Node("block")
    if word == "elif":
        otherwise, at = _branches(pieces, at + 1, rest[0] if rest else "")
    elif word == "else":
        otherwise, at = _block(pieces, at + 1, ("endif",))
        at += 1
    else:
        at += 1
    return Node("if", parts=[_Expressions(condition).whole(), then, otherwise]), at


# ---- folding


def fold(node: Node, filters: dict[str, Callable]) -> Node:
    """The tree with constant parts computed: expressions, branches and neighbouring texts."""
    parts = [fold(x, filters) for x in node.parts]
    constant = bool(parts) and all(x.kind == "constant" for x in parts)
    if node.kind in ("or", "and", "not", "==", "!=", "+", "filter") and constant:
        return Node("constant", _expression(Node(node.kind, node.value, parts), filters)({}))
    if node.kind == "if" and parts[0].kind == "constant":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "block":
        flat: list[Node] = []
        for x in parts:
            for y in x.parts if x.kind == "block" else [x]:
                texts = [z.kind == "write" and z.parts[0].kind == "constant" for z in (*flat[-1:], y)]
                if len(texts) == 2 and all(texts):
                    flat[-1] = Node("write", parts=[Node("constant", _text(flat[-1].parts[0].value) + _text(y.parts[0].value))])
                else:
                    flat.append(y)
        return Node("block", parts=flat)
    return Node(node.kind, node.value, parts)


# ---- closures


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _expression(node: Node, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    parts = [_expression(x, filters) for x in node.parts]
    value = node.value
    if node.kind == "constant":
        return lambda names: value
    if node.kind == "name":
        return lambda names: names.get(value)
    one = parts[0]
    if node.kind == "key":
        return lambda names: found.get(value) if isinstance(found := one(names), dict) else None
    if node.kind == "not":
        return lambda names: not one(names)
    if node.kind == "filter":
        if value not in filters:
            raise TemplateError(f"no filter {value}")
        made = filters[value]
        return lambda names: made(_text(one(names)))
    two = parts[1]
    return {
        "or": lambda names: one(names) or two(names),
        "and": lambda names: one(names) and two(names),
        "==": lambda names: one(names) == two(names),
        "!=": lambda names: one(names) != two(names),
        "+": lambda names: a + b if isinstance(a := one(names), int) & isinstance(b := two(names), int) else _text(a) + _text(b),
    }[node.kind]


Writer = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _writer(node: Node, filters: dict[str, Callable]) -> Writer:
    if node.kind == "block":
        writers = [_writer(x, filters) for x in node.parts]

        def block(names: dict, on: bool) -> Iterator[tuple[str, bool]]:
            for write in writers:
                yield from write(names, on)

        return block
    if node.kind == "generation":
        inside = _writer(node.parts[0], filters)
        return lambda names, on: inside(names, True)
    value = _expression(node.parts[0], filters)
    if node.kind == "write":

        def write(names: dict, on: bool) -> Iterator[tuple[str, bool]]:
            yield _text(value(names)), on

        return write
    if node.kind == "set":
        name = node.value

        def assign(names: dict, on: bool) -> Iterator[tuple[str, bool]]:
            names[name] = value(names)
            yield from ()

        return assign
    if node.kind == "if":
        then, otherwise = (_writer(x, filters) for x in node.parts[1:])
        return lambda names, on: (then if value(names) else otherwise)(names, on)
    body, name = _writer(node.parts[1], filters), node.value

    def loop(names: dict, on: bool) -> Iterator[tuple[str, bool]]:
        for i, x in enumerate(value(names) or ()):
            yield from body(names | {name: x, "loop": {"index0": i, "first": i == 0}}, on)

    return loop


def compile_template(source: str, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[[dict[str, Any]], Iterable[tuple[str, bool]]]:
    """A function from names to (text, generated) pairs."""
    filters = filters or {}
    write = _writer(fold(parse(source), filters), filters)
    return lambda names: write(dict(names), False)
