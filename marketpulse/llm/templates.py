"""A small sandboxed template language, compiled to Python closures.

``{{ expression }}`` prints, ``{% for x in list %}``, ``{% if e %}``, ``{% elif e %}``,
``{% else %}`` and ``{% end... %}`` control, ``{% generation %}`` marks what a model is to
learn. Expressions know strings, names, ``name.field``, ``+``, ``==``, ``!=``, ``not``,
``and``, ``or`` and the filters given to the compiler. A field is a key of a dict and
nothing else: a template cannot reach attributes, call or import anything.

Source becomes a syntax tree, constants are folded, and the tree becomes closures that
yield (text, marked) pieces. Lists are walked lazily, so a long conversation need not be
in memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

_PART = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_LEX = re.compile(
    r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[+|.()]))""", re.DOTALL
)
_ESCAPES = {"n": "\n", "t": "\t"}

Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; yields nested tuples."""

    def __init__(self, source: str, filters):
        self.filters, self.tokens, at = filters, [], 0
        source = source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            string, name, sign = m.groups()
            if string is not None:
                text = re.sub(
                    r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), string[1:-1], flags=re.DOTALL
                )
                self.tokens.append(("const", text))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def parse(self):
        tree = self._or()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def _take(self, *wanted):
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _or(self):
        left = self._and()
        while self._take(("name", "or")):
            left = ("or", left, self._and())
        return left

    def _and(self):
        left = self._not()
        while self._take(("name", "and")):
            left = ("and", left, self._not())
        return left

    def _not(self):
        if self._take(("name", "not")):
            return ("not", self._not())
        left = self._sum()
        sign = self._take(("sign", "=="), ("sign", "!="))
        return (sign, left, self._sum()) if sign else left

    def _sum(self):
        left = self._filtered()
        while self._take(("sign", "+")):
            left = ("+", left, self._filtered())
        return left

    def _filtered(self):
        left = self._atom()
        while self._take(("sign", "|")):
            name = self._name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            left = ("filter", name, left)
        return left

    def _atom(self):
        if self._take(("sign", "(")):
            inner = self._or()
            if not self._take(("sign", ")")):
                raise TemplateError("a bracket is not closed")
            return inner
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return self.tokens[self.at - 1]
        tree = ("name", self._name())
        while self._take(("sign", ".")):
            tree = ("field", tree, self._name())
        return tree

    def _name(self):
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")


def parse(source: str, filters) -> tuple:
    """The syntax tree of a template."""
    parts = _PART.split(source)
    tree, at, _ = _block(parts, 0, (), filters)
    if at < len(parts):
        raise TemplateError("an end has no beginning")
    return tree


def _block(parts, at, ends, filters):
    out = []
    while at < len(parts):
        part = parts[at]
        at += 1
        if part.startswith("{{"):
            out.append(("print", _Expression(part[2:-2], filters).parse()))
        elif part.startswith("{%"):
            body = part[2:-2].strip()
            word, _, rest = body.partition(" ")
            if word in ends:
                return ("block", out), at, (word, rest)
            if word == "generation":
                inner, at, _ = _inner(parts, at, ("endgeneration",), filters)
                out.append(("generation", inner))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.DOTALL)
                if not m:
                    raise TemplateError(f"cannot read {body!r}")
                inner, at, _ = _inner(parts, at, ("endfor",), filters)
                out.append(("for", m[1], _Expression(m[2], filters).parse(), inner))
            elif word == "if":
                branches, test = [], rest
                while True:
                    inner, at, (end, more) = _inner(
                        parts, at, ("elif", "else", "endif"), filters
                    )
                    condition = (
                        ("const", "1") if test is None else _Expression(test, filters).parse()
                    )
                    branches.append((condition, inner))
                    if end == "endif":
                        break
                    test = more if end == "elif" else None
                out.append(("if", branches))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        elif part:
            out.append(("print", ("const", part)))
    return ("block", out), at, ("", "")


def _inner(parts, at, ends, filters):
    tree, at, end = _block(parts, at, ends, filters)
    if not end[0]:
        raise TemplateError(f"{ends[-1]} is missing")
    return tree, at, end


def fold(tree, filters):
    """Evaluate what depends on no name; join neighbouring constant text."""
    kind = tree[0]
    if kind == "block":
        out = []
        for node in (fold(x, filters) for x in tree[1]):
            if node[0] == "block":
                out += node[1]
            elif node != ("print", ("const", "")):
                out.append(node)
        joined = []
        for node in out:
            if joined and _constant(node) and _constant(joined[-1]):
                joined[-1] = ("print", ("const", joined[-1][1][1] + node[1][1]))
            else:
                joined.append(node)
        return ("block", joined)
    if kind == "print":
        return ("print", fold(tree[1], filters))
    if kind == "generation":
        return ("generation", fold(tree[1], filters))
    if kind == "for":
        return ("for", tree[1], fold(tree[2], filters), fold(tree[3], filters))
    if kind == "if":
        branches = []
        for test, body in tree[1]:
            test = fold(test, filters)
            if test == ("const", ""):
                continue
            branches.append((test, fold(body, filters)))
            if test[0] == "const":
                break
        if branches and branches[0][0][0] == "const":
            return branches[0][1]
        return ("if", branches) if branches else ("block", [])
    if kind in ("const", "name"):
        return tree
    if kind == "filter":
        inner = fold(tree[2], filters)
        return ("const", filters[tree[1]](inner[1])) if inner[0] == "const" else (
            "filter", tree[1], inner,
        )
    if kind == "field":
        return ("field", fold(tree[1], filters), tree[2])
    parts = [fold(x, filters) for x in tree[1:]]
    if all(p[0] == "const" for p in parts):
        value = _OPERATIONS[kind](*(p[1] for p in parts))
        return ("const", value if isinstance(value, str) else "1" if value else "")
    return (kind, *parts)


def _constant(node) -> bool:
    return node[0] == "print" and node[1][0] == "const"


_OPERATIONS: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def _value(tree, filters) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        text = tree[1]
        return lambda scope: text
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name, "")
    if kind == "field":
        inner, key = _value(tree[1], filters), tree[2]

        def field(scope):
            holder = inner(scope)
            return holder.get(key, "") if isinstance(holder, dict) else ""

        return field
    if kind == "filter":
        inner, change = _value(tree[2], filters), filters[tree[1]]
        return lambda scope: change(inner(scope))
    parts, operation = [_value(x, filters) for x in tree[1:]], _OPERATIONS[kind]
    if len(parts) == 1:
        return lambda scope: operation(parts[0](scope))
    left, right = parts
    return lambda scope: operation(left(scope), right(scope))


def _pieces(tree, filters, marked: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = tree[0]
    if kind == "block":
        parts = [_pieces(x, filters, marked) for x in tree[1]]

        def block(scope):
            for part in parts:
                yield from part(scope)

        return block
    if kind == "print":
        value = _value(tree[1], filters)

        def printed(scope):
            if text := value(scope):
                yield str(text), marked

        return printed
    if kind == "generation":
        return _pieces(tree[1], filters, True)
    if kind == "for":
        name, items, body = tree[1], _value(tree[2], filters), _pieces(tree[3], filters, marked)

        def loop(scope):
            for item in items(scope):
                yield from body({**scope, name: item})

        return loop
    branches = [(_value(t, filters), _pieces(b, filters, marked)) for t, b in tree[1]]

    def choice(scope):
        for test, body in branches:
            if test(scope):
                yield from body(scope)
                return

    return choice


def compile_template(
    source: str, filters: dict[str, Callable[[str], str]] | None = None
) -> Callable[[dict], Iterator[Piece]]:
    """A function from names to (text, marked) pieces."""
    filters = filters or {}
    return _pieces(fold(parse(source, filters), filters), filters, False)
