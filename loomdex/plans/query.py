"""The boolean query language: AND, OR, NOT, parentheses; leaves are a term, a prefix* or a wi*ld*card."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


class QueryError(ValueError):
    """A query that can't be parsed."""


@dataclass(frozen=True)
class Term:
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Prefix:
    text: str

    def __str__(self) -> str:
        return f"{self.text}*"


@dataclass(frozen=True)
class Wildcard:
    pattern: str

    def __str__(self) -> str:
        return self.pattern


@dataclass(frozen=True, init=False)
class _Chain:
    """Two or more parts under one operator, as read from left to right."""

    parts: tuple[Query, ...]

    def __init__(self, *parts: Query):
        first = parts[0]
        # what begins with a chain of the same kind goes on with it, so long chains don't nest
        object.__setattr__(self, "parts", (*first.parts, *parts[1:]) if type(first) is type(self) else parts)

    def __str__(self) -> str:
        return text_of(self)


class And(_Chain):
    word = "AND"


class Or(_Chain):
    word = "OR"


@dataclass(frozen=True)
class Not:
    inner: Query

    def __str__(self) -> str:
        return text_of(self)


Leaf = Term | Prefix | Wildcard
Query = Leaf | And | Or | Not


def fold(query: Query, leaf: Callable, node: Callable):
    """The query's value from the bottom up: `leaf` gives that of a leaf, `node` that of a chain or negation from the list of its parts' values.

    Works with a stack of its own, so a query may nest as deep as it likes.
    """
    todo: list[tuple[Query, bool]] = [(query, False)]
    done: list = []
    while todo:
        at, ready = todo.pop()
        parts = at.parts if isinstance(at, _Chain) else (at.inner,) if isinstance(at, Not) else ()
        if not parts:
            done.append(leaf(at))
        elif ready:
            values = done[-len(parts) :]
            del done[-len(parts) :]
            done.append(node(at, values))
        else:
            todo.append((at, True))
            todo += [(p, False) for p in reversed(parts)]
    return done[0]


def text_of(query: Query) -> str:
    """The tree as text, every two parts of a chain in parentheses."""

    def node(at: Query, values: list[str]) -> str:
        if isinstance(at, Not):
            return f"NOT {values[0]}"
        return "(" * (len(values) - 1) + values[0] + "".join(f" {at.word} {v})" for v in values[1:])

    return fold(query, str, node)


#: Python counts these separators as blanks, the query language doesn't.
_NOT_BLANK = "\x1c\x1d\x1e\x1f"


def lex(text: str) -> list[str]:
    """Words and single parentheses, parted by blanks."""
    spaced = "".join(f" {c} " if c in "()" else " " if c.isspace() and c not in _NOT_BLANK else c for c in text)
    return [t for t in spaced.split(" ") if t]


def leaf(token: str) -> Leaf:
    """One star at the end of a longer token makes a prefix, any other star a wildcard."""
    if "*" not in token:
        return Term(token)
    return Prefix(token[:-1]) if len(token) > 1 and token.find("*") == len(token) - 1 else Wildcard(token)


def parse(text: str) -> Query:
    """The query's tree; AND binds more than OR, both to the left. There is no implied operator between two words."""
    tokens = lex(text)
    if not tokens:
        raise QueryError("empty query")
    # of every open parenthesis: the parts of its OR chain, those of the AND chain at work, and the NOTs before the next operand
    levels: list[tuple[list[Query], list[Query], int]] = [([], [], 0)]
    operand = True  # whether an operand comes next
    for at, token in enumerate(tokens):
        word = token.upper()
        ors, ands, nots = levels[-1]
        if operand and word == "NOT":
            levels[-1] = ors, ands, nots + 1
        elif operand and token == "(":
            levels.append(([], [], 0))
        elif operand:
            ands.append(_negated(leaf(token), nots))
            levels[-1], operand = (ors, ands, 0), False
        elif word == "AND":
            operand = True
        elif word == "OR":
            ors.append(_chain(And, ands))
            levels[-1], operand = (ors, [], 0), True
        elif token == ")" and len(levels) > 1:
            levels.pop()
            inner = _chain(Or, [*ors, _chain(And, ands)])
            ors, ands, nots = levels[-1]
            ands.append(_negated(inner, nots))
            levels[-1] = ors, ands, 0
        elif len(levels) > 1:
            raise QueryError("expected closing parenthesis")
        else:
            raise QueryError(f"unexpected token at position {at}: {token}")
    if operand:
        raise QueryError("unexpected end of query")
    if len(levels) > 1:
        raise QueryError("expected closing parenthesis")
    ors, ands, _ = levels[0]
    return _chain(Or, [*ors, _chain(And, ands)])


def _negated(query: Query, times: int) -> Query:
    for _ in range(times):
        query = Not(query)
    return query


def _chain(kind: type, parts: list[Query]) -> Query:
    return parts[0] if len(parts) == 1 else kind(*parts)


def leaves(query: Query) -> list[Leaf]:
    """Distinct leaves, from left to right."""
    out: dict[Leaf, None] = {}
    fold(query, lambda leaf: out.setdefault(leaf), lambda at, values: None)
    return list(out)


def holds(query: Query, truth: Callable[[Leaf], bool]) -> bool:
    """The query's value, given each leaf's."""
    return fold(query, truth, lambda at, v: not v[0] if isinstance(at, Not) else all(v) if isinstance(at, And) else any(v))
