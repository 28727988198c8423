"""Boolean query language: parsing on the driver, compilation to a column predicate.

Grammar, loosest first: OR (`|`), AND (`&`, or nothing between two operands), NOT (`-`), then a term, a "quoted phrase" or
a parenthesised query. Operators are recognised in any case; inside quotes every token is a word.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions.text import TOKEN

_TOKEN = regex.compile(TOKEN)


class SearchMode(Enum):
    AND = "AND"
    OR = "OR"
    NOT = "NOT"
    PHRASE = "PHRASE"
    QUERY_EVALUATOR = "QUERY_EVALUATOR"
    SEMANTIC = "SEMANTIC"

    def __str__(self) -> str:
        return self.value


@dataclass(frozen=True)
class Leaf:
    """One term, or the words of a phrase. `exact` leaves are matched as they are: no spelling, no stop words."""

    words: tuple[str, ...]
    exact: bool = False


@dataclass(frozen=True)
class Op:
    name: str  # AND, OR, NOT
    args: tuple[Node, ...]


Node = Leaf | Op

_OPS = {"and": "AND", "&": "AND", "or": "OR", "|": "OR", "not": "NOT", "-": "NOT"}
_BINDS = {"OR": 1, "AND": 2, "NOT": 3}


def query_tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _lexemes(tokens: list[str]) -> list[tuple[str, object]]:
    """(kind, value) with kind one of leaf, op, open, close; with the ANDs that nothing between operands means."""
    out: list[tuple[str, object]] = []
    it = iter(tokens)

    def put(kind: str, value: object) -> None:
        starts = kind in ("leaf", "open") or value == "NOT"
        if starts and out and out[-1][0] in ("leaf", "close"):
            out.append(("op", "AND"))
        out.append((kind, value))

    for t in it:
        if t == '"':
            words: list[str] = []
            for w in it:
                if w == '"':
                    break
                words.append(w)
            else:
                raise ValueError("a quote is not closed")
            if words:
                put("leaf", Leaf(tuple(words), True))
        elif t in "()":
            put("open" if t == "(" else "close", t)
        elif t.lower() in _OPS:
            put("op", _OPS[t.lower()])
        else:
            put("leaf", Leaf((t,)))
    return out


def to_postfix(tokens: list[str]) -> list[Leaf | str]:
    """Leaves and operator names in postfix order; ValueError for a query that is not well formed."""
    out: list[Leaf | str] = []
    stack: list[str] = []
    operand = False  # whether an operand has just ended
    for kind, v in _lexemes(tokens):
        if kind == "leaf":
            out.append(v)
            operand = True
        elif kind == "open":
            stack.append("(")
            operand = False
        elif kind == "close":
            if not operand:
                raise ValueError("nothing before )")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("mismatched parentheses")
            stack.pop()
        elif v == "NOT":  # binds to what follows, so it waits
            stack.append(v)
            operand = False
        else:
            if not operand:
                raise ValueError(f"nothing before {v}")
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[v]:
                out.append(stack.pop())
            stack.append(v)
            operand = False
    if (out or stack) and not operand:
        raise ValueError("the query ends with an operator")
    while stack:
        if stack[-1] == "(":
            raise ValueError("mismatched parentheses")
        out.append(stack.pop())
    return out


def build_tree(postfix: list[Leaf | str]) -> Node | None:
    """The tree of a postfix query; None for an empty one."""
    stack: list[Node] = []
    for x in postfix:
        if isinstance(x, Leaf):
            stack.append(x)
        elif x == "NOT":
            stack.append(Op("NOT", (stack.pop(),)))
        else:
            right = stack.pop()
            stack.append(Op(x, (stack.pop(), right)))
    return stack[0] if stack else None


def parse(text: str | None, mode: SearchMode = SearchMode.QUERY_EVALUATOR) -> Node | None:
    """The tree of a query in any mode; None where it has no token."""
    tokens = query_tokens(text)
    if not tokens:
        return None
    if mode is SearchMode.QUERY_EVALUATOR:
        return build_tree(to_postfix(tokens))
    if mode is SearchMode.PHRASE:
        return Leaf(tuple(tokens), True)
    leaves = tuple(Leaf((t,)) for t in tokens)
    if mode is SearchMode.NOT:
        return Op("NOT", (Op("OR", leaves),))
    if mode in (SearchMode.AND, SearchMode.OR):
        return Op(mode.value, leaves)
    raise ValueError(f"{mode} has no lexical form")


def leaves(node: Node | None) -> list[Leaf]:
    """In order, repeated ones repeated."""
    if node is None:
        return []
    return [node] if isinstance(node, Leaf) else [x for a in node.args for x in leaves(a)]


def simplified(node: Node | None, change: Callable[[Leaf], Leaf | None]) -> tuple[Node | None, bool]:
    """The tree with its leaves changed and those for which `change` gives None left out. The second value tells of a node
    that vanished below a NOT: it then stands for every document, as nothing is taken away."""
    if node is None:
        return None, False
    if isinstance(node, Leaf):
        return change(node), False
    if node.name == "NOT":
        inner, every = simplified(node.args[0], change)
        if every:
            return Op("OR", ()), False  # no document
        return (Op("NOT", (inner,)), False) if inner is not None else (None, True)
    kept, every = [], False
    for a in node.args:
        n, e = simplified(a, change)
        every |= e
        if n is not None:
            kept.append(n)
        elif e and node.name == "OR":
            return None, True
    if not kept:
        return None, every
    return (kept[0] if len(kept) == 1 else Op(node.name, tuple(kept))), False


def numbered(node: Node) -> tuple[str, list[Leaf]]:
    """The tree's shape with leaves as numbers, and the leaves: queries of one shape share one predicate."""
    found: list[Leaf] = []

    def go(n: Node) -> str:
        if isinstance(n, Leaf):
            found.append(n)
            return str(len(found) - 1)
        return f"{n.name}({','.join(go(a) for a in n.args)})"

    return go(node), found


def predicate(node: Node, has: Callable[[int], Column]) -> Column:
    """A column that is true where the tree holds; has(i) is true where leaf i matches."""
    count = -1

    def go(n: Node) -> Column:
        nonlocal count
        if isinstance(n, Leaf):
            count += 1
            return has(count)
        parts = [go(a) for a in n.args]
        if n.name == "NOT":
            return ~parts[0]
        out = F.lit(n.name == "AND")
        for p in parts:
            out = (out & p) if n.name == "AND" else (out | p)
        return out

    return go(node)


def holds(node: Node, true: set[int]) -> bool:
    """The tree's value with just these leaves true."""
    count = -1

    def go(n: Node) -> bool:
        nonlocal count
        if isinstance(n, Leaf):
            count += 1
            return count in true
        parts = [go(a) for a in n.args]
        return not parts[0] if n.name == "NOT" else (all(parts) if n.name == "AND" else any(parts))

    return go(node)
