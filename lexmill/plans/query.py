"""The query language: words, phrases, AND, OR, NOT and parentheses.

``NOT`` binds closest, then ``AND`` (also where two operands stand side by side), then ``OR``; both associate to the
left. The parser keeps two stacks and does not recurse, so depth is not limited. Offsets in errors count bytes of
the trimmed query, but for an open quote, where they count bytes of the query as given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from lexmill.functions.text import TextOptions, tokenize


@dataclass(frozen=True)
class Term:
    term: str


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    child: Node


Node = Term | Phrase | And | Or | Not


class QueryError(ValueError):
    def __init__(self, offset: int, message: str):
        super().__init__(f"Query error at {offset}: {message}")
        self.offset, self.message = offset, message


_BLANK = " \t\n\v\f\r"
_LEX = re.compile(rf'(?P<open>\()|(?P<close>\))|"(?P<phrase>[^"]*)"|(?P<word>[^{_BLANK}()"]+)')
_BINDS = {"OR": 1, "AND": 2, "NOT": 3}


def parse(text: str, options: TextOptions = TextOptions()) -> Node:
    """The tree of a query, or QueryError."""
    raw = text.encode("utf-8", "surrogateescape").decode("latin-1")  # one character a byte
    quotes = [i for i, c in enumerate(raw) if c == '"']
    if len(quotes) % 2:
        raise QueryError(quotes[-1], "Unterminated phrase (missing '\"')")
    raw = raw.strip(_BLANK)
    if not raw:
        raise QueryError(0, "Empty query")
    values: list[Node] = []
    waiting: list[tuple[str, int]] = []  # operators and open parentheses

    def reduce(least: int) -> None:
        while waiting and _BINDS.get(waiting[-1][0], 0) >= least:
            name = waiting.pop()[0]
            right = values.pop()
            values.append(Not(right) if name == "NOT" else (And if name == "AND" else Or)(values.pop(), right))

    complete = False  # whether an operand ends here
    for found in _LEX.finditer(raw):
        at, kind = found.start(), found.lastgroup
        word = (found["word"] or "").upper() if kind == "word" else ""
        if complete:
            if word in ("AND", "OR"):
                reduce(_BINDS[word])
                waiting.append((word, at))
                complete = False
                continue
            if kind == "close":
                reduce(1)
                if not waiting:
                    raise QueryError(at, "Unexpected token after query")
                waiting.pop()
                reduce(3)
                continue
            reduce(2)
            waiting.append(("AND", at))
            complete = False
        if kind == "open":
            waiting.append(("(", at))
        elif kind == "close":
            raise QueryError(at, "Unexpected ')'")
        elif word == "NOT":
            waiting.append(("NOT", at))
        elif word in ("AND", "OR"):
            raise QueryError(at, "Unexpected token")
        else:
            values.append(_phrase(found["phrase"], at, options) if kind == "phrase" else _term(found["word"], at, options))
            complete = True
            reduce(3)
    if not complete:
        raise QueryError(len(raw), "Unexpected end of query")
    opened = [at for name, at in waiting if name == "("]
    if opened:
        raise QueryError(opened[-1], "Unmatched '(' — expected ')'")
    reduce(1)
    return values[0]


def _term(word: str, at: int, options: TextOptions) -> Term:
    """A word stands for its first token; one that has none, for its letters and digits as they are."""
    found = tokenize(word, options)
    term = found[0] if found else "".join(tokenize(word))
    if not term:
        raise QueryError(at, "Empty term after tokenization")
    return Term(term)


def _phrase(body: str, at: int, options: TextOptions) -> Phrase:
    found = tuple(tokenize(body, options))
    if not found:
        raise QueryError(at, "Empty phrase query")
    return Phrase(found)


def leaves(node: Node) -> Iterator[Term | Phrase]:
    """Terms and phrases from left to right, also those under NOT."""
    stack = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, Not):
            stack.append(top.child)
        elif isinstance(top, (And, Or)):
            stack += [top.right, top.left]
        else:
            yield top


def query_terms(node: Node) -> list[str]:
    """All terms that score, in order and with repetitions."""
    return [t for leaf in leaves(node) for t in ((leaf.term,) if isinstance(leaf, Term) else leaf.terms)]


def is_bag(node: Node) -> bool:
    """Whether the query is made of terms and AND only: such a query is ranked over the union of its terms."""
    stack = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, And):
            stack += [top.left, top.right]
        elif not isinstance(top, Term):
            return False
    return True


def fold(node: Node, term, phrase, both, either, invert):
    """Evaluates a tree from its leaves up, without recursion."""
    done, stack = [], [(node, False)]
    while stack:
        top, seen = stack.pop()
        if isinstance(top, Term):
            done.append(term(top))
        elif isinstance(top, Phrase):
            done.append(phrase(top))
        elif not seen:
            stack.append((top, True))
            stack += [(top.child, False)] if isinstance(top, Not) else [(top.right, False), (top.left, False)]
        elif isinstance(top, Not):
            done.append(invert(done.pop()))
        else:
            right = done.pop()
            done.append((both if isinstance(top, And) else either)(done.pop(), right))
    return done[0]
