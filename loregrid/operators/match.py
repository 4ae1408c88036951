"""Boolean matching: the match grammar, and its conditions over texts or over stored positions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fts import split, terms


class MatchError(ValueError):
    """The text is no query of the match grammar."""


@dataclass(frozen=True)
class Phrase:
    """Tokens side by side; starts[i] says that any token that begins with tokens[i] will do."""

    tokens: tuple[str, ...]
    starts: tuple[bool, ...]


@dataclass(frozen=True)
class Node:
    """and, or, not with parts; near with phrases (one alone is just that phrase), at a column's start if initial, within only: sets of columns (names, and whether those are left out) that all must allow it."""

    kind: str
    parts: tuple[Node, ...] = ()
    phrases: tuple[Phrase, ...] = ()
    gap: int = 10
    initial: bool = False
    only: tuple[tuple[frozenset[str], bool], ...] = ()

    @property
    def empty(self) -> bool:
        return self.kind == "near" and not any(p.tokens for p in self.phrases)

    def leaves(self) -> list[Node]:
        return [self] if self.kind == "near" else [x for p in self.parts for x in p.leaves()]


_TOKEN = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<sign>[-(){}:,+*^])|(?P<word>[\w\x1a\x80-\U0010ffff]+))')
_OPERATORS = ("AND", "OR", "NOT")


def parse(text: str) -> Node:
    """Words and "phrases" (a doubled quote stands for one), tokens+side+by+side, prefix*, ^initial, NEAR(a "b c", n); column: or {two columns}: before one of these or a group, with - all columns but
    those; AND, OR, NOT and parentheses. NOT binds closer than AND, and AND than OR; words without an operator between them bind closest of all, as AND, and groups need an operator.

    A word is made into tokens as the text is; several make a phrase. One without tokens matches nothing, but is passed over among words without operators and in NEAR.
    """
    found, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise MatchError(f"syntax error near {text[at:]!r}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    if not found:
        raise MatchError("an empty query")
    found.append(("end", ""))
    spot = 0

    def peek(n: int = 0) -> tuple[str, str]:
        return found[min(spot + n, len(found) - 1)]

    def take(sign: str | None = None) -> tuple[str, str]:
        nonlocal spot
        if sign is not None and found[spot] != ("sign", sign):
            raise MatchError(f"{sign!r} is missing")
        spot += 1
        return found[spot - 1]

    def chain(word: str, kind: str, below: Callable[[], Node]) -> Node:
        out = below()
        while peek() == ("word", word):
            take()
            out = Node(kind, (out, below()))
        return out

    def any_of() -> Node:
        return chain("OR", "or", lambda: chain("AND", "and", lambda: chain("NOT", "not", side_by_side)))

    def columns() -> tuple[frozenset[str], bool] | None:
        """A column filter, if one stands here."""
        n = 1 if peek() == ("sign", "-") else 0
        if peek(n) == ("sign", "{"):
            out = peek() == ("sign", "-")
            for _ in range(n + 1):
                take()
            names = []
            while peek() != ("sign", "}"):
                names.append(name())
            take()
            if not names:
                raise MatchError("no column is named")
            take(":")
            return frozenset(names), out
        if peek(n)[0] in ("word", "quoted") and peek(n)[1] not in _OPERATORS and peek(n + 1) == ("sign", ":"):
            out = bool(n)
            for _ in range(n):
                take()
            names = frozenset([name()])
            take()
            return names, out
        return None

    def name() -> str:
        kind, value = take()
        if kind not in ("word", "quoted") or kind == "word" and value in _OPERATORS:
            raise MatchError(f"{value!r} is no column")
        return (value[1:-1].replace('""', '"') if kind == "quoted" else value).lower()

    def side_by_side() -> Node:
        """A group, or words without operators between them."""
        of = columns()
        if peek() == ("sign", "("):
            take()
            inner = any_of()
            take(")")
            return within(inner, of) if of else inner
        out = single(of)
        while peek()[0] in ("word", "quoted") and peek()[1] not in _OPERATORS or peek() in (("sign", "^"), ("sign", "-"), ("sign", "{")):
            right = single(columns())
            out = right if out.empty else out if right.empty else Node("and", (out, right))
        return out

    def single(of) -> Node:
        only = (of,) if of else ()
        if peek() == ("sign", "^"):
            take()
            return Node("near", phrases=(phrase(),), initial=True, only=only)
        if peek() == ("word", "NEAR") and peek(1) == ("sign", "("):
            take()
            take()
            held, gap = [phrase()], 10
            while peek()[0] in ("word", "quoted"):
                held.append(phrase())
            if peek() == ("sign", ","):
                take()
                kind, value = take()
                if kind != "word" or not re.fullmatch(r"[0-9]+", value):
                    raise MatchError(f"{value!r} is no number")
                gap = int(value)
            take(")")
            return Node("near", phrases=tuple(p for p in held if p.tokens) or held[:1], gap=gap, only=only)
        return Node("near", phrases=(phrase(),), only=only)

    def phrase() -> Phrase:
        tokens, starts = [], []
        while True:
            kind, value = take()
            if kind not in ("word", "quoted") or kind == "word" and value in _OPERATORS:
                raise MatchError(f"{value!r} is out of place")
            new = split(value[1:-1].replace('""', '"') if kind == "quoted" else value)
            tokens += new
            starts += [False] * len(new)
            starred = peek() == ("sign", "*")
            if starred:
                take()
            if starts:
                starts[-1] = starred  # also where this part has no token: the last one there is
            if peek() != ("sign", "+"):
                return Phrase(tuple(tokens), tuple(starts))
            take()

    tree = any_of()
    if peek()[0] != "end":
        raise MatchError(f"{peek()[1]!r} is out of place")
    return tree


def within(node: Node, of: tuple[frozenset[str], bool]) -> Node:
    """The node with all its leaves kept to the columns."""
    if node.kind == "near":
        return replace(node, only=(*node.only, of))
    return replace(node, parts=tuple(within(p, of) for p in node.parts))


def columns_of(leaf: Node, held: tuple[str, ...]) -> list[str]:
    """The columns that a leaf may stand in."""
    for names, _ in leaf.only:
        if lost := names - {c.lower() for c in held}:
            raise MatchError(f"no column {', '.join(sorted(lost))}")
    return [c for c in held if all((c.lower() in names) != out for names, out in leaf.only)]


# ---------------------------------------------------------------- conditions


def combined(node: Node, leaf: Callable[[Node], Column]) -> Column:
    """The tree as a condition, from its leaves' conditions."""
    if node.kind == "near":
        return leaf(node)
    a, b = (combined(p, leaf) for p in node.parts)
    return a & b if node.kind == "and" else a | b if node.kind == "or" else a & ~b


def starts_of(phrase: Phrase, spots: Callable[[str, bool], Column]) -> Column:
    """Where a phrase begins: the first token's places that the others follow. spots: a token's places."""
    first, *rest = [spots(t, s) for t, s in zip(phrase.tokens, phrase.starts)]
    return F.filter(first, lambda p: _all([F.array_contains(x, p + n) for n, x in enumerate(rest, 1)])) if rest else first


def stands(leaf: Node, spots: Callable[[str, bool], Column]) -> Column:
    """Whether a leaf stands in one column: for some place that a phrase begins at, every phrase begins there or before, and ends at most the gap's tokens before."""
    if leaf.empty:
        return F.lit(False)
    begins = [starts_of(p, spots) for p in leaf.phrases]
    if leaf.initial:
        return F.array_contains(begins[0], 0)
    if len(begins) == 1:
        return F.size(begins[0]) > 0

    def reaches(begin: Column, least: Column, last: Column) -> Column:
        return F.exists(begin, lambda p: (p >= least) & (p <= last))

    return F.exists(F.flatten(F.array(*begins)), lambda last: _all([reaches(b, last - len(x.tokens) - leaf.gap, last) for b, x in zip(begins, leaf.phrases)]))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _in_text(leaf: Node, tokens: Column, joined: Column) -> Column:
    """Whether a leaf stands in a text's tokens; words and phrases without more are looked up, only others need places."""
    p = leaf.phrases[0]
    if len(leaf.phrases) == 1 and p.tokens and not any(p.starts[:-1]) and not leaf.initial:
        if len(p.tokens) == 1 and not p.starts[0]:
            return F.array_contains(tokens, p.tokens[0])
        return F.contains(joined, F.lit(f" {' '.join(p.tokens)}{'' if p.starts[-1] else ' '}"))

    def spots(token: str, start: bool) -> Column:
        same = lambda t: F.startswith(t, F.lit(token)) if start else t == token
        return F.filter(F.transform(tokens, lambda t, i: F.when(same(t), i)), lambda i: i.isNotNull())

    return stands(leaf, spots)


def condition(query: str, columns: tuple[str, ...] = ("content",)) -> Column:
    """Whether a row's texts match the query; a query outside the grammar, or of other columns, matches nothing. Each text is made into tokens once."""
    try:
        tree = parse(query)
        of = {id(x): columns_of(x, columns) for x in tree.leaves()}
    except MatchError:
        return F.lit(False)
    tokens = F.struct(*[terms(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)])

    def over(t: Column, j: Column) -> Column:
        def leaf(x: Node) -> Column:
            out = F.lit(False)
            for i in (columns.index(c) for c in of[id(x)]):
                out = out | _in_text(x, t[f"t{i}"], j[f"j{i}"])
            return out

        return combined(tree, leaf)

    # arrays of one element bind the tokens, and the tokens joined, to names, so they are made once
    text = lambda t: F.struct(*[F.concat(F.lit(" "), F.array_join(t[f"t{i}"], " "), F.lit(" ")).alias(f"j{i}") for i in range(len(columns))])
    return F.exists(F.array(tokens), lambda t: F.exists(F.array(text(t)), lambda j: over(t, j)))


def match(chunks: DataFrame, query: str, columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """Chunks that the query matches, by their texts."""
    return chunks.where(condition(query, columns))
