"""Boolean trigram queries derived from regular expressions."""

from __future__ import annotations

from itertools import product
from re import _constants as sre
from re import _parser

#: Bounds of what is tracked exactly; beyond them a part counts as "any text", which only loosens the query.
MOST_STRINGS, MOST_CLASS = 64, 4

#: A query: a tuple of clauses, all needed; a clause is a set of trigram sets, of which one must be held in full.
Clause = frozenset[frozenset[str]]


def _clause(strings: set[str]) -> list[Clause]:
    """One of the strings must be there: of each its first and its last trigram. Those between would rule out little more,
    and every trigram is one more list to build. A string that holds another one says nothing more than that."""
    strings = {s for s in strings if not any(t != s and t in s for t in strings)}
    grams = {frozenset((s[:3], s[-3:])) if len(s) > 2 else frozenset() for s in strings}
    if not grams or frozenset() in grams:
        return []
    return [frozenset(g for g in grams if not any(h < g for h in grams))]


def _class(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < MOST_CLASS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
        if len(out) > MOST_CLASS:
            return None
    return out


def _walk(parsed) -> tuple[set[str] | None, list[Clause]]:
    """The exact strings of a part (None: not tracked), and the clauses of what was given up."""
    run, clauses, whole = {""}, [], True

    def flush() -> None:
        nonlocal run, whole
        clauses.extend(_clause(run))
        run, whole = {""}, False

    for op, value in parsed:
        exact: set[str] | None = None
        inner: list[Clause] = []
        if op is sre.LITERAL:
            exact = {chr(value).lower()}
        elif op is sre.IN:
            exact = _class(value)
        elif op is sre.SUBPATTERN:
            exact, inner = _walk(value[3])
        elif op is sre.BRANCH:
            parts = [_walk(p) for p in value[1]]
            if all(p[0] is not None for p in parts):
                exact = set().union(*(p[0] for p in parts))
            elif all(len(p[1]) == 1 for p in parts):
                inner = [frozenset().union(*(p[1][0] for p in parts))]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = value
            inside, inner = _walk(body)
            if inside is not None and (least, most) == (0, 1):
                exact = inside | {""}
            elif inside is not None and least == most <= 4:
                exact = {"".join(p) for p in product(inside, repeat=least)} if len(inside) ** least <= MOST_STRINGS else None
            if least == 0:
                inner = []
        elif op is sre.AT:
            exact = {""}
        if exact is None or len(run) * len(exact) > MOST_STRINGS:
            flush()
            clauses.extend(inner if exact is None else _clause(exact))
        else:
            run = {a + b for a in run for b in exact}
    if whole:
        return run, []
    clauses.extend(_clause(run))
    return None, clauses


def query(pattern: str) -> tuple[Clause, ...]:
    """What the lower-cased text must hold for ``pattern`` to match; empty if nothing is mandatory."""
    exact, clauses = _walk(_parser.parse(pattern))
    return tuple(clauses if exact is None else _clause(exact))


def trigrams(clauses: tuple[Clause, ...]) -> set[str]:
    return {t for clause in clauses for grams in clause for t in grams}
