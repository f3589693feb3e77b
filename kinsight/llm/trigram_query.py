"""Boolean trigram queries derived from regular expressions (driver-side planning, no data involved)."""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

#: AND of clauses; a clause is an OR of alternatives; an alternative is an AND of trigrams. No clause: always true.
Query = list[list[frozenset[str]]]
#: More exact strings than this are not carried on.
MOST = 64


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clause(exact: set[str]) -> list[list[frozenset[str]]]:
    if not all(len(s) >= 3 for s in exact):
        return []
    found = {trigrams(s) for s in exact}
    return [sorted((x for x in found if not any(y < x for y in found)), key=sorted)]


def _times(a: set[str], b: set[str]) -> set[str]:
    return {x + y for x in a for y in b}


def _exact(items) -> set[str] | None:
    """All strings that the items match, lower-cased, if they are few."""
    out = {""}
    for kind, arg in items:
        step = _step(kind, arg)
        if step is None:
            return None
        out = _times(out, step)
        if len(out) > MOST:
            return None
    return out


def _step(kind, arg) -> set[str] | None:
    if kind is op.LITERAL:
        return {chr(arg).lower()}
    if kind is op.IN and all(k is op.LITERAL for k, _ in arg) and len(arg) <= 4:
        return {chr(c).lower() for _, c in arg}
    if kind is op.SUBPATTERN:
        return _exact(arg[-1])
    if kind is op.BRANCH:
        parts = [_exact(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, items = arg
        if high <= 3 and (one := _exact(items)) is not None:
            powers, now = [{""}], {""}
            for _ in range(high):
                now = _times(now, one)
                powers.append(now)
            return set().union(*powers[low:])
    if kind is op.AT:
        return {""}
    return None


def _query(items) -> Query:
    clauses, exact = [], {""}
    for kind, arg in items:
        step = _step(kind, arg)
        if step is not None and len(exact) * len(step) <= MOST:
            exact = _times(exact, step)
            continue
        clauses += _clause(exact)
        exact = step if step is not None and len(step) <= MOST else {""}
        if step is None:
            if kind is op.SUBPATTERN:
                clauses += _query(arg[-1])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
                first = _exact(arg[2])
                repeated = first if first is not None else {""}
                for _ in range(min(arg[0], 4) - 1):
                    repeated = _times(repeated, first or {""})
                    if len(repeated) > MOST:
                        repeated = {""}
                        break
                clauses += _clause(repeated) + (_query(arg[2]) if first is None else [])
    return clauses + _clause(exact)


def trigram_query(regex: str) -> Query:
    """A condition over lower-cased trigrams that every text with a match meets; empty: none can be derived."""
    return _query(parser.parse(regex))
