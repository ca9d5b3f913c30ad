"""Boolean trigram queries from regular expressions.

A query is a list of alternatives, each a set of trigrams that all occur in every match (letters folded to lower
case); [] means that some match needs no trigram, so only a full scan finds it. Derived from Python's parse of the
expression: literals and small choices are spelled out, whatever else may stand there ends a literal run.
"""

from __future__ import annotations

from re import _constants as c
from re import _parser as parser

#: At most so many alternatives are spelled out; beyond, a choice counts as unknown text.
MOST = 64
#: Stands for unknown text in a spelled-out match.
GAP = "\0"


def _spell(tokens) -> list[str]:
    """All ways a match may read, unknown text as GAP."""
    out = [""]
    for op, arg in tokens:
        if op is c.LITERAL:
            ways = [chr(arg).lower() if chr(arg).isascii() else GAP]
        elif op is c.IN:
            ways = _choice(arg)
        elif op is c.SUBPATTERN:
            ways = _spell(arg[3])
        elif op is c.BRANCH:
            ways = [w for branch in arg[1] for w in _spell(branch)]
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT):
            low, high, inner = arg
            once = _spell(inner)
            if high == 1:
                ways = ["", *once] if low == 0 else once
            elif low == 0:
                ways = [GAP]
            elif low == high and low <= 4:
                ways = [""]
                for _ in range(low):
                    ways = _crossed(ways, once)
            else:
                ways = _crossed(once, [GAP])
        elif op in (c.AT, c.ASSERT, c.ASSERT_NOT):
            ways = [""]
        else:
            ways = [GAP]
        out = _crossed(out, ways)
    return out


def _choice(items) -> list[str]:
    if all(op is c.LITERAL for op, _ in items) and len(items) <= 8:
        return sorted({chr(x).lower() if chr(x).isascii() else GAP for _, x in items})
    return [GAP]


def _crossed(left: list[str], right: list[str]) -> list[str]:
    if len(left) * len(right) > MOST:
        right = [GAP]
    return list(dict.fromkeys(a + b for a in left for b in right))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The alternatives of a pattern; an alternative that holds another is left out, as the other covers it."""
    ways = {frozenset(run[i : i + 3] for run in way.split(GAP) for i in range(len(run) - 2)) for way in _spell(parser.parse(pattern))}
    if frozenset() in ways:
        return []
    return sorted((w for w in ways if not any(v < w for v in ways)), key=sorted)
