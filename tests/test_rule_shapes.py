"""Every rule of the catalog finds a value made from its own pattern, and not the value cut short."""

import re
from re import _constants as C
from re import _parser

import pytest

from quellspan.operators import detect
from quellspan.operators.rules import CATALOG
from tests.test_detect import FOUND

#: Rules whose checks no made-up value passes; each has a written fixture.
WRITTEN = {rule for rule, _, _ in FOUND} | {"crypto-wif-private-key", "crypto-extended-private-key"}
PREFERRED = "k7Q2m9Xr4T8vB3nZ5wL6pC1dF"


def allowed(items):
    negated = bool(items) and items[0][0] is C.NEGATE
    inside = set()
    for op, arg in items:
        if op is C.LITERAL:
            inside.add(chr(arg))
        elif op is C.RANGE:
            inside |= {chr(c) for c in range(arg[0], min(arg[1], 0x24F) + 1)}
        elif op is C.CATEGORY:
            inside |= {c for c in map(chr, range(1, 128)) if re.match({C.CATEGORY_SPACE: r"\s", C.CATEGORY_NOT_SPACE: r"\S", C.CATEGORY_WORD: r"\w", C.CATEGORY_DIGIT: r"\d"}[arg], c)}
    pool = [c for c in PREFERRED + "".join(map(chr, range(33, 127))) + " \n" if (c in inside) != negated]
    return pool or sorted(inside)


def made(pattern):
    """A text that the pattern matches: the first of alternatives, the fewest repeats, characters in turn."""
    turn = iter(range(10**6))

    def one(op, arg):
        if op is C.LITERAL:
            return chr(arg)
        if op is C.NOT_LITERAL:
            return "x" if arg != ord("x") else "y"
        if op is C.IN:
            pool = allowed(arg)
            return pool[next(turn) % len(pool)]
        if op is C.ANY:
            return "k"
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            return "".join(run(arg[2]) for _ in range(arg[0]))
        if op is C.BRANCH:
            return run(arg[1][0])
        if op is C.SUBPATTERN:
            return run(arg[3])
        return ""

    run = lambda items: "".join(one(op, arg) for op, arg in items)
    return run(_parser.parse(pattern))


CASES = [r for r in CATALOG if r.id not in WRITTEN]


@pytest.fixture(scope="module")
def found(spark):
    rows = []
    for i, r in enumerate(CASES):
        value, near = made(r.value), (f"{re.sub(r'[^a-z ]', '', r.near[0])} " if r.near else "")
        before = made(r.before.replace("(?:^|", "(?:"))
        head = "" if any(k in before + value for k in r.keywords) or not r.keywords else f"{r.keywords[0]} "
        end = next((c for c in ("\n", " ", "}", ";") if not re.fullmatch(r.value, value + c)), "-")
        rows += [(i, "whole", near + head + before + value + end), (i, "cut", near + head + before + value[:-1] + end)]
    out = {}
    for row in detect.candidate_rows(spark.createDataFrame(rows, "i int, kind string, text string"), "i", "kind").collect():
        out.setdefault((row["i"], row["kind"]), set()).add((row["rule"], row["value"]))
    return rows, out


@pytest.mark.parametrize("i", range(len(CASES)), ids=[r.id for r in CASES])
def test_a_made_value_is_found_and_its_stump_is_not(found, i):
    rows, out = found
    value = made(CASES[i].value)
    assert (CASES[i].id, value) in out.get((i, "whole"), set()), rows[2 * i]
    assert (CASES[i].id, value) not in out.get((i, "cut"), set())
    if not re.fullmatch(CASES[i].value, value[:-1]):
        assert CASES[i].id not in {rule for rule, _ in out.get((i, "cut"), set())}, rows[2 * i + 1]
