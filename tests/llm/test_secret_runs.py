"""Runs are scored many at once, with the spans that one after the other has."""

import cProfile
import pstats
import random
import re
import string

from sightline.llm import secrets
from tests.llm.test_operators import labelled_formats

INNER = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_.=-]*[A-Za-z0-9])?=*")
PARTS = (re.compile(r"[A-Za-z0-9+/_=-]{6,}"), re.compile(r"[A-Za-z0-9+_-]{6,}"))


def spans_by_force(formats, run):
    asked = {(0, len(run)), m.span() if (m := INNER.search(run)) else (0, len(run))}
    score, n, a = max((formats.score(run[a:b]), b - a, a) for a, b in asked if b - a >= 6)
    if score >= formats.margin:
        return [(a, a + n)]
    for pattern in PARTS:
        if found := [m.span() for m in pattern.finditer(run) if len(m[0]) < len(run) and formats.score(m[0]) >= formats.margin]:
            return found
    return []


def made_runs(rng, n):
    hexes = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(1, 9)))
    out = ["......", "======", "-_-_-_-", "a=====", "=a.b.c==", *(hexes() for _ in range(20))]
    while len(out) < n:
        run = "".join(rng.choice((word, word, hexes, lambda: rng.choice("+/_.=-"), lambda: str(rng.randint(0, 10**6))))() + rng.choice("+/_.=-") * rng.randint(0, 2) for _ in range(rng.randint(1, 4)))
        if len(run) >= 6:
            out.append(run)
    return out


def test_spans_of_runs():
    rng = random.Random(3)
    formats = labelled_formats(lambda: "".join(rng.choices("0123456789abcdef", k=40)))
    for margin in (-20.0, 0.0, formats.margin):
        formats.margin, formats.known, formats.found = margin, set(), {}
        runs = made_runs(rng, 500)
        texts = [" é".join(runs[i : i + 50]) + " " for i in range(0, 500, 50)] + [None, ""]
        want = []
        for t in texts:
            every = [(m.start(), m[0]) for m in secrets.CANDIDATE.finditer(t or "")]
            want.append([(at + a, at + b, "auto") for at, run in every for a, b in spans_by_force(formats, run)])
        assert formats.auto_spans(texts, [[]] * len(texts)) == want and any(want)
        base = [[(0, 30, "hex")]] * len(texts)
        assert formats.auto_spans(texts, base) == [[s for s in own if s[0] >= 30] for own in want]


def test_runs_are_scored_together():
    """No Python call for each run: these took most of the scan's time."""
    rng = random.Random(4)
    runs = ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(6, 12))) + rng.choice(("", ".", "-x.y")) for _ in range(4000)]
    formats = labelled_formats(lambda: "".join(rng.choices("0123456789abcdef", k=40)))
    work = cProfile.Profile()
    work.runcall(formats.auto_spans, [" ".join(runs)], [[]])
    assert pstats.Stats(work).total_calls < 2 * len(runs)
