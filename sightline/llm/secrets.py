"""Secret scans by grammar inference (operator 2).

Labelled credentials are the values that fixed patterns find after words such as "password". Their prefix tree is folded
into a probabilistic automaton: states are merged while their frequencies of ending and of each next symbol differ by no
more than Hoeffding's bound allows, at a risk of one in the number of values, and the merges that determinism then asks for
follow. Symbols are the first LITERAL characters themselves, so that fixed prefixes are learned, and character classes after
them, so that an automaton learns a format, not the values. Each state gives unseen symbols a small probability. Where a
value ends is judged by its length among the labelled values of its kind and alphabet: branching leaves the deep states of a
tree too few values to tell, so that ends would be lost in the merges. A length that no such value has is improbable, not
impossible.

Every candidate, a maximal run of LEAST_ASSIGN or more credential characters, is scored by its log likelihood under the best
automaton over that under plain text or an identifier. Plain text is a chain of character classes, counted over all runs of
the corpus outside the fixed patterns, less the share of those transitions that are of likely credentials;
identifiers are few, short and of any characters. No length, digit or punctuation is demanded. A run is scored whole, without the punctuation at its ends, with
dots as joints between parts, and, if it fails, part by part. The threshold lies APART above the scores of the corpus'
distinct plain runs (all but one in a hundred) as long as labelled values that the automata were not shown exceed it, and
never under LEAST_SCORE. What reaches it becomes a span of kind "auto" unless a base span overlaps it.

Automata, lengths, chain and threshold are counted by Spark over all distinct values and runs; what is collected are counts
of prefixes that one in NODES values has, of states and symbols, of lengths and of scores. Null and empty texts have no spans.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .textbatch import pieces, slices, table, words

KINDS = ("assign", "access", "hex")
#: The contract's patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Words that ASSIGN needs one of, in lower case.
HINTS = ("passw", "secret", "token", "apikey", "api_key")

#: A prefix has a state if one in NODES values has it; a walk from the first state is followed for STEPS symbols.
NODES, STEPS = 1000, 64
#: Labelled values that a task remembers to have sent (ten times as many plain runs), and steps of a score in the threshold's counts.
SEEN, FINE = 50_000, 100
LITERAL = 4
#: The least log odds of a span over plain text and identifiers, about one credential in 60,000 runs.
LEAST_SCORE = 11.0
#: How far the threshold is above the scores of plain runs.
APART = 2.0
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Characters that part a run whose whole and inner part fail, first these, then also those.
PARTED = (".", "./=")


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, by start and then kind."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(x in low for x in HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def labelled(text: str | None, spans: list[tuple[int, int, str]]) -> list[tuple[str, str]]:
    """(kind, value) of the credentials in the text's base spans."""
    return [(kind, ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]) for a, b, kind in spans]


#: Symbols of character classes: hex letters, other lower-case letters, capitals, digits, and the others themselves.
SYMBOLS = "hlUd+/_.=-"
CODE = np.full(256, -1, np.int64)
for _i, _chars in enumerate(("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", *SYMBOLS[4:])):
    CODE[list(_chars.encode())] = _i
_CLASSES = {c: SYMBOLS[CODE[c]] for c in range(128) if CODE[c] >= 0}
RUN = table(np.flatnonzero(CODE >= 0))


def symbols(value: str) -> str:
    """The value's format: LITERAL characters as they are (marked by what no value holds), and the classes of the others."""
    return value[:LITERAL].translate(_MARKED) + value[LITERAL:].translate(_CLASSES)


_MARKED = {c: c + 0x100 for c in range(128)}


@dataclass
class Automaton:
    """A deterministic probabilistic automaton: per state the visits, ends and next states by symbol."""

    visits: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    step: list[dict[str, int]] = field(default_factory=lambda: [{}])
    used: list[dict[str, int]] = field(default_factory=lambda: [{}])

    @classmethod
    def tree(cls, words: list[str]) -> Automaton:
        out = cls()
        for w in words:
            at = 0
            for c in w:
                out.visits[at] += 1
                out.used[at][c] = out.used[at].get(c, 0) + 1
                if c not in out.step[at]:
                    out.step[at][c] = len(out.visits)
                    out.visits.append(0)
                    out.ends.append(0)
                    out.step.append({})
                    out.used.append({})
                at = out.step[at][c]
            out.visits[at] += 1
            out.ends[at] += 1
        return out

    @classmethod
    def counted(cls, nodes: dict[str, dict[str, int]]) -> Automaton:
        """The tree of prefixes with the counts of their next symbols, nothing for ends; a symbol to no such prefix leads nowhere."""
        number = {p: i for i, p in enumerate(sorted(nodes, key=lambda p: (len(p), p)))}
        used = [{c: n for c, n in nodes[p].items() if c} for p in number]
        step = [{c: number[p + c] for c in own if p + c in number} for p, own in zip(number, used, strict=True)]
        return cls([sum(nodes[p].values()) for p in number], [nodes[p].get("", 0) for p in number], step, used)

    def differ(self, a: int, b: int, bound: float) -> bool:
        """Whether the two states, or states that equal paths lead to from them, have incompatible frequencies."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.visits[x], self.visits[y]
            if not n or not m:
                continue
            slack = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[x] / n - self.ends[y] / m) > slack:
                return True
            for c in {*self.used[x], *self.used[y]}:
                if abs(self.used[x].get(c, 0) / n - self.used[y].get(c, 0) / m) > slack:
                    return True
                if c in self.step[x] and c in self.step[y] and self.step[x][c] != self.step[y][c]:
                    todo.append((self.step[x][c], self.step[y][c]))
        return False

    def fold(self, a: int, b: int) -> None:
        """Merges b, the root of a tree, into a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            self.visits[x] += self.visits[y]
            self.ends[x] += self.ends[y]
            for c, n in self.used[y].items():
                self.used[x][c] = self.used[x].get(c, 0) + n
                if c not in self.step[y]:
                    continue
                if c in self.step[x]:
                    todo.append((self.step[x][c], self.step[y][c]))
                else:
                    self.step[x][c] = self.step[y][c]

    def inferred(self) -> Automaton:
        """State merging: each state on the fringe joins the first compatible kept state, or is kept itself."""
        bound = math.sqrt(0.5 * math.log(2 * max(2, self.visits[0])))
        kept = [0]
        held = {0}
        while True:
            fringe = [(s, c, t) for s in kept for c, t in self.step[s].items() if t not in held]
            if not fringe:
                break
            s, c, t = max(fringe, key=lambda x: (self.visits[x[2]], x[1], -x[2]))
            for k in kept:
                if not self.differ(k, t, bound):
                    self.step[s][c] = k
                    self.fold(k, t)
                    break
            else:
                kept.append(t)
                held.add(t)
        number = {s: i for i, s in enumerate(kept)}
        return Automaton([self.visits[s] for s in kept], [self.ends[s] for s in kept], [{c: number[t] for c, t in self.step[s].items()} for s in kept], [self.used[s] for s in kept])

    def compiled(self) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities, next states) by state and symbol: 128 literals, then the classes and any other character.

        An unseen symbol leads to the first state.
        """
        logs = np.zeros((len(self.visits), 128 + len(SYMBOLS) + 1))
        step = np.zeros(logs.shape, np.int64)
        for i, (n, nexts, used) in enumerate(zip(self.visits, self.step, self.used, strict=True)):
            whole = n + SMOOTH
            logs[i, :128], logs[i, 128:] = math.log(SMOOTH * UNSEEN_LITERAL / whole), math.log(SMOOTH * UNSEEN / whole)
            for c, k in nexts.items():
                at = ord(c) - 0x100 if ord(c) >= 0x100 else 128 + SYMBOLS.index(c)
                logs[i, at] = math.log((used[c] + SMOOTH * (UNSEEN_LITERAL if at < 128 else UNSEEN)) / whole)
                step[i, at] = k
        return logs, step


#: A state is as if it had been visited SMOOTH times more, with equal shares of the classes, or of the literals.
SMOOTH, UNSEEN, UNSEEN_LITERAL = 1.0, 1 / (len(SYMBOLS) + 1), 1 / 64
#: Alphabets, as sets of classes (the last is any other character); a value's is the first that holds all its characters.
ALPHABETS = [sum(1 << (SYMBOLS + "?").index(c) for c in x) for x in ("d", "hd", "Ud", "hl", "hld", "hlUd", "hlUd-_", "hlUd+/=", "hlUd+/_.=-?")]
#: How many characters each has.
_SIZES = np.log([10, 16, 36, 26, 36, 62, 64, 65, 70])
#: And, after the first LITERAL ones, how many classes, weighed by how many characters of the alphabet each has.
_KINDS_OF = np.array([0.0, *[-sum(p * math.log(p) for p in (np.array(x) / sum(x))) for x in ((6, 10), (26, 10), (6, 20), (6, 20, 10), (6, 20, 26, 10), (6, 20, 26, 10, 1, 1), (6, 20, 26, 10, 1, 1, 1), (6, 20, 26, 10, 1, 1, 1, 1, 1, 1))]])
#: The share of credentials whose length no labelled value of their alphabet has, dealt to that many lengths.
OTHER_LENGTHS, LENGTHS = 0.0005, 64
#: Runs that are identifiers (revisions, part numbers, file names), as a logarithm of their share; any characters of an
#: alphabet, and the longer, the fewer, as the tail of a normal distribution of this width has it.
IDENTIFIERS, IDENTIFIER = math.log(5e-8), 3.0


def flat_codes(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, with 127 for those beyond ASCII, where each value starts, its length)."""
    raw = np.frombuffer("".join(values).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, values), np.int64, len(values))
    return np.minimum(raw, 127).astype(np.int64), np.cumsum(size) - size, size


def alphabets(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of each value's alphabet; values are not empty."""
    mask = np.bitwise_or.reduceat(1 << np.where(CODE[chars] < 0, len(SYMBOLS), CODE[chars]), starts)
    fits = np.stack([(mask & ~a) == 0 for a in ALPHABETS])
    return fits.argmax(0)


def log_likelihoods(tables: tuple[np.ndarray, np.ndarray], chars: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The log likelihood of each value's symbols under a compiled automaton: all values a symbol on at once."""
    return read_by(tables, symbol_numbers(chars, starts, size), starts, size)


def symbol_numbers(chars: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The columns of a compiled automaton that the characters are read in."""
    place = np.arange(len(chars)) - np.repeat(starts, size)
    return np.where(place < LITERAL, chars, 128 + np.where(CODE[chars] < 0, len(SYMBOLS), CODE[chars]))


def read_by(tables: tuple[np.ndarray, np.ndarray], symbol: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    logs, step = tables
    order = np.argsort(-size, kind="stable")
    first, left = starts[order], -size[order]
    state, total = np.zeros(len(size), np.int64), np.zeros(len(size))
    for i in range(-int(left[0])):
        n = int(np.searchsorted(left, -i, "left"))  # as many are longer than i
        at = symbol[first[:n] + i]
        total[:n] += logs[state[:n], at]
        state[:n] = step[state[:n], at]
    out = np.empty(len(size))
    out[order] = total
    return out


def stretches(ok: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the value, start, end) of the longest stretches of ok characters within values that start there."""
    edge = np.zeros(len(ok) + 1, bool)
    edge[starts] = edge[-1] = True
    first = np.flatnonzero(ok & (edge[:-1] | ~np.concatenate([[False], ok[:-1]])))
    last = np.flatnonzero(ok & (edge[1:] | ~np.concatenate([ok[1:], [False]])))
    return np.searchsorted(starts, first, "right") - 1, first, last + 1


def taken(chars: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters from first to before last, as flat_codes gives those of values."""
    size = last - first
    ends = np.cumsum(size)
    return chars[np.arange(size.sum()) + np.repeat(first - ends + size, size)], ends - size, size


def seen_lengths(values: list[str]) -> dict[tuple[int, int], int]:
    """{(alphabet, length): labelled values}, and under length 0 all of an alphabet."""
    out: dict[tuple[int, int], int] = defaultdict(int)
    values = [v for v in values if v]
    if values:
        chars, starts, size = flat_codes(values)
        for a, n in zip(alphabets(chars, starts).tolist(), size.tolist(), strict=True):
            out[a, n] += 1
            out[a, 0] += 1
    return dict(out)


#: What plain text is held to be before any is seen, as often as PRIOR symbols in each row; rows are the start and classes.
PRIOR = 500.0
_ROWS = ("start", *SYMBOLS)
_BEFORE = {
    "start": (0.20, 0.60, 0.12, 0.06, 0.02, 0.0), "h": (0.23, 0.66, 0.005, 0.01, 0.035, 0.06), "l": (0.23, 0.66, 0.005, 0.01, 0.035, 0.06),
    "U": (0.09, 0.27, 0.55, 0.01, 0.02, 0.06), "d": (0.01, 0.02, 0.02, 0.75, 0.10, 0.10), "-": (0.13, 0.37, 0.10, 0.25, 0.09, 0.06),
}
#: Letters and digits of a class, for the likelihood of literals.
_MEMBERS = np.array([6, 20, 26, 10, 1, 1, 1, 1, 1, 1])
#: The log likelihood of a dot between a credential's parts.
DOT = math.log(0.006)
#: Characters of runs whose scores a worker keeps, and of texts whose runs are scored at once (or those of one longer text).
SCORES, CHARACTERS = 1 << 21, 1 << 19
_ALNUM = table([*range(48, 58), *range(65, 91), *range(97, 123)])


def plain_chain(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the next class or the end, by start and class, from counts of the same shape."""
    n = len(SYMBOLS)
    out = np.zeros((n + 1, n + 1))
    for i, row in enumerate(_ROWS):
        h, low, up, digit, other, end = _BEFORE[row if row in _BEFORE else "-"]
        out[i] = [h, low, up, digit, *[other / 6] * 6, end]
    total = counts + PRIOR * out + 1e-3
    return np.log(total / total.sum(1, keepdims=True))


@dataclass
class Formats:
    automata: dict[str, Automaton]
    lengths: dict[str, dict[tuple[int, int], int]] = field(default_factory=dict)
    plain: np.ndarray = field(default_factory=lambda: np.zeros((len(SYMBOLS) + 1, len(SYMBOLS) + 1)))
    margin: float = LEAST_SCORE
    known: set[str] = field(default_factory=set, repr=False, compare=False)
    found: dict[str, list[tuple[int, int]]] = field(default_factory=dict, repr=False, compare=False)
    kept: int = field(default=0, repr=False, compare=False)

    def __post_init__(self):
        self.tables = {k: a.compiled() for k, a in self.automata.items()}
        self.chain = plain_chain(self.plain)
        self.ends = {}
        for kind in self.tables:
            seen = self.lengths.get(kind, {})
            keys = sorted(seen)
            share = [math.log((1 - OTHER_LENGTHS) * seen[k] / seen[k[0], 0] + OTHER_LENGTHS / LENGTHS) for k in keys]
            self.ends[kind] = np.array([a << 40 | n for a, n in keys] + [1 << 62], np.int64), np.array([*share, 0.0])

    def plain_likelihoods(self, chars: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The log likelihood of each value as plain text or an identifier; of literals, each of a class is as likely."""
        code = np.where(CODE[chars] < 0, SYMBOLS.index("-"), CODE[chars])
        place = np.arange(len(chars)) - np.repeat(starts, size)
        before = np.where(place == 0, 0, np.concatenate([[0], code[:-1] + 1]))
        steps = self.chain[before, code] - np.where((place < LITERAL) & (CODE[chars] >= 0), np.log(_MEMBERS)[code], 0.0)
        text = np.add.reduceat(steps, starts) + self.chain[code[starts + size - 1] + 1, -1]
        spelt = np.where(place < LITERAL, np.repeat(_SIZES[alphabet := alphabets(chars, starts)], size), np.repeat(_KINDS_OF[alphabet], size))
        identifier = IDENTIFIERS + np.add.reduceat(-spelt, starts) - 0.5 * (size / IDENTIFIER) ** 2 - math.log(IDENTIFIER)
        return np.logaddexp(text, identifier)

    def format_likelihoods(self, chars: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The log likelihood of each value's format under the best automaton, its length included."""
        best = np.full(len(size), -np.inf)
        symbol = symbol_numbers(chars, starts, size)
        key = alphabets(chars, starts) << 40 | size
        for kind, tables in self.tables.items():
            keys, logs = self.ends[kind]
            at = np.searchsorted(keys, key)
            ends = np.where(keys[at] == key, logs[at], math.log(OTHER_LENGTHS / LENGTHS))
            best = np.maximum(best, read_by(tables, symbol, starts, size) + ends)
        return best

    def scores(self, values: list[str]) -> np.ndarray:
        """The log odds of the best automaton over plain text for each value, none empty; minus infinity without automata."""
        if not self.automata or not values:
            return np.full(len(values), -math.inf)
        return self.flat_scores(*flat_codes(values))

    def flat_scores(self, chars: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same of values as flat_codes gives them."""
        if not len(size):
            return np.zeros(0)
        best = self.format_likelihoods(chars, starts, size)
        dotted = np.flatnonzero(np.logical_or.reduceat(chars == ord("."), starts))
        if len(dotted):  # or of a value's parts together
            own, at, whole = taken(chars, starts[dotted], (starts + size)[dotted])
            value, a, b = stretches(own != ord("."), at)
            joined = (whole - np.bincount(value, b - a, len(dotted))) * DOT
            if len(value):
                joined += np.bincount(value, self.format_likelihoods(*taken(own, a, b)), len(dotted))
            best[dotted] = np.maximum(best[dotted], joined)
        return best - self.plain_likelihoods(chars, starts, size)

    def score(self, value: str) -> float:
        return float(self.scores([value])[0])

    def learn(self, runs: Iterable[str]) -> None:
        """Finds what is a credential in runs that are not known: all of a run, its inner part, or else parts of it."""
        new = list(set(runs).difference(self.known))
        if not new:
            return
        self.known.update(new)
        chars, starts, size = flat_codes(new)
        self.kept += len(chars)
        ends = starts + size
        # from the first letter or digit to the last and the "=" that follow
        alnum, place = _ALNUM[chars], np.arange(len(chars))
        first = np.minimum.reduceat(np.where(alnum, place, len(chars)), starts)
        last = np.maximum.reduceat(np.where(alnum, place, -1), starts) + 1
        other = np.where((chars != ord("=")) & (place >= np.repeat(last, size)), place, len(chars))
        last = np.minimum(np.minimum.reduceat(other, starts), ends)
        inner = np.flatnonzero((first < ends) & (last - first >= LEAST_ASSIGN) & (last - first < size))
        score = self.flat_scores(chars, starts, size)
        inner_score = self.flat_scores(*taken(chars, first[inner], last[inner]))
        span_first, span_last = starts.copy(), ends.copy()
        better = inner[inner_score > score[inner]]
        span_first[better], span_last[better] = first[better], last[better]
        score[inner] = np.maximum(score[inner], inner_score)
        some = score >= self.margin
        values, spans = [np.flatnonzero(some)], [(span_first[some], span_last[some])]
        for parting in PARTED:
            value, a, b = stretches(~np.isin(chars, list(parting.encode())), starts)
            asked = ~some[value] & (b - a >= LEAST_ASSIGN) & (b - a < size[value])
            value, a, b = value[asked], a[asked], b[asked]
            high = self.flat_scores(*taken(chars, a, b)) >= self.margin
            values.append(value[high])
            spans.append((a[high], b[high]))
            some[value[high]] = True
        for value, (a, b) in zip(values, spans, strict=True):
            for i, x, y in zip(value.tolist(), (a - starts[value]).tolist(), (b - starts[value]).tolist(), strict=True):
                self.found.setdefault(new[i], []).append((x, y))

    def auto_spans(self, texts: list[str | None], base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
        """Spans of each text that no base span of it overlaps."""
        if not self.automata:
            return [[] for _ in texts]
        runs = [CANDIDATE.findall(t) if t else [] for t in texts]
        if self.kept > SCORES:
            self.known, self.found, self.kept = set(), {}, 0
        self.learn(chain.from_iterable(runs))
        out: list[list[tuple[int, int, str]]] = []
        for t, own, spans in zip(texts, runs, base, strict=True):
            if self.found.keys().isdisjoint(own):
                out.append([])
                continue
            every = ((x + m.start(), y + m.start()) for m in CANDIDATE.finditer(t) for x, y in self.found.get(m[0], ()))
            out.append([(x, y, "auto") for x, y in every if not any(p < y and x < q for p, q, _ in spans)])
        return out


def without_base(text: str | None, spans: list[tuple[int, int, str]]) -> str:
    """The text with blanks for its base spans."""
    parts, at = [], 0
    for a, b, _ in spans:
        if b > at:
            parts += [text[at : max(a, at)], " "]
            at = b
    return "".join([*parts, text[at:]]) if parts else text or ""


def plain_counts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often a class, or the end, follows the start or a class in the runs."""
    n = len(SYMBOLS)
    size = ends - starts
    if not len(size):
        return np.zeros((n + 1, n + 1))
    at = np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)
    code = CODE[buf[at]]
    first = np.zeros(len(code), bool)
    first[np.cumsum(size) - size] = True
    before = np.where(first, 0, np.concatenate([[0], code[:-1] + 1]))
    out = np.bincount(before * (n + 1) + code, minlength=(n + 1) ** 2).reshape(n + 1, n + 1)
    out[:, n] += np.bincount(code[np.cumsum(size) - 1] + 1, minlength=n + 1)
    return out.astype(np.float64)


def sample_counts(values: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(values).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in values]) if values else np.zeros(0, np.int64)
    return plain_counts(raw, ends - np.diff(ends, prepend=0), ends)


def parts_of(word: str) -> Iterator[tuple[str, str]]:
    """(prefix, next symbol) of a word's first STEPS symbols, and (word, nothing) if it ends there."""
    for i in range(min(len(word), STEPS)):
        yield word[:i], word[i]
    if len(word) <= STEPS:
        yield word, ""


def rest_of(word: str, held: set[str]) -> str | None:
    """What follows the first symbol after which the word is at no held prefix; none if it ends before."""
    for i in range(1, len(word) + 1):
        if word[:i] not in held:
            return word[i:]
    return None


def walked(step: np.ndarray, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(how often each symbol is read in each state, how often values end there)."""
    chars, starts, size = flat_codes(values)
    place = np.arange(len(chars)) - np.repeat(starts, size)
    symbol = np.where(place < LITERAL, chars, 128 + np.where(CODE[chars] < 0, len(SYMBOLS), CODE[chars]))
    order = np.argsort(-size, kind="stable")
    first, left = starts[order], -size[order]
    state, used = np.zeros(len(size), np.int64), np.zeros(step.size, np.int64)
    for i in range(-int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(left, -i, "left"))
        at = state[:n] * step.shape[1] + symbol[first[:n] + i]
        used += np.bincount(at, minlength=step.size)
        state[:n] = step.flat[at]
    return used, np.bincount(state, minlength=len(step))


def summed(rows: list[tuple], names: str, strings: int) -> Iterator[pa.RecordBatch]:
    """A batch of the rows, whose first columns are strings and the others long, if there are any."""
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < strings else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=names.split())


def credentials_and_runs(docs: DataFrame, text: str) -> tuple[DataFrame, np.ndarray]:
    """((kind, value, held) of all distinct labelled values and, as kind plain, all distinct plain runs; the chain's counts)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, plain = set(), np.zeros(0, np.uint64)
        counts = np.zeros((len(SYMBOLS) + 1, len(SYMBOLS) + 1))
        for part in (x for batch in batches for x in slices(batch.column(0), CHARACTERS)):
            clean, rows = [], []
            for t in part.to_pylist():
                base = base_spans(t)
                for own in labelled(t, base):
                    if own not in values:
                        values.add(own)
                        rows.append((*own, 0, 0))
                clean.append(without_base(t, base))
            for _, _, buf, offs in pieces(pa.array(clean, pa.string())):
                starts, ends, hashes, _ = words(buf, offs, RUN, lower=False)
                long = ends - starts >= LEAST_ASSIGN
                starts, ends, hashes = starts[long], ends[long], hashes[long]
                counts += plain_counts(buf, starts, ends)
                hashes, first = np.unique(hashes, return_index=True)
                new = ~np.isin(hashes, plain, assume_unique=True)
                raw = buf.tobytes()
                rows += [("plain", raw[starts[i] : ends[i]].decode(), 0, 0) for i in first[new].tolist()]
                plain = np.concatenate([plain, hashes[new]])
            yield from summed(rows, "kind value h n", 2)
            if len(values) > SEEN or len(plain) > 10 * SEEN:  # what was sent may be sent again: the tables are made distinct
                values, plain = set(), np.zeros(0, np.uint64)
        yield from summed([("pair", "", int(i), int(counts.flat[i])) for i in np.flatnonzero(counts)], "kind value h n", 2)

    got = written(docs.select(F.col(text).alias("text")).mapInArrow(gather, "kind string, value string, h long, n long"), "runs")
    counts = np.zeros((len(SYMBOLS) + 1, len(SYMBOLS) + 1))
    for r in got.where("kind = 'pair'").groupBy("h").agg(F.sum("n").alias("n")).collect():  # a row for each pair of classes
        counts.flat[r["h"]] = r["n"]
    every = got.where("kind != 'pair'").select("kind", "value").distinct()
    return written(every.withColumn("held", F.crc32("value") % 5 == 0), "formats"), counts


def automata_of(values: DataFrame) -> list[tuple[dict[str, Automaton], dict[str, dict[tuple[int, int], int]]]]:
    """(automata, lengths) by kind, of the values that are not held out and of all.

    Prefixes are counted over all values. Those of fewer values than Hoeffding's bound can tell from any other state, or than
    one in NODES, would join the first state: what follows them is counted from there. Then all values walk through the
    merged automata, and what they do is the frequencies.
    """
    sizes = {r["kind"]: r["n"] for r in values.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [({}, {}), ({}, {})]
    few = {k: max(0.5 * math.log(2 * max(2, n)), n / NODES) for k, n in sizes.items()}
    enough = F.greatest(*[F.when(F.col("kind") == k, F.col("n") >= x).otherwise(False) for k, x in few.items()], F.lit(False))

    def counted(held: list[dict[str, set[str]]]) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0, 0])
                for kind, value, apart in zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "held")), strict=True):
                    word = symbols(value)
                    for own in held:
                        word = word if word is None else rest_of(word, own[kind])
                    for part in () if word is None else parts_of(word):
                        own = out[kind, *part]
                        own[0] += 1
                        own[1] += not apart
                yield from summed([(*k, *n) for k, n in out.items()], "kind prefix symbol n m", 3)

        return values.mapInArrow(count, "kind string, prefix string, symbol string, n long, m long")

    both, held = None, []
    for _ in range(LITERAL + 1):  # each goes a symbol on at least, so that the last begins with classes
        now = written(counted(held), "prefixes")
        if now.isEmpty():
            break
        both = now if both is None else both.union(now)
        held.append({k: set() for k in sizes})
        for r in both.groupBy("kind", "prefix").agg(F.sum("n").alias("n")).where(enough).collect():  # NODES of a length and walk at most
            held[-1][r["kind"]].add(r["prefix"])
    both = both.groupBy("kind", "prefix", "symbol").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    nodes = both.groupBy("kind", "prefix").agg(F.sum("n").alias("n"), F.collect_list(F.struct("symbol", "n", "m")).alias("of")).where(enough).collect()
    out = []
    for part in ("m", "n"):
        trees: dict[str, dict[str, dict[str, int]]] = defaultdict(dict)
        for r in nodes:
            if own := {x["symbol"]: x[part] for x in sorted(r["of"]) if x[part]}:
                trees[r["kind"]][r["prefix"]] = own
        out.append({k: Automaton.counted(trees[k]).inferred() for k in KINDS if k in trees})
    return frequencies(values, *out)


def frequencies(values: DataFrame, shown: dict[str, Automaton], whole: dict[str, Automaton]) -> list[tuple[dict[str, Automaton], dict[str, dict[tuple[int, int], int]]]]:
    """The automata of shown and all values with their frequencies over these, and the lengths."""
    steps = [{k: a.compiled()[1] for k, a in own.items()} for own in (shown, whole)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple, int] = defaultdict(int)
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "held")), strict=True))
            for part in (0, 1):
                for kind, step in steps[part].items():
                    own = [v for k, v, held in rows if k == kind and (part or not held)]
                    used, ends = walked(step, own)
                    for what, x in (("used", used), ("end", ends)):
                        for i in np.flatnonzero(x).tolist():
                            out[kind, what, part, i] += int(x[i])
                    for (alphabet, n), k in seen_lengths(own).items():
                        out[kind, "length", part, alphabet << 40 | n] += k
            yield from summed([(*k, n) for k, n in out.items()], "kind what part i n", 2)

    got = values.mapInArrow(walk, "kind string, what string, part long, i long, n long").groupBy("kind", "what", "part", "i").agg(F.sum("n").alias("n"))
    out: list[tuple[dict, dict]] = [({}, {}), ({}, {})]
    for part in (0, 1):
        for kind, step in steps[part].items():
            n = len(step)
            out[part][0][kind] = Automaton([0] * n, [0] * n, [{} for _ in range(n)], [{} for _ in range(n)])
            out[part][1][kind] = {}
    for r in got.collect():  # rows of states and symbols, and of lengths
        automaton, lengths = out[r["part"]][0][r["kind"]], out[r["part"]][1][r["kind"]]
        if r["what"] == "length":
            lengths[r["i"] >> 40, r["i"] & ((1 << 40) - 1)] = r["n"]
            continue
        step = steps[r["part"]][r["kind"]]
        state, symbol = divmod(r["i"], step.shape[1]) if r["what"] == "used" else (r["i"], None)
        automaton.visits[state] += r["n"]
        if symbol is None:
            automaton.ends[state] += r["n"]
        elif symbol < 128 + len(SYMBOLS):
            c = chr(symbol + 0x100) if symbol < 128 else SYMBOLS[symbol - 128]
            automaton.used[state][c], automaton.step[state][c] = r["n"], int(step[state, symbol])
    return out


def likely_shares(runs: DataFrame, model: Formats) -> np.ndarray:
    """The share, among distinct plain runs that have each transition, of transitions in runs that are no likely credentials."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            some = sample_counts([x for x, y in zip(own, model.scores(own).tolist(), strict=True) if y < LEAST_SCORE]).ravel()
            yield from summed([(int(i), int(n), int(some[i])) for i, n in enumerate(sample_counts(own).ravel()) if n], "i n m", 0)

    out = np.ones((len(SYMBOLS) + 1, len(SYMBOLS) + 1))
    for r in runs.mapInArrow(count, "i long, n long, m long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).collect():
        out.flat[r["i"]] = r["m"] / r["n"]
    return out


def score_counts(values: DataFrame, model: Formats) -> list[tuple[int, int]]:
    """(score in steps of 1 / FINE, values) in ascending order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(np.clip(model.scores(batch.column(0).to_pylist()), -1000, 1000) * FINE).astype(np.int64)
            yield from summed([(int(i), int(n)) for i, n in zip(*np.unique(x, return_counts=True), strict=True)], "i n", 0)

    return sorted((r["i"], r["n"]) for r in values.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect())


def at_place(counts: list[tuple[int, int]], place: int) -> int:
    for x, n in counts:
        place -= n
        if place < 0:
            return x
    return counts[-1][0]


def learn_formats(docs: DataFrame, text: str = "text") -> Formats:
    """Automata by kind, from all credentials, the chain of plain text, and the threshold between them, over all runs.

    Without labelled values there are no automata, so nothing but base spans is ever found. A fifth of the values, by
    hash, is held out to place the threshold, and then learned from too.
    """
    every, counts = credentials_and_runs(docs, text)
    values, runs = every.where("kind != 'plain'"), every.where("kind = 'plain'").select("value")
    shown, whole = automata_of(values)
    chain, margin = np.zeros_like(counts), LEAST_SCORE
    if shown[0]:
        for _ in range(2):  # from the prior on, transitions count by the share of plain runs among those that have them
            chain = counts * likely_shares(runs, Formats(*shown, chain))
        counts, model = chain, Formats(*shown, chain)
        plain = score_counts(runs, model)
        held = score_counts(values.where("held").select("value"), model)
        if plain:
            # beyond all plain runs but one in a hundred, which may be credentials themselves, but below most held-out values
            high = at_place(plain[::-1], sum(n for _, n in plain) // 100) + 1
            low = at_place(held, sum(n for _, n in held) // 20) / FINE if held else math.inf
            margin = max(margin, min(high / FINE + APART, low))
    return Formats(*whole, counts, margin)


def fitted_formats(values: dict[str, list[str]], counts: np.ndarray) -> Formats:
    """The same from lists of values by kind that fit in memory, whose prefix trees are whole."""
    take = lambda shown: {k: own for k in KINDS if (own := [x for i, x in enumerate(values[k]) if shown(i)])}
    learn = lambda own: ({k: Automaton.tree([symbols(x) for x in v]).inferred() for k, v in own.items()}, {k: seen_lengths(v) for k, v in own.items()})
    shown = learn(take(lambda i: i % 5))
    sample, chain = values["plain"], np.zeros_like(counts)
    every = sample_counts(sample)
    for _ in range(2 if shown[0] else 0):  # from the prior on, transitions count by the share of plain runs among those that have them
        scores = Formats(*shown, chain).scores(sample)
        some = sample_counts([x for x, y in zip(sample, scores.tolist(), strict=True) if y < LEAST_SCORE])
        chain = counts * np.where(every > 0, some / np.maximum(every, 1), 1.0)
    counts = chain if shown[0] else counts
    model = Formats(*shown, counts)
    held = sorted(model.scores([x for k in KINDS for x in values[k][::5]]).tolist())
    margin = LEAST_SCORE
    if shown[0] and sample:
        # beyond all plain runs but one in a hundred, which may be credentials themselves, but below most held-out values
        plain = np.sort(model.scores(sample))[::-1]
        margin = max(margin, min(float(plain[len(plain) // 100]) + APART, held[len(held) // 20] if held else math.inf))
    return Formats(*learn(take(lambda i: True)), counts, margin)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))


def find_secrets(docs: DataFrame, formats: Formats, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with an array of (kind, start, end, score) in code points, ordered by start and then kind."""
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    @F.arrow_udf(SPAN)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rank = {k: i for i, k in enumerate((*KINDS, "auto"))}
        for texts in batches:
            done = [pa.array([], arrow)]
            for part in slices(texts, CHARACTERS):
                listed = part.to_pylist()
                base = [base_spans(t) for t in listed]
                every = [sorted(own + auto, key=lambda x: (x[0], rank[x[2]])) for own, auto in zip(base, formats.auto_spans(listed, base), strict=True)]
                score = iter(np.clip(formats.scores([t[a:b] for t, own in zip(listed, every, strict=True) for a, b, _ in own]), -99.0, 99.0).tolist())
                done.append(pa.array([[{"kind": k, "start": a, "end": b, "score": next(score)} for a, b, k in own] for own in every], arrow))
            yield pa.concat_arrays(done)

    return docs.withColumn(out, scan(F.col(text)))


def redact(docs: DataFrame, formats: Formats, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of every kind replaced by mark; overlapping spans become one. Null stays null."""

    @F.arrow_udf(T.StringType())
    def clean(texts: pa.Array) -> pa.Array:
        done = [pa.array([], pa.string())]
        for part in slices(texts, CHARACTERS):
            out, listed = [], part.to_pylist()
            base = [base_spans(t) for t in listed]
            for t, own, auto in zip(listed, base, formats.auto_spans(listed, base), strict=True):
                spans = sorted(own + auto)
                parts, at = [], 0
                for a, b, _ in spans:
                    if a >= at:
                        parts += [t[at:a], mark]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]) if spans else t)
            done.append(pa.array(out, pa.string()))
        return pa.concat_arrays(done)

    return docs.withColumn(text, clean(F.col(text)))
