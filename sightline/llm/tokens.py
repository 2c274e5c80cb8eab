"""Byte-level BPE: encoding by batched merge rounds in numpy, decoding by table lookups (operator 6).

Texts are cut at spaces between non-space characters, where no token can span, so that each distinct piece is encoded
once in a worker. New pieces are split into words by the tokenizer's pattern, and the words' symbols stand in one flat
array. In each round every word's pair of lowest rank is found by binary search over the sorted pair keys, and all its
places are merged; finished words leave the array. A word of LONG bytes or more has rounds of its own: they take the places of the
next rank from a queue and look at merged places and their neighbours only, so that its rounds do not each read all of it.

Null is the empty text and has no ids. The strings of added tokens become their ids, as in the tokenizers library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbatch import slices

#: The published split pattern of this family of byte-level vocabularies. White space is written out, as
#: libraries differ on U+001C to U+001F.
_SPACE = r"\t\n\x0B\x0C\r\x20\x85\xA0  -     　"
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?\p{{L}}+|\x20?\p{{N}}+|\x20?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: White space other than spaces and line feeds.
_RARE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
NONE = np.int64(1) << 40
#: A lone surrogate, which no text can hold.
FIRST = "\ud800"
#: A worker forgets rare pieces beyond this count; they take some 200 bytes each.
PIECES = 300_000
#: Bytes from which on a word has its own rounds.
LONG = 1024


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next character from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in printable else next(spare)) for b in range(256)}


class BytePairs:
    """The vocabulary file's merges and bytes as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbol = byte_symbols()
        back = {s: b for b, s in symbol.items()}
        self.base = np.array([vocab[symbol[b]] for b in range(256)], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.width = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_split = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        names: list[bytes] = [b""] * self.width
        for name, i in vocab.items():
            names[i] = bytes(back[c] for c in name)
        for name, i in self.added.items():
            names[i] = name.encode()
        self.lengths = np.fromiter(map(len, names), np.int64, self.width)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.blob = np.frombuffer(b"".join(names), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE: a binary search over the sorted keys."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word."""
        symbols = self.base[np.frombuffer(word, np.uint8)]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n is the end
        rank = np.append(self.rank(symbols[:-1], symbols[1:]), [NONE, NONE])
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            own = rank[at]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            for r, part in zip(own[first].tolist(), np.split(at, first[1:]), strict=True):
                if r in places:
                    places[r].append(part)
                else:
                    places[r] = [part]
                    heappush(ranks, r)

        if n > 1:
            put(np.arange(n - 1))
        while ranks:
            r = heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            run = np.concatenate([[True], after[at[:-1]] != at[1:]])  # in a run of equal symbols each second pair is merged
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            gone = after[at]
            symbols[at] = self.results[r]
            alive[gone] = False
            after[at] = after[gone]
            rank[gone] = NONE
            follow = after[at]
            inner = follow < n
            before[follow[inner]] = at[inner]
            near = np.unique(np.concatenate([at, before[at]]))
            near = near[near >= 0]
            right = after[near]
            pair = np.where(right < n, self.rank(symbols[near], symbols[np.minimum(right, n - 1)]), NONE)
            rank[near] = pair
            put(near)
        return symbols[alive]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of each word's ids)."""
        long = [i for i, w in enumerate(words) if len(w) >= LONG]
        if not long:
            return self.merge_rounds(words)
        apart = set(long)
        short, sizes = self.merge_rounds([w for i, w in enumerate(words) if i not in apart])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        parts, counts, k = [], [], 0
        for i, w in enumerate(words):
            parts.append(self.merge_long(w) if i in apart else short[ends[k] : ends[k + 1]])
            counts.append(len(parts[-1]))
            k += i not in apart
        return np.concatenate(parts), np.array(counts, np.int64)

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of short words, in common rounds."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.base[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_owner, done_ids, done_at = [], [], []
        place = np.arange(len(symbols))
        while len(symbols):
            rank = np.full(len(symbols), NONE, np.int64)
            if len(symbols) > 1:
                rank[:-1] = np.where(owner[:-1] == owner[1:], self.rank(symbols[:-1], symbols[1:]), NONE)
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            live = np.repeat(least < NONE, size)
            if not live.all():
                stay = ~live
                done_owner.append(owner[stay])
                done_ids.append(symbols[stay])
                done_at.append(place[stay])
                symbols, owner, place, rank, least = symbols[live], owner[live], place[live], rank[live], np.repeat(least, size)[live]
            else:
                least = np.repeat(least, size)
            if not len(symbols):
                break
            hit = np.flatnonzero(rank == least)
            run = np.concatenate([[True], np.diff(hit) > 1])  # in a run of equal symbols each second pair is merged
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            symbols[hit] = self.results[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, owner, place = symbols[keep], owner[keep], place[keep]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, at, own = (np.concatenate(x) for x in (done_ids, done_at, done_owner))
        return ids[np.argsort(at, kind="stable")], np.bincount(own, minlength=len(words))

    def encode_pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of each piece's ids)."""
        found = [WORD.findall(x) for x in new]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        ids, sizes = self.merge([w.encode() for w in distinct])
        at = np.fromiter(map(distinct.__getitem__, chain.from_iterable(found)), np.int64)
        per = np.fromiter(map(len, found), np.int64, len(found))
        flat, counts = gathered(ids, np.concatenate([[0], np.cumsum(sizes)]), at)
        ends = np.concatenate([[0], np.cumsum(per)])
        total = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(total[ends])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[str]:
        """The text of each row of ids."""
        data, sizes = gathered(self.blob, self.offsets, ids)
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        raw = data.tobytes()
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield raw[a:b].decode("utf-8", "replace")


def gathered(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of values[offsets[i]:offsets[i + 1]] for i in at, and the length of each."""
    starts = offsets[at]
    sizes = offsets[at + 1] - starts
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0], sizes
    index = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
    return values[index], sizes


class Cutter:
    """Encodes texts by their distinct pieces, with encode_pieces for what it has not met yet."""

    def __init__(self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], added: dict[str, int], end: int | None = None, most: int = PIECES):
        self.encode_pieces, self.added, self.end, self.most = encode_pieces, added, end, most
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.index: dict[str, int] = {}
        self.ids, self.ends, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)
        if end is not None:  # a piece that no text holds
            self.put([FIRST * 2], np.array([end], np.int32), np.ones(1, np.int64))

    def put(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])

    def forget(self) -> None:
        """Keeps the pieces that came more than once since the last time."""
        keep = np.flatnonzero((self.uses > 1) | (np.arange(len(self.uses)) < (self.end is not None)))
        if len(keep) > self.most // 2:
            keep = keep[np.argsort(-self.uses[keep], kind="stable")[: self.most // 2]]
            keep.sort()
            keep = np.union1d(keep, [0]) if self.end is not None else keep
        names = list(self.index)
        ids, sizes = gathered(self.ids, self.ends, keep)
        self.index = {}
        self.ids, self.ends, self.uses = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.put([names[i] for i in keep.tolist()], ids, sizes)

    def cut(self, text: str) -> list[str]:
        if self.split is not None and any(x in text for x in self.added):
            return [y for x in self.split.split(text) if x for y in ([x] if x in self.added else self.cut_plain(x))]
        return self.cut_plain(text)

    @staticmethod
    def cut_plain(text: str) -> list[str]:
        """Each piece but the first has lost its leading space, which FIRST before the first marks as not there."""
        safe = text[0] != " " and text[-1] != " " and "  " not in text and " \n" not in text and "\n " not in text and not _RARE.search(text)
        out = text.split(" ") if safe else _CUT.split(text)
        out[0] = FIRST + out[0]
        return out

    def learn(self, new: list[str]) -> None:
        special = [x for x in new if x in self.added]
        plain = [x for x in new if x not in self.added] if special else new
        ids, sizes = self.encode_pieces([x[1:] if x[0:1] == FIRST else " " + x for x in plain])
        self.put([*plain, *special], np.concatenate([ids.astype(np.int32), np.array([self.added[x] for x in special], np.int32)]), np.concatenate([sizes, np.ones(len(special), np.int64)]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, offsets of each text's ids); each text's ids end with end if there is one."""
        tail = [] if self.end is None else [FIRST * 2]
        found = [self.cut(x) + tail if x else tail for x in texts]
        every = list(chain.from_iterable(found))
        if len(self.index) > self.most:
            self.forget()
        at = np.fromiter(map(self.index.get, every, repeat(-1)), np.int64, len(every))
        if len(missing := np.flatnonzero(at < 0)):
            names = [every[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(names)))
            at[missing] = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        self.uses += np.bincount(at, minlength=len(self.uses)).astype(np.int32)
        ids, counts = gathered(self.ids, self.ends, at)
        per = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        return ids, np.concatenate([[0], np.cumsum(counts)])[per]


@lru_cache(maxsize=2)
def loaded(path: str) -> tuple[BytePairs, Cutter]:
    pairs = BytePairs(path)
    return pairs, Cutter(pairs.encode_pieces, pairs.added)


def text_runs(texts: pa.Array, most: int = 1 << 19) -> Iterator[list[str | None]]:
    """Runs of texts with that many bytes at most, or one longer text; no more of a batch are Python strings at once."""
    return (part.to_pylist() for part in slices(texts, most))


def encode_decode(path: str):
    """A function of a text column: struct(ids, decoded)."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])
    arrow = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs, cutter = loaded(path)
        for texts in batches:
            done = [pa.array([], arrow)]
            for part in text_runs(texts):
                ids, offs = cutter.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
                done.append(pa.StructArray.from_arrays([lists, pa.array(pairs.decode(ids, offs), pa.string())], names=["ids", "decoded"]))
            yield pa.concat_arrays([x.cast(arrow) for x in done])

    return run


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the BPE ids of each text and the text decoded from them. Columns of those names are replaced.

    Null and empty texts have no ids and decode to the empty text; an empty table stays empty.
    """
    both = "__both"
    return docs.withColumn(both, encode_decode(path)(F.col(text))).withColumn(ids, F.col(both)["ids"]).withColumn(decoded, F.col(both)["decoded"]).drop(both)


def round_trip_digests(path: str):
    """A function of a text column: struct(n_tokens, ids_sha256, decoded_sha256) of the same round trip.

    The digests are taken beside the ids, so that ids and decoded texts do not cross to the JVM only to be hashed.
    """
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pairs, cutter = loaded(path)
        decimal = [str(i) for i in range(pairs.width)]
        for texts in batches:
            n, first, second = [], [], []
            for part in text_runs(texts):
                ids, offs = cutter.encode(part)
                for a, b, back in zip(offs[:-1], offs[1:], pairs.decode(ids, offs), strict=True):
                    n.append(int(b - a))
                    first.append(hashlib.sha256(",".join([decimal[i] for i in ids[a:b].tolist()]).encode()).hexdigest())
                    second.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run
