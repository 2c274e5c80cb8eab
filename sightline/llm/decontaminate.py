"""Benchmark decontamination by a prefix-filtered set join (operator 5).

A window is WINDOW consecutive words of an item, or a shorter item as a whole. Each window is a set of shingles of up to
SHINGLE words, ordered by rarity: how often the whole corpus holds each, counted in a first pass. As containment must be
exact, one shingle is a window's necessary prefix: its rarest. A document's shingles join the windows' prefixes; a
candidate must leave room for the window before and after (position and length bounds), and is then verified word by
word. Items of any size are so matched over windows of their own size.

The benchmark is read in blocks of at most BLOCK_WORDS words, and a block is broadcast: its size is bounded, however
large the benchmark is. Equal windows of a block are one window with a list of items. Documents stay where they are; with more
than one block, each block's hits are written before the next is broadcast, and hits are united by two hashes of the text.
Words are compared by their 64-bit hashes.

Null and empty texts have no words; repeated items count once for each item_id, items without id not at all among items; an
empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spare_name, written
from .textbatch import ALNUM, mix, pieces, words

WINDOW, SHINGLE = 13, 4
BLOCK_WORDS = 4_000_000


def shingled(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + ids[i : i + n]
    return mix(total + np.uint64(k))


@dataclass
class Block:
    """The distinct windows of some items as arrays; words are all items' word hashes, one after another.

    The items of window i are items[of_window[i]:of_window[i + 1]], as places in item_ids.
    """

    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    of_window: np.ndarray
    items: np.ndarray
    item_ids: list

    @property
    def lengths(self) -> list[int]:
        """The shingle lengths that occur: SHINGLE, and those of windows that are shorter."""
        return sorted({int(x) for x in np.minimum(self.sizes, SHINGLE)})

    def shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place in it, hash) of every shingle of every window."""
        win, place, out = [], [], []
        for k in self.lengths:
            every = shingled(self.words, k)
            here = np.flatnonzero(np.minimum(self.sizes, SHINGLE) == k)
            for offset in range(int(self.sizes[here].max()) - k + 1):
                fit = here[self.sizes[here] - k >= offset]
                win.append(fit)
                place.append(np.full(len(fit), offset))
                out.append(every[self.starts[fit] + offset])
        if not win:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(win), np.concatenate(place), np.concatenate(out)


def block_of(rows: list) -> Block:
    text = pa.array([r[1] for r in rows], pa.string())
    got, starts, sizes, items, base = [], [], [], [], 0
    for a, b, buf, offs in pieces(text):
        _, _, hashes, at = words(buf, offs, ALNUM)
        got.append(hashes)
        for i in range(b - a):
            n = int(at[i + 1] - at[i])
            if n:
                size = min(n, WINDOW)
                first = np.arange(n - size + 1) + base + int(at[i])
                starts.append(first)
                sizes.append(np.full(len(first), size))
                items.append(np.full(len(first), a + i))
        base += len(hashes)
    cat = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
    return distinct(cat(got, np.uint64), cat(starts, np.int64), cat(sizes, np.int64), cat(items, np.int64), [r[0] for r in rows])


def distinct(every: np.ndarray, starts: np.ndarray, sizes: np.ndarray, items: np.ndarray, item_ids: list) -> Block:
    """Equal windows, by two hashes of their words, become one."""
    h1, h2 = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        for h, words_ in ((h1, every), (h2, mix(every ^ np.uint64(0xA0761D6478BD642F)))):
            h[own] = shingled(words_, int(size))[starts[own]]
    order = np.lexsort((items, h2, h1))
    h1, h2, items = h1[order], h2[order], items[order]
    new = np.ones(len(order), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    keep = new.copy()
    keep[1:] |= items[1:] != items[:-1]
    window = order[new]
    return Block(every, starts[window], sizes[window], np.append(np.flatnonzero(new[keep]), keep.sum()), items[keep], item_ids)


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, read one partition of it at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).toLocalIterator():
        n = len(r[1] or "") // 2 + 1
        if held and size + n > BLOCK_WORDS:
            yield block_of(held)
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield block_of(held)


def word_batches(batch: pa.RecordBatch, column: str):
    for a, b, buf, offs in pieces(batch.column(column)):
        _, _, hashes, at = words(buf, offs, ALNUM)
        yield a, b, hashes, at


def found_in(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, index in the sorted keys) of the hashes that are among keys."""
    at = np.searchsorted(keys, hashes)
    at[at == len(keys)] = 0
    hit = np.flatnonzero(keys[at] == hashes) if len(keys) else np.zeros(0, np.int64)
    return hit, at[hit]


def document_of(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, places, "right") - 1


def inside(at: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """Whether k words from there are of one document."""
    return places + k <= at[document_of(at, places) + 1]


def rarity(docs: DataFrame, text: str, block: Block) -> np.ndarray:
    """How often the corpus holds each of the block's shingles, in the order of their sorted hashes."""
    _, _, every = block.shingles()
    keys = np.unique(every)
    lengths = block.lengths
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, _, hashes, at in word_batches(batch, "text"):
                for k in lengths:
                    hit, which = found_in(known, shingled(hashes, k))
                    fit = inside(at, hit, k)
                    total += np.bincount(which[fit], minlength=len(known))
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["k", "n"])

    out = np.zeros(len(keys), np.int64)
    if len(keys):
        counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
        out[counted["k"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


@dataclass
class Index:
    """Windows by their prefix shingle: keys are sorted, with the windows of a key between bounds."""

    block: Block
    lengths: list[int]
    keys: np.ndarray
    bounds: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def index_of(block: Block, counts: np.ndarray) -> Index:
    win, place, every = block.shingles()
    keys, which = np.unique(every, return_inverse=True)
    order = np.lexsort((every, counts[which] if len(which) else which, win))
    first = order[np.concatenate([[True], np.diff(win[order]) > 0])] if len(order) else order
    chosen = first[np.argsort(every[first], kind="stable")]
    own, at = np.unique(every[chosen], return_index=True)
    return Index(block, block.lengths, own, np.append(at, len(chosen)), win[chosen], place[chosen])


def occurrences(index: Index, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in the documents that at divides."""
    block, firsts, wins = index.block, [], []
    for k in index.lengths:
        hit, which = found_in(index.keys, shingled(hashes, k))
        if not len(hit):
            continue
        size = np.diff(index.bounds)[which]
        entry = np.arange(size.sum()) + np.repeat(index.bounds[which] - np.cumsum(size) + size, size)
        hit = np.repeat(hit, size)
        win = index.window[entry]
        start = hit - index.offset[entry]
        doc = document_of(at, hit)
        fit = (start >= at[doc]) & (start + block.sizes[win] <= at[doc + 1]) & (np.minimum(block.sizes[win], SHINGLE) == k)
        start, win = start[fit], win[fit]
        for size in np.unique(block.sizes[win]):
            own = np.flatnonzero(block.sizes[win] == size)
            s, w = start[own], win[own]
            same = np.ones(len(s), bool)
            for i in range(int(size)):
                same &= hashes[s + i] == block.words[block.starts[w] + i]
            firsts.append(s[same])
            wins.append(w[same])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(firsts), np.concatenate(wins)


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.IntegerType(), False)),
    T.StructField("items", T.ArrayType(T.StringType(), False)),
])


def matcher(shared, text_type=RESULT):
    @F.arrow_udf(text_type)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        block = index.block
        names = [None if x is None else str(x) for x in block.item_ids]
        for texts in batches:
            n_words, hits, items = [], [], []
            for a, b, buf, offs in pieces(texts):
                _, _, hashes, at = words(buf, offs, ALNUM)
                n_words += np.diff(at).tolist()
                first, win = occurrences(index, hashes, at)
                cover = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + index.block.sizes[win], -1)
                hit = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
                bounds = np.searchsorted(hit, at)
                by = np.argsort(first, kind="stable")
                owner = np.searchsorted(first[by], at)
                for i in range(b - a):
                    x, y = bounds[i], bounds[i + 1]
                    hits.append((hit[x:y] - at[i]).astype(np.int32) if y > x else ())
                    x, y = owner[i], owner[i + 1]
                    found = {names[k] for w in set(win[by[x:y]].tolist()) for k in block.items[block.of_window[w] : block.of_window[w + 1]]} if y > x else ()
                    items.append(sorted(k for k in found if k is not None))
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["n_words", "hits", "items"])

    return match


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, hits (word places inside any occurrence of a window) and items (ids as sorted strings).

    Columns of those names are replaced. Each row is judged by its own text, so that repeated or null doc_ids do no harm.
    """
    sc = docs.sparkSession.sparkContext
    name = spare_name(docs.columns, "found")
    todo = blocks(benchmark, item_id, item_text)
    first, second = next(todo, None), next(todo, None)
    if second is None:
        index = index_of(first, rarity(docs, text, first)) if first else index_of(block_of([]), np.zeros(0, np.int64))
        out = docs.withColumn(name, matcher(sc.broadcast(index))(F.col(text)))
    else:
        out = docs.withColumn(name, matcher(sc.broadcast(index_of(block_of([]), np.zeros(0, np.int64))))(F.col(text)))
        h1, h2, more = (spare_name(docs.columns, x) for x in ("h1", "h2", "more"))
        keys = {h1: F.xxhash64(text), h2: F.xxhash64(F.lit(1), text)}
        parts = None
        for block in chain((first, second), todo):
            shared = sc.broadcast(index_of(block, rarity(docs, text, block)))
            hit = docs.select(F.col(text).alias("text")).withColumn(more, matcher(shared)(F.col("text"))).where(F.size(F.col(more)["hits"]) > 0)
            hit = written(hit.select(F.xxhash64("text").alias(h1), F.xxhash64(F.lit(1), "text").alias(h2), more).dropDuplicates([h1, h2]), "hits")
            shared.destroy()
            parts = hit if parts is None else parts.unionByName(hit)
        both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.col(more)[c]))))
        parts = parts.groupBy(h1, h2).agg(F.struct(both("hits").alias("hits"), both("items").alias("items")).alias(more))  # a row for each block at most
        out = out.withColumns(keys).join(parts, [h1, h2], "left")
        side = lambda c: F.coalesce(F.col(more)[c], F.col(name)[c]).alias(c)
        out = out.withColumn(name, F.struct(F.col(name)["n_words"].alias("n_words"), side("hits"), side("items"))).drop(h1, h2, more)
    for c in ("n_words", "hits", "items"):
        out = out.withColumn(c, F.col(name)[c])
    return out.drop(name)


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)
