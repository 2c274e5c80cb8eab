"""Exact Jaccard join of word-shingle sets, as link components (operator 7).

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of 0.75 at least. The result is
one row per document with its component, so that no copies are expanded into pairs:

1. Equal sets are one class, by two 64-bit digests; a class is then named by a number of its own. All shingles are counted over the corpus, dealt by hash in blobs of many
   shingles a row. A class that shares fewer than 0.75 of its shingles with any other document cannot link and leaves.
2. Of the rest, each class meets, in the lists of a few of its first shingles, the lists' heads; these pairs are verified
   and linked. The first head of a list is the class with the largest part of its shingles shared, as the origin of near
   copies is. Large groups are so linked with a pair or a few for each member, not with all pairs.
3. The exact remainder: first shingles up to the prefix length are indexed with size and position, rarer ones first.
   Index lists skip blocks: entries of one component, and groups of one head whose sizes, positions or parities rule a link
   out. Parities (which of 512 places an odd number of shingles falls on) bound how much two sets differ, so that members of
   a group of near copies that are not linked do not become pairs.
   A task adds the entries of a list's groups up before they are shuffled; a list of more than CHUNK groups is parted by size
   into chunks, and each two chunks whose sizes allow a link have a task of their own.
   Answers derive from those of a highly similar set: pairs of heads stand for all pairs of their groups. Their overlap,
   computed once, and what members share beside their heads, bounds the members' overlaps; where that leaves it open,
   members meet the other head, which narrows the bound, and only pairs within it are verified. Shingles that no other
   document has count for no overlap. No list, partner or candidate is cut off.

A set's order of shingles is (how common, hash): any order that is the same for all sets is exact. Memory of a task is
bounded by the blobs' size, and the number of blobs' buckets follows the number of documents.

Null, empty and white-space texts have no shingles and link with nothing. A text of one to four words is one shingle.
Repeated rows are returned as often as they come; a row without doc_id takes its class's component, if others have one, and
a class all of whose rows lack a doc_id links with nothing. Up to PART_EDGES links are contracted in one task,
more in alternating rounds of joins; both give the same components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spare_name, written
from .textbatch import mix, shingle_sets

K = 5
#: 100 * intersection >= PERCENT * union.
PERCENT = 75
FLUSH = 1 << 21
DOCS_A_BUCKET = 4000
#: Shingles that so many documents hold come after others, by powers of two; at most HOT_MOST are told apart, by count.
HOT, HOT_MOST = 8, 1 << 20
FIRST, HEADS = 8, 3
#: Parts of a head's pairs.
SALTS = 32
#: Edges that one task contracts at once.
PART_EDGES = 1_000_000


def least(n):
    """The smallest intersection with any set that links: ceil(PERCENT / 100 * n)."""
    return (n * PERCENT + 99) // 100


def needed(n, m):
    """The smallest intersection of sets of n and m shingles that links."""
    return ((n + m) * PERCENT + 99 + PERCENT) // (100 + PERCENT)


def digest(x: np.ndarray) -> tuple[int, int]:
    """A set's two keys: equal for equal sets, independent sums over its shingles."""
    with np.errstate(over="ignore"):
        first = mix(x ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(x))
        second = mix(x * np.uint64(0xD1342543DE82EF95) + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
        return tuple(mix(np.array([first, second])).view(np.int64).tolist())


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)) % np.uint64(buckets)


def planes(x: np.ndarray) -> bytes:
    """Small numbers by byte planes, so that the shuffle's compression finds the zeros."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def least_of(n):
    """least() of a column."""
    return F.floor((n * PERCENT + 99) / 100)


def needed_of(n, m):
    """needed() of columns."""
    return F.floor(((n + m) * PERCENT + 99 + PERCENT) / (100 + PERCENT))


BLOB = "bucket int, src long, a binary, b binary, meta binary"


def counted(docs: DataFrame, buckets: int) -> DataFrame:
    """BLOB rows: for each run of documents and bucket, its shingles' low halves (a) and documents (b, as steps)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), 0
        ids, sizes, keys, held, owners, seen, size = [], [], [], [], [], set(), 0
        none = (None, None)

        def flush() -> pa.RecordBatch:
            src = part << 32 | run
            every = np.concatenate(held) if held else np.zeros(0, np.uint64)
            owner = np.repeat(np.array(owners, np.int64), [len(x) for x in held]) if held else np.zeros(0, np.int64)
            at = bucket_of(every, buckets).astype(np.uint32)
            order = np.argsort(at.astype(np.uint16) if buckets < 1 << 16 else at, kind="stable")
            at, low, owner = at[order], (every[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), owner[order]
            full, first = np.unique(at, return_index=True)
            meta = pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "key": pa.array([k for k, _ in keys], pa.int64()), "key2": pa.array([k for _, k in keys], pa.int64())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, meta.schema) as w:
                w.write_table(meta)
            rows = [(int(b), src, low[x:y].tobytes(), planes(np.diff(owner[x:y], prepend=0)), None) for b, x, y in zip(full, first, np.append(first, len(at))[1:], strict=True)]
            rows.append((src % buckets, src, b"", b"", sink.getvalue().to_pybytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "src", "a", "b", "meta"])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for i, x in shingle_sets(batch.column("text"), K):
                key = digest(x) if len(x) else none
                if len(x) and key not in seen:  # copies within a run count once
                    seen.add(key)
                    held.append(x)
                    owners.append(len(ids))
                    size += len(x)
                ids.append(names[i])
                sizes.append(len(x))
                keys.append(key)
                if size >= FLUSH or len(ids) >= FLUSH:
                    yield flush()
                    run += 1
                    ids, sizes, keys, held, owners, seen, size = [], [], [], [], [], set(), 0
        if ids:
            yield flush()

    return docs.mapInArrow(deal, BLOB)


def shared_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each run, its documents and how many of their shingles others hold too; common shingles."""
    rows = rows.sort_values("src", kind="stable")
    out = [(int(r.src), None, None, r.meta) for r in rows.itertuples() if r.meta is not None]
    rows = rows[rows["meta"].isna()]
    if len(rows):
        low = np.concatenate([np.frombuffer(x, "<u4") for x in rows["a"]])
        _, which, count = np.unique(low, return_inverse=True, return_counts=True)
        shared = count[which] > 1
        common = np.flatnonzero(count >= HOT)
        if len(common):
            first = np.full(len(count), -1, np.int64)
            first[which[::-1]] = np.arange(len(which))[::-1]
            key = (np.int64(rows["bucket"].iloc[0]) << 32) + low[first[common]].astype(np.int64)
            out.append((-1, key.astype("<i8").tobytes(), planes(count[common]), None))
        at = 0
        for r in rows.itertuples():
            owner = np.cumsum(unplaned(r.b), dtype=np.int64)
            mine = owner[shared[at : at + len(owner)]]
            at += len(owner)
            if len(mine):
                doc, n = np.unique(mine, return_counts=True)
                out.append((int(r.src), planes(doc), planes(n), None))
    return pd.DataFrame(out, columns=["src", "a", "b", "meta"])


def document_rows(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one run: its documents with size, class and number of shared shingles."""
    meta = [x for x in rows["meta"] if x is not None]
    docs = pa.ipc.open_stream(meta[0]).read_all() if meta else pa.table({"doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "key2": pa.array([], pa.int64())})
    total = np.zeros(len(docs), np.int64)
    for r in rows.itertuples():
        if r.meta is None:
            np.add.at(total, unplaned(r.a).astype(np.int64), unplaned(r.b).astype(np.int64))
    out = docs.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
    out["shared"] = total
    return out


def ordered(x: np.ndarray, hot: tuple[np.ndarray, np.ndarray], buckets: int) -> np.ndarray:
    """The set by (how common, hash)."""
    keys, levels = hot
    if not len(keys):
        return x
    key = (bucket_of(x, buckets).astype(np.int64) << 32) + (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    return x[np.argsort(np.where(keys[at] == key, levels[at], 0), kind="stable")]


def common_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The HOT_MOST most common shingles' sorted keys and the logarithms of their counts: bounded by HOT_MOST."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, "<i8")), pa.array(unplaned(b).astype(np.int64))], names=["token", "n"])

    rows = counts.where(F.col("src") == -1).select("a", "b").mapInArrow(each, "token long, n long")
    if rows.count() > HOT_MOST:
        rows = rows.orderBy(F.desc("n"), "token").limit(HOT_MOST)
    got = rows.toArrow().sort_by("token")
    return got["token"].to_numpy().astype(np.int64), np.log2(np.maximum(1, got["n"].to_numpy())).astype(np.uint8)


def matching_texts(rows: DataFrame) -> DataFrame:
    """(key, n, s, text) of the rows whose text has the set of the digests k1, k2; s of its n shingles are shared with any other."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
            keep, sizes = [], []
            for i, x in shingle_sets(batch.column("text"), K):
                if len(x) and digest(x) == keys[i]:
                    keep.append(i)
                    sizes.append(len(x))
            got = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column("key"), pa.array(sizes, pa.int64()), got.column("s"), got.column("text")], names=["key", "n", "s", "text"])

    return rows.select("key", "k1", "k2", "s", "text").mapInArrow(check, "key long, n long, s long, text string")


def first_shingles(classes: DataFrame, hot, buckets: int) -> DataFrame:
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, shared, rows = batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("s").to_pylist(), ([], [], [], [])
            for i, x in shingle_sets(batch.column("text"), K):
                some = ordered(x, hot.value, buckets)
                # a few of the first, and of the smallest hashes, which near copies share most often
                some = np.unique(np.concatenate([some[:FIRST], x[:FIRST]])).view(np.int64)
                for column, value in zip(rows, (some, keys[i], sizes[i], shared[i]), strict=True):
                    column.append(value if column is rows[0] else np.full(len(some), value))
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in rows], names=["token", "key", "n", "s"])

    return classes.mapInArrow(first, "token long, key long, n long, s long")


def head_pairs(first: DataFrame) -> DataFrame:
    """(a, b): each class with the heads of its lists: the one with the least unshared part, and the least by hashes."""
    entry = lambda *order: F.min(F.struct(*order, "key", "n", "s"))
    best = [entry(((F.col("n") - F.col("s")) / F.col("n")).alias("lone"), F.xxhash64("key")).alias("h0"), *[entry(F.xxhash64("key", F.lit(i))).alias(f"h{i}") for i in range(1, HEADS)]]
    every = F.array_distinct(F.array(*[F.struct(F.col(f"h{i}.key").alias("key"), F.col(f"h{i}.n").alias("n"), F.col(f"h{i}.s").alias("s")) for i in range(HEADS)]))
    heads = written(first.groupBy("token").agg(F.count("*").alias("size"), *best).where("size > 1").select("token", F.explode(every).alias("head")).select("token", F.col("head.key").alias("a"), F.col("head.n").alias("m"), F.col("head.s").alias("s_head")), "heads")
    met = first.join(heads, "token").where((F.col("a") != F.col("key")) & (F.least("s", "s_head") >= needed_of(F.col("n"), F.col("m"))))
    return met.select("a", F.col("key").alias("b")).distinct()


def overlaps(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, n, m, shared): the pairs with their sets' sizes and exact intersection.

    A head of many members is the a of many pairs: these are dealt by SALTS values of b too, and the head's text goes to
    those of them that occur, so that a head with one member is shipped once.
    """
    right = classes.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    left = classes.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    heads = dealt.select("a", "salt").distinct().join(left, "a")
    both = dealt.join(right, "b").join(heads, ["a", "salt"]).select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None  # rows come sorted by a, whose set is made once
        for batch in batches:
            a, b, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            new = [i for i in range(len(a)) if a[i] != (a[i - 1] if i else last)]
            sets = {new[i]: x for i, x in shingle_sets(batch.column("text_a").take(pa.array(new, pa.int64())), K)}
            for i, x in shingle_sets(batch.column("text_b"), K):
                mine = sets.get(i, mine)
                out.append((a[i], b[i], len(mine), len(x), len(np.intersect1d(mine, x, assume_unique=True))))
            if a:
                last = a[-1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b", "n", "m", "shared"])

    return both.mapInArrow(compare, "a long, b long, n long, m long, shared long")


def linked(x: DataFrame) -> DataFrame:
    return x.where(100 * F.col("shared") >= PERCENT * (F.col("n") + F.col("m") - F.col("shared")))


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """Edges (u, v) of each part as stars: every node with the smallest of its part's component, itself left out."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                u, v = root(u), root(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
        rows = [(x, root(x)) for x in up if root(x) != x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["u", "v"])

    return edges.coalesce(parts).mapInArrow(contract, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of all nodes of edges (a, b).

    Edges are first contracted in parts of about PART_EDGES. A single part is then complete; else alternating large-star
    and small-star rounds follow, each written.
    """
    e = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    parts = max(1, -(-e.count() // PART_EDGES))
    e = written(contracted(e, parts), "edges")
    mark = None
    while parts > 1:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("u != m").select("u", F.col("m").alias("v"))).distinct()
        large = written(large, "large")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(smallest.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (now["n"], now["x"]) == mark:
            break
        mark = (now["n"], now["x"])
    return e.select(F.col("u").alias("key"), F.col("v").alias("root")).union(e.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())


#: Bits of a set's parities, 64 times WORDS.
WORDS = 8
#: A group of a list: least n, most n (high), most s, most n - at (behind) and most at (before) of its entries, their number k; the
#: parities (bits) of the entry nearest its head, how many shingles tell that one from the head (off), and the most for any (far).
GROUP = np.dtype([("token", "<u8"), ("root", "<i8"), ("head", "<i8"), *[(c, "<u4") for c in ("n", "high", "s", "behind", "before", "k", "off", "far")], ("bits", "<u8", (WORDS,))])
#: Groups of a list that one task compares with each other.
CHUNK = 8192


def parities(x: np.ndarray) -> np.ndarray:
    """For each of 64 * WORDS places whether an odd number of a set's shingles falls on it. Two sets differ in as many shingles, at least, as in places."""
    at = mix(x ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(64 * WORDS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * WORDS).astype(np.uint8) & 1).view("<u8")


def grouped(x: np.ndarray) -> np.ndarray:
    """GROUP entries added up by token, root and head, in their order."""
    if not len(x):
        return x
    x = x[np.lexsort((x["off"], x["head"], x["root"], x["token"]))]
    first = np.flatnonzero(np.concatenate([[True], (x["token"][1:] != x["token"][:-1]) | (x["root"][1:] != x["root"][:-1]) | (x["head"][1:] != x["head"][:-1])]))
    out = x[first].copy()
    out["n"] = np.minimum.reduceat(x["n"], first)
    out["k"] = np.add.reduceat(x["k"], first)
    for c in ("high", "s", "behind", "before", "far"):
        out[c] = np.maximum.reduceat(x[c], first)
    return out


def prefix_blobs(classes: DataFrame, hot, buckets: int) -> DataFrame:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            every = grouped(np.concatenate(held))
            at = bucket_of(every["token"], buckets)
            order = np.argsort(at, kind="stable")
            full, first = np.unique(at[order], return_index=True)
            rows = [every[order[x:y]].tobytes() for x, y in zip(first, np.append(first, len(order))[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            heads, roots, shared, far = (batch.column(c).to_pylist() for c in ("head", "root", "s", "far"))
            for i, x in shingle_sets(batch.column("text"), K):
                some = ordered(x, hot.value, buckets)[: len(x) - least(len(x)) + 1]
                one, at = np.zeros(len(some), GROUP), np.arange(len(some))
                one["token"], one["root"], one["head"], one["n"], one["high"], one["s"], one["behind"], one["before"] = some, roots[i], heads[i], len(x), len(x), shared[i], len(x) - at, at
                one["k"], one["off"], one["far"], one["bits"] = 1, far[i], far[i], parities(x)
                held.append(one)
                size += len(some)
                if size >= FLUSH // 12:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return classes.mapInArrow(deal, "bucket int, rows binary")


def linkable(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether some members of the groups i and j could link by the shared shingle, by sizes, positions, shared parts and parities.

    Linked sets of n and m shingles differ in (100 - PERCENT) / (100 + PERCENT) of n + m at most. Parities bound the difference of
    the groups' nearest entries from below; what tells other members from these, over the head, is taken off.
    """
    n, high, s, behind, before, off, far = (x[c].astype(np.int64) for c in ("n", "high", "s", "behind", "before", "off", "far"))
    most = np.minimum(np.minimum(behind[i], behind[j]) + np.minimum(before[i], before[j]), np.minimum(s[i], s[j]))
    fit = most >= np.maximum(needed(n[i], n[j]), least(np.maximum(n[i], n[j])))
    at, slack = np.flatnonzero(fit), np.where(x["k"] > 1, off + far, 0)
    for a in range(0, len(at), 1 << 16):
        one, other = i[at[a : a + (1 << 16)]], j[at[a : a + (1 << 16)]]
        differ = np.bitwise_count(x["bits"][one] ^ x["bits"][other]).sum(1, dtype=np.int64) - slack[one] - slack[other]
        fit[at[a : a + (1 << 16)]] = (100 + PERCENT) * differ <= (100 - PERCENT) * (high[one] + high[other])
    return fit


def pairs_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)


LISTED = "a long, b long, token long, rows binary"


def list_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """LISTED: pairs (a, b) of one bucket's heads in different components that could link; lists too long for that, whole."""
    x = grouped(np.concatenate([np.frombuffer(r, GROUP) for r in rows["rows"]]))
    first = np.flatnonzero(np.concatenate([[True], x["token"][1:] != x["token"][:-1]]))
    size = np.diff(np.append(first, len(x)))
    mixed = np.maximum.reduceat(x["root"], first) != np.minimum.reduceat(x["root"], first)  # lists of one component are skipped
    long = [(int(x["token"][f].view(np.int64)), x[f : f + n].tobytes()) for f, n in zip(first[mixed & (size > CHUNK)], size[mixed & (size > CHUNK)], strict=True)]
    x = x[np.repeat(mixed & (size <= CHUNK), size)]
    every = np.zeros((0, 2), np.int64)
    if len(x):
        token, root, head = x["token"], x["root"], x["head"]
        token_end = np.searchsorted(token, token, "right")
        change = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (root[1:] != root[:-1])]))
        root_end = np.repeat(np.append(change[1:], len(token)), np.diff(np.append(change, len(token))))
        partners = token_end - root_end  # a list skips the own component's blocks
        total, lo = np.concatenate([[0], np.cumsum(partners)]), 0
        while lo < len(token):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 19), "right")) - 1)
            i = np.repeat(np.arange(lo, hi), partners[lo:hi])
            j = np.arange(len(i)) + np.repeat(root_end[lo:hi] - (total[lo:hi] - total[lo]), partners[lo:hi])
            fit = linkable(x, i, j)
            every = np.unique(np.concatenate([every, pairs_of(head[i[fit]], head[j[fit]])]), axis=0)
            lo = hi
    return pd.DataFrame({"a": [*every[:, 0].tolist(), *[None] * len(long)], "b": [*every[:, 1].tolist(), *[None] * len(long)], "token": [*[None] * len(every), *[t for t, _ in long]], "rows": [*[None] * len(every), *[r for _, r in long]]}).astype({"a": "Int64", "b": "Int64", "token": "Int64"})


def long_list_pairs(lists: DataFrame) -> DataFrame:
    """(a, b) of lists (token, rows) of many groups: chunks of like sizes, and a task for each two that sizes let link."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for token, raw in zip(batch.column("token").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                x = np.frombuffer(raw, GROUP)
                x = x[np.argsort(x["n"], kind="stable")]
                parts = [x[a : a + CHUNK] for a in range(0, len(x), CHUNK)]
                for i, p in enumerate(parts):
                    # a group's members may be larger than its least n: what they reach is bounded by behind and before
                    reach = int((p["behind"].astype(np.int64) + p["before"]).max())
                    for j in range(i, len(parts)):
                        if least(int(parts[j]["n"].min())) <= reach:
                            yield pa.RecordBatch.from_pydict({"token": pa.array([token], pa.int64()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "x": pa.array([p.tobytes()], pa.binary()), "y": pa.array([parts[j].tobytes()], pa.binary())})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x, y in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "x", "y")), strict=True):
                x, y = np.frombuffer(x, GROUP), np.frombuffer(y, GROUP)
                both = np.concatenate([x, y])
                every = np.zeros((0, 2), np.int64)
                for a in range(0, len(x), 64):
                    k = np.repeat(np.arange(a, min(len(x), a + 64)), len(y))
                    m = np.tile(np.arange(len(y)), len(k) // len(y))
                    some = x["root"][k] != y["root"][m]
                    if i == j:
                        some &= k < m
                    k, m = k[some], m[some]
                    fit = linkable(both, k, m + len(x))
                    every = np.unique(np.concatenate([every, pairs_of(x["head"][k[fit]], y["head"][m[fit]])]), axis=0)
                if len(every):
                    yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["a", "b"])

    dealt = lists.select("token", "rows").mapInArrow(chunks, "token long, i int, j int, x binary, y binary")
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "token", "i", "j").mapInArrow(compare, "a long, b long")


def remaining_links(classes: DataFrame, near: DataFrame, roots: DataFrame, stars: DataFrame, hot, buckets: int) -> DataFrame:
    """Links between different components of roots that the heads' pairs have not shown; each is verified."""
    sizes = classes.select("key", "n", "s")
    # each class's head: the most similar one it links with, itself if none; extra is what it can share beside the head
    best = linked(stars).groupBy(F.col("b").alias("key")).agg(F.max(F.struct("shared", "a", (F.col("n") + F.col("m") - 2 * F.col("shared")).alias("far"))).alias("x"))
    member = sizes.join(best, "key", "left").join(roots, "key", "left")
    member = written(member.select("key", "n", "s", F.coalesce("root", "key").alias("root"), F.coalesce("x.a", "key").alias("head"), F.when(F.col("x").isNull(), 0).otherwise(F.greatest(F.lit(0), F.col("s") - F.col("x.shared"))).alias("extra"), F.coalesce("x.far", F.lit(0)).alias("far")), "members")
    listed = classes.select("key", "s", "text").join(member.select("key", "root", "head", "far"), "key")
    met = written(prefix_blobs(listed, hot, buckets).groupBy("bucket").applyInPandas(list_pairs, LISTED), "lists")
    pairs = written(met.where("rows is null").select("a", "b").union(long_list_pairs(met.where("rows is not null"))).distinct(), "pairs")
    met = written(overlaps(pairs, classes), "overlaps")
    links = linked(met).select("a", "b")

    def apart(rows: DataFrame, found: DataFrame) -> DataFrame:
        """The pairs of heads that found leaves in different components."""
        now = components(near.union(found))
        for s in ("a", "b"):
            rows = rows.join(now.select(F.col("key").alias(s), F.col("root").alias(f"root_{s}")), s, "left")
        return rows.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "shared")

    group = member.groupBy("head").agg(F.max("extra").alias("extra"), F.min("n").alias("n"), F.max("s").alias("s"), F.bool_or(F.col("key") != F.col("head")).alias("more"))
    open_ = met
    for s in ("a", "b"):
        open_ = open_.join(group.select(F.col("head").alias(s), F.col("extra").alias(f"extra_{s}"), F.col("n").alias(f"n_{s}"), F.col("more").alias(f"more_{s}")), s)
    bound = F.col("shared") + F.col("extra_a") + F.col("extra_b")
    open_ = open_.where((bound >= needed_of(F.col("n_a"), F.col("n_b"))) & (F.col("more_a") | F.col("more_b"))).select("a", "b", "shared")
    open_ = written(apart(open_, links), "open")
    if open_.isEmpty():
        return links
    # members meet the other head, as far as the bound leaves it open
    turned = written(open_.union(open_.select("b", "a", "shared")), "open")
    wide = group.select(F.col("head").alias("b"), F.col("extra").alias("extra_b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"))
    own = member.where("key != head").select(F.col("head").alias("a"), F.col("key").alias("one"), "n", "s", "extra")
    asked = turned.join(wide, "b").join(own, "a").where(F.least(F.col("shared") + F.col("extra") + F.col("extra_b"), "s", "s_b") >= needed_of(F.col("n"), F.col("n_b")))
    second = written(overlaps(asked.select(F.col("b").alias("a"), F.col("one").alias("b")).distinct(), classes), "overlaps")
    links = links.union(linked(second).select("a", "b"))
    open_ = written(apart(open_, links), "open")
    if open_.isEmpty():
        return links
    turned = open_.union(open_.select("b", "a", "shared"))
    # (a, b, one, n, extra, most): a member of a's group and the most it shares with the head b
    exact = second.select(F.col("a").alias("b"), F.col("b").alias("one"), F.col("shared").alias("exact"))
    whole = member.select(F.col("head").alias("a"), F.col("key").alias("one"), "n", "s", "extra")
    side = turned.join(wide, "b").join(whole, "a").where(F.least(F.col("shared") + F.col("extra") + F.col("extra_b"), "s", "s_b") >= needed_of(F.col("n"), F.col("n_b")))
    side = side.join(exact, ["b", "one"], "left").withColumn("most", F.coalesce("exact", F.col("shared") + F.col("extra")))
    side = written(side.where(F.col("most") + F.col("extra_b") >= needed_of(F.col("n"), F.col("n_b"))).select("a", "b", "one", "n", "s", "extra", "most"), "sides")
    left = side.select("a", "b", *[F.col(c).alias(f"{c}_a") for c in ("one", "n", "s", "extra", "most")])
    right = side.select(F.col("a").alias("b"), F.col("b").alias("a"), *[F.col(c).alias(f"{c}_b") for c in ("one", "n", "s", "extra", "most")])
    able = F.least(F.col("most_a") + F.col("extra_b"), F.col("most_b") + F.col("extra_a"), "s_a", "s_b") >= needed_of(F.col("n_a"), F.col("n_b"))
    last = open_.select("a", "b").join(left, ["a", "b"]).join(right, ["a", "b"]).where(able)
    last = last.select(F.col("one_a").alias("a"), F.col("one_b").alias("b")).distinct()
    return links.union(linked(overlaps(last, classes)).select("a", "b"))


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; component_id is the smallest doc_id reachable by links."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = max(16, -(-rows.count() // DOCS_A_BUCKET))
    sc = docs.sparkSession.sparkContext
    counts = written(counted(rows, buckets).groupBy("bucket").applyInPandas(shared_counts, "src long, a binary, b binary, meta binary"), "counts")
    every = written(counts.where("src >= 0").groupBy("src").applyInPandas(document_rows, "doc_id long, n long, key long, key2 long, shared long"), "rows")
    every = every.withColumnsRenamed({"key": "k1", "key2": "k2"})
    classes = every.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("shared").alias("shared"))
    classes = written(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    hot = sc.broadcast(common_shingles(counts))
    able = classes.where(F.col("shared") >= least_of(F.col("n"))).where("doc_id is not null")
    able = able.select("doc_id", "key", "k1", "k2", F.col("shared").alias("s"))
    texts = written(matching_texts(rows.join(able, "doc_id")).dropDuplicates(["key"]), "texts")
    stars = written(overlaps(head_pairs(written(first_shingles(texts, hot, buckets), "first")), texts), "stars")
    near = written(linked(stars).select("a", "b"), "links")
    roots = written(components(near), "roots")
    more = written(remaining_links(texts, near, roots, stars, hot, buckets), "links")
    if not more.isEmpty():
        roots = written(components(near.union(more)), "roots")
    named = classes.select("key", "doc_id").join(roots, "key")
    named = named.groupBy("root").agg(F.min("doc_id").alias("low")).join(roots, "root").select("key", "low")
    final = written(classes.select("key", "k1", "k2", "doc_id").join(named, "key", "left").select("k1", "k2", F.coalesce("low", "doc_id").alias("low")), "names")
    discard(counts, classes, texts, stars, near, more)
    return every.join(final, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose doc_id is not their component's smallest. Rows that repeat an id are one document."""
    gone = spare_name(docs.columns, "gone")
    found = link_components(docs, doc_id, text).where("n_shingles > 0 and doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, docs[doc_id].cast("long") == F.col(gone), "left_anti")
