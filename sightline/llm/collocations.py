"""Collocations of a language by hierarchical pair naming (operator 13).

Texts become blocks of words in local numbers, a language and some megabytes each. On every level a block's distinct
entries, with their counts, are dealt to buckets by hash; a bucket counts an entry over all blocks, names it if it is
frequent, and sends the name back to the blocks that hold it, whose places are then renamed: words on the first level,
on level k the pairs of adjacent names of level k - 1, which share all words but one. So what is shuffled is each block's
distinct entries, packed, and no single occurrence; an entry comes once from a block, however common it is. A pair's name
points at its two parents, its first and its last k - 1 words: along these pointers go the counts of all cuts, the
phrases' texts, and what subsumes a phrase.

An entry is frequent from `least` occurrences on; parts of frequent phrases are frequent, so nothing is lost. Null texts
have no words, null languages are `und`, repeated rows count as often as they stand, and empty tables have no phrases.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written
from .textbatch import mix

#: Bytes of text from which on a task closes its blocks. A longer piece between separators is not cut.
BLOCK = 4 << 20
#: Entries for a bucket, on average; a bucket is one task's work. None is much larger, as an entry comes once from a block.
BUCKET = 1 << 20
#: Parts of a language in which the first rows are taken before they meet.
PARTS = 64
#: A byte that no word holds stands for each place between pieces, and for nothing else.
_STOP = b"."
_LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz" + _STOP * 9)
#: size: words on the first level; entries: distinct ones, in the order of their hashes, code i + 1 is entry i.
BLOCKS = "block long, lang string, size long, entries long, codes binary, words binary, lefts binary, rights binary, counts binary"
DEALT = "bucket long, block long, lang string, start long, words binary, lefts binary, rights binary, counts binary"
NAMED = "block long, codes binary, names binary, lang string, words array<string>, lefts array<long>, rights array<long>, f array<long>, id array<long>"


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes as the largest needs, by planes of bytes and compressed."""
    x = np.ascontiguousarray(x, "<u8")
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + zstandard.ZstdCompressor(1).compress(x.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


def packed_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b" ".join(words))


def unpacked_words(data: bytes) -> list[bytes]:
    """Words hold no blank; a block without words has no bytes."""
    return zstandard.ZstdDecompressor().decompress(data).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def pair_hashes(lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """32 bits for each pair of ids."""
    return (mix(mix(lefts.astype(np.uint64)) + rights.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def counted_block(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(codes, words by hash, counts) of texts already in lower case: code 0 ends a piece, code i + 1 is words[i]."""
    found = _STOP.join(texts).replace(_STOP, b" . ").split()
    words = [w for w in dict.fromkeys(found) if w != _STOP]
    words = [words[i] for i in np.argsort(word_hashes(words), kind="stable").tolist()]
    index = {_STOP: 0, **dict(zip(words, range(1, len(words) + 1), strict=True))}
    codes = np.fromiter(map(index.__getitem__, found), np.int32, len(found))
    return codes, words, np.bincount(codes, minlength=len(index))[1:]


def cut_long(text: bytes, most: int) -> Iterator[bytes]:
    """text in parts of at least most bytes that end where pieces end."""
    at = 0
    while len(text) - at > most and (end := text.find(_STOP, at + most)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def word_blocks(docs: DataFrame, most: int) -> DataFrame:
    """Blocks of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list[bytes]] = {}
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal made, size
            rows = []
            for lang, texts in held.items():
                codes, words, counts = counted_block(texts)
                rows.append({"block": base + made, "lang": lang, "size": int(counts.sum()), "entries": len(words), "codes": packed(codes), "words": packed_words(words), "counts": packed(counts)})
                made += 1
            held.clear()
            size = 0
            return pa.RecordBatch.from_pylist(rows, arrow_schema(BLOCKS))

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                for part in cut_long(text.as_py().encode().translate(_LOW), most):
                    held.setdefault(lang.as_py(), []).append(part)
                    size += len(part)
                    if size >= most:
                        yield close()
        if held:
            yield close()

    return docs.mapInArrow(run, BLOCKS)


def dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """The blocks' entries by bucket: entries stand by hash, so that a bucket's are a slice, which starts at code start + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts, words, pairs = unpacked(row["counts"]), None, None
                if row["words"] is not None:
                    words = unpacked_words(row["words"])
                    hashes = word_hashes(words)
                else:
                    pairs = unpacked(row["lefts"]), unpacked(row["rights"])
                    hashes = pair_hashes(*pairs)
                bucket = (hashes * buckets) >> 32
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                out = []
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
                    own = {"words": packed_words(words[a:b])} if words is not None else {k: packed(x[a:b]) for k, x in zip(("lefts", "rights"), pairs, strict=True)}
                    out.append({"bucket": int(bucket[a]), "block": row["block"], "lang": row["lang"], "start": a, "counts": packed(counts[a:b]), **own})
                yield pa.RecordBatch.from_pylist(out, arrow_schema(DEALT))

    return blocks.where("entries > 0").select("block", "lang", "words", "lefts", "rights", "counts").mapInArrow(run, DEALT)


def distinct_entries(rows: list[dict]) -> tuple[np.ndarray, dict]:
    """(the number of each entry among the distinct ones, these as columns) of a bucket's rows of one language."""
    if rows[0]["words"] is not None:
        every = pa.array([w for r in rows for w in unpacked_words(r["words"])], pa.binary()).dictionary_encode()
        return every.indices.to_numpy(), {"words": every.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False)}
    left, right = (np.concatenate([unpacked(r[k]) for r in rows]) for k in ("lefts", "rights"))
    names, li = np.unique(left, return_inverse=True)
    others, ri = np.unique(right, return_inverse=True)
    keys, inverse = np.unique(li * len(others) + ri, return_inverse=True)
    return inverse, {"lefts": names[keys // len(others)], "rights": others[keys % len(others)]}


def counted_buckets(entries: DataFrame, buckets: int, least: int, back: bool) -> DataFrame:
    """Frequent entries with f and id, a row for each bucket and language; with back also each block's codes and their names."""

    def run(table: pa.Table) -> pa.Table:
        bucket, out, made = table.column("bucket")[0].as_py(), [], 0
        rows = sorted(table.to_pylist(), key=lambda r: (r["lang"], r["block"]))
        for lang in dict.fromkeys(r["lang"] for r in rows):
            own = [r for r in rows if r["lang"] == lang]
            at, keys = distinct_entries(own)
            counts = [unpacked(r["counts"]) for r in own]
            f = np.zeros(len(next(iter(keys.values()))), np.int64)
            np.add.at(f, at, np.concatenate(counts))
            often = np.flatnonzero(f >= least)
            name = np.full(len(f), -1, np.int64)
            name[often] = (made + np.arange(len(often))) * buckets + bucket
            made += len(often)
            if len(often):
                out.append({"lang": lang, "f": f[often], "id": name[often], **{k: x[often] for k, x in keys.items()}})
            end = 0
            for r, c in zip(own, counts, strict=True) if back else ():
                mine = name[at[end : end + len(c)]]
                end += len(c)
                if len(codes := np.flatnonzero(mine >= 0)):
                    out.append({"block": r["block"], "codes": packed(codes + r["start"] + 1), "names": packed(mine[codes])})
        return pa.Table.from_pylist(out, arrow_schema(NAMED))

    return entries.groupBy("bucket").applyInArrow(run, NAMED)


def adjacent_pairs(codes: np.ndarray, local: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, lefts, rights, counts) of the next level: place i has the pair of the names at i and i + 1, if both have one.

    local, names: the codes that have a name, and their names.
    """
    if not len(local):
        return np.zeros(0, np.int64), *(np.zeros(0, np.int64),) * 3
    order = np.argsort(local, kind="stable")
    dense = np.zeros(max(int(codes.max(initial=0)), int(local.max())) + 1, np.int64)
    dense[local[order]] = np.arange(1, len(order) + 1)
    names = np.concatenate([[0], names[order]])
    at = dense[codes]
    left, right = at[:-1], at[1:]
    both = (left > 0) & (right > 0)
    keys, inverse, counts = np.unique(left[both] * len(names) + right[both], return_inverse=True, return_counts=True)
    lefts, rights = names[keys // len(names)], names[keys % len(names)]
    order = np.argsort(pair_hashes(lefts, rights), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(1, len(order) + 1)
    out = np.zeros(max(0, len(codes) - 1), np.int64)
    out[both] = place[inverse]
    return out, lefts[order], rights[order], counts[order]


def pair_blocks(blocks: DataFrame, named: DataFrame, last: bool) -> DataFrame:
    """The blocks of the next level, from the names that their entries have got."""

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        rows = block.to_pylist()
        if not rows or not known.num_rows:
            return pa.Table.from_pylist([], arrow_schema(BLOCKS))
        local, names = (np.concatenate([unpacked(x.as_py()) for x in known.column(k)]) for k in ("codes", "names"))
        codes, lefts, rights, counts = adjacent_pairs(unpacked(rows[0]["codes"]), local, names)
        return pa.Table.from_pylist([{"block": rows[0]["block"], "lang": rows[0]["lang"], "entries": len(lefts), "codes": None if last else packed(codes), "lefts": packed(lefts), "rights": packed(rights), "counts": packed(counts)}], arrow_schema(BLOCKS))

    left = blocks.select(F.col("block").alias("block"), "lang", "codes")
    right = named.where("block is not null").select(F.col("block").alias("block"), "codes", "names")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, BLOCKS)


def named_entries(blocks: DataFrame, least: int, back: bool, bucket: int) -> DataFrame:
    """counted_buckets of the blocks' entries, with as many buckets as they ask for, as a table."""
    total = blocks.agg(F.sum("entries")).first()[0] or 0
    buckets = 1 + total // bucket
    return written(counted_buckets(dealt(blocks, buckets), buckets, least, back), "names")


def phrase_tables(docs: DataFrame, words: int, least: int, lang: str, text: str, block: int, bucket: int) -> tuple[list[DataFrame], DataFrame]:
    """(tables of the frequent phrases of 1 to words words, (lang, n) of all words).

    A table has lang, id, f, phrase, the last word, the counts of its prefixes and suffixes by rising length, and from
    two words on the ids of its parents, left and right.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("text != ''")
    blocks = written(word_blocks(texts, block), "word_blocks")
    total = written(blocks.groupBy("lang").agg(F.sum("size").alias("n")), "totals")
    none = F.array().cast("array<long>")
    tables: list[DataFrame] = []
    for size in range(1, words + 1):
        named = named_entries(blocks, least, size < words, bucket)
        keys = ["words"] if size == 1 else ["lefts", "rights"]
        entry = named.where("block is null").select("lang", F.inline(F.arrays_zip(*keys, "f", "id")))
        if size == 1:
            found = entry.select("lang", "id", "f", F.col("words").alias("phrase"), F.col("words").alias("last"), none.alias("prefixes"), none.alias("suffixes"))
        else:
            part = lambda side, ends: tables[-1].select(F.col("id").alias(f"{side}s"), F.struct("f", "phrase", "last", ends).alias(side))
            met = entry.join(part("left", "prefixes"), "lefts").join(part("right", "suffixes"), "rights")
            grown = lambda side, ends: F.concat(F.col(f"{side}.{ends}"), F.array(f"{side}.f")).alias(ends)
            found = met.select("lang", "id", "f", F.concat_ws(" ", "left.phrase", "right.last").alias("phrase"), F.col("right.last").alias("last"), grown("left", "prefixes"), grown("right", "suffixes"), F.col("lefts").alias("left"), F.col("rights").alias("right"))
        tables.append(written(found, "phrases"))
        if size < words:
            pairs = written(pair_blocks(blocks, named, size + 1 == words), "pair_blocks")
            discard(blocks)
            blocks = pairs
        discard(named)
    discard(blocks)
    return tables, total


def weakest_cut(a: str = "a", prefixes: str = "prefixes", suffixes: str = "suffixes") -> str:
    """SQL of struct(score, k, l, r) of the cut with the lowest score, then the smallest k, in exact arithmetic.

    Exact while counts are below 10**15.
    """
    wide = "CAST({} AS DECIMAL(18, 0))".format
    score = f"(CAST(1000000 AS DECIMAL(7, 0)) * {wide(a)} * {wide(a)}) div ({wide(f'{prefixes}[k - 1]')} * {wide(f'{suffixes}[size({suffixes}) - k]')})"
    return f"array_min(transform(sequence(1, size({prefixes})), k -> struct({score} AS score, k AS k, {prefixes}[k - 1] AS l, {suffixes}[size({suffixes}) - k] AS r)))"


def first_of_each(rows: DataFrame, order: list, top: int) -> DataFrame:
    """rows with their rank within lang, up to top. A part of each language, by hash, first gives up what it can."""
    part = F.pmod(F.xxhash64("lang", "phrase"), F.lit(PARTS))
    within = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    rows = rows.withColumn("part", part).withColumn("rank", within).where(F.col("rank") <= top).drop("rank", "part")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, words: int = 3, least: int = 10, share: int = 50, top: int = 2000, lang: str = "lang", text: str = "text", block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to words words.

    a, l, r: occurrences of the phrase and of the two parts of its weakest cut; n: of all words; score: floor(1000000 * a *
    a / (l * r)). Phrases that a phrase of one word more holds in share per cent of their places or more are left out: a
    still longer one cannot hold them more often.
    """
    tables, total = phrase_tables(docs, words, least, lang, text, block, bucket)
    found = []
    for at, rows in enumerate(tables[1:], 1):
        rows = rows.withColumnRenamed("f", "a")
        if at + 1 < len(tables):
            above = tables[at + 1]
            above = above.select(F.col("left").alias("id"), "f").union(above.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("held"))
            rows = rows.join(above, "id", "left").where(F.col("held").isNull() | (100 * F.col("held").cast("decimal(20,0)") < share * F.col("a").cast("decimal(20,0)")))
        cut = F.expr(weakest_cut())
        found.append(rows.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = first_of_each(reduce(DataFrame.union, found), order, top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
