"""Token ids in bit- or byte-plane files (operator 9).

A file is a magic number, chunks, an index and a trailer. A chunk holds up to CHUNK ids as little-endian unsigned 32-bit
integers, transposed into 4 byte planes or 32 bit planes, each compressed with zstandard by itself: the high planes of
ids are almost constant and shrink to nothing. The index, compressed too, lists for each chunk its place, count and
planes' sizes, and for each document its id and number of ids; the trailer holds the index's length and the magic number.

Texts are dealt by ranges of (doc_id, hash of text), so that files in their order, and documents within, ascend by
doc_id; documents that repeat an id are ordered by their text. A file is named after the task attempt that wrote it, and
only files named by the attempts that succeeded are read, so lost executors leave at most files that nobody reads.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_folder
from .tokens import Cutter, text_runs

#: Pieces that a worker keeps.
PIECES = 1_200_000
MAGIC = b"PLANES1\n"
CHUNK = 1 << 16


def file_system(uri: str):
    """(file system, path) of a uri; plain paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (fs.LocalFileSystem(), uri)


def planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The transposed planes of up to CHUNK ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, i].tobytes() for i in range(4)]
    one = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(one[:, i], bitorder="little").tobytes() for i in range(32)]


def unplaned(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        return np.stack([np.frombuffer(x, np.uint8) for x in parts], axis=1).reshape(-1).view("<u4") if n else np.zeros(0, "<u4")
    one = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little") for x in parts], axis=1)
    return np.packbits(one, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    def __init__(self, out, bits: bool, level: int = 3):
        self.out, self.bits, self.zip = out, bits, zstandard.ZstdCompressor(level=level)
        self.rest: list[np.ndarray] = []
        self.held, self.at, self.chunks = 0, len(MAGIC), []
        self.doc_ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.total = 0
        out.write(MAGIC)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.counts.append(counts)
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= CHUNK:
            ready = np.concatenate(self.rest)
            full = len(ready) // CHUNK * CHUNK
            for a in range(0, full, CHUNK):
                self.chunk(ready[a : a + CHUNK])
            self.rest, self.held = [ready[full:]], len(ready) - full

    def chunk(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(x) for x in planes(ids, self.bits)]
        self.chunks.append([self.at, len(ids), *map(len, packed)])
        for x in packed:
            self.out.write(x)
            self.at += len(x)

    def close(self) -> None:
        if self.held:
            self.chunk(np.concatenate(self.rest))
        docs = pa.table({"doc_id": pa.chunked_array(self.doc_ids, pa.int64()), "n": pa.array(np.concatenate([np.zeros(0, np.int64), *self.counts]))})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as w:
            w.write_table(docs)
        head = self.zip.compress(json.dumps({"bits": self.bits, "chunks": self.chunks}).encode())
        body = self.zip.compress(sink.getvalue().to_pybytes())
        self.out.write(head + body + struct.pack("<QQ", len(head), len(body)) + MAGIC)


class PlaneReader:
    """Reads one file by its index."""

    def __init__(self, f):
        self.f, self.unzip = f, zstandard.ZstdDecompressor()
        tail = 16 + len(MAGIC)
        f.seek(f.size() - tail)
        end = f.read(tail)
        if end[16:] != MAGIC:
            raise ValueError("not a file of token planes, or cut short")
        head, body = struct.unpack("<QQ", end[:16])
        f.seek(f.size() - tail - head - body)
        self.chunks = json.loads(self.unzip.decompress(f.read(head)))["chunks"]
        self.docs = pa.ipc.open_stream(self.unzip.decompress(f.read(body))).read_all()

    def chunk(self, i: int) -> np.ndarray:
        at, n, *sizes = self.chunks[i]
        self.f.seek(at)
        return unplaned([self.unzip.decompress(self.f.read(x), max_output_size=4 * CHUNK) for x in sizes], n)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, number of ids of all documents before it in the file, its ids)."""
        held, i, start = np.zeros(0, "<u4"), 0, 0
        for doc_id, n in zip(self.docs["doc_id"].to_pylist(), self.docs["n"].to_pylist(), strict=True):
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    parts.append(self.chunk(i))
                    have += len(parts[-1])
                    i += 1
                held = np.concatenate(parts)
            yield doc_id, start, held[:n]
            held, start = held[n:], start + n


@lru_cache(maxsize=2)
def library_cutter(path: str, end: int | None = None) -> Cutter:
    """The tokenizers library, asked once for each distinct piece between spaces where no token can span.

    New pieces are joined to texts again, as they would stand; a piece's ids are those whose bytes are its own. A worker
    process keeps what it has met from task to task.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    lengths = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for name, i in tokenizer.get_vocab().items():  # a symbol stands for a byte
        lengths[i] = len(name)

    def encode(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        alone = np.fromiter((x[0] != " " or x[1:2].isspace() or x[-1].isspace() for x in new), bool, len(new))
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
        n = len(new) - int(alone.sum())
        names = [new[i] for i in order.tolist()]
        texts = ["".join(names[a : min(a + 2000, n)]) for a in range(0, n, 2000)] + names[n:]
        ids = np.concatenate([np.zeros(0, np.int64), *(np.array(x.ids, np.int64) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        # where each piece ends in bytes, and so in ids
        ends = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum([len(x.encode()) for x in names])) + 1
        sizes = np.empty(len(new), np.int64)
        sizes[order] = np.diff(ends, prepend=0)
        starts = np.empty(len(new), np.int64)
        starts[order] = ends - sizes[order]
        at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        return ids[at], sizes

    return Cutter(encode, added, end, PIECES)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, bits: bool = False) -> list[dict]:
    """Writes each text's ids and end_id to files in ascending doc_id order; returns one entry per file, in order.

    An entry has file, start (ids in all files before), n_ids and n_docs. Null is the empty text; a null doc_id comes
    first; an empty table gives no file. Columns other than the two named are not read.
    """
    folder = folder or fresh_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = F.xxhash64("text")
    dealt = rows.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, writer, n_docs = TaskContext.get(), None, None, 0
        cutter = None
        for batch in batches:
            if writer is None:
                fs, path = file_system(folder)
                fs.create_dir(path, recursive=True)
                name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.planes"
                out = fs.open_output_stream(f"{path}/{name}")
                writer = PlaneWriter(out, bits)
                cutter = library_cutter(tokenizer_path, end_id)
            a = 0
            for part in text_runs(batch.column("text"), 1 << 22):
                ids, offs = cutter.encode(part)
                writer.add(batch.column("doc_id").slice(a, len(part)), ids.astype(np.uint32), np.diff(offs))
                a += len(part)
            n_docs += len(batch)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "file": [name], "n_ids": pa.array([writer.total], pa.int64()), "n_docs": pa.array([n_docs], pa.int64())})

    found = sorted((r.asDict() for r in dealt.mapInArrow(write, "part long, file string, n_ids long, n_docs long").collect()), key=lambda r: r["part"])
    start, out = 0, []
    for r in found:
        out.append({"file": f"{folder.rstrip('/')}/{r['file']}", "start": start, "n_ids": r["n_ids"], "n_docs": r["n_docs"]})
        start += r["n_ids"]
    return out


def read_token_files(spark: SparkSession, files: list[dict], digests: bool = False) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, and their ids or, with digests, ids_crc32."""
    kind = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = file_system(r["file"])
                with fs.open_input_file(path) as f:
                    rows: list[tuple] = []
                    held = 0
                    for doc_id, start, ids in PlaneReader(f).documents():
                        rows.append((doc_id, r["start"] + start, len(ids), zlib.crc32(ids.tobytes()) if digests else ids.tolist()))
                        held += 1 if digests else len(ids)
                        if held >= 1 << 18 or len(rows) >= 50_000:
                            yield packed(rows)
                            rows, held = [], 0
                    if rows:
                        yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64() if digests else pa.list_(pa.int64()))], names=["doc_id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    if not files:
        return spark.createDataFrame([], kind)
    listed = spark.createDataFrame([(r["file"], r["start"]) for r in files], "file string, start long").repartition(len(files))
    return listed.mapInArrow(read, kind)
