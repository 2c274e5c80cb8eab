"""Quality scores from random-indexing word vectors and a small calibrated network (operator 10).

A text is a stream of tokens: runs of letters (lower-cased), of digits (by their number) and of symbols; a word in capitals
and one that repeats the word before are followed by a marker, a token of its own. Each token has a sparse random index
vector, drawn by its hash bucket. A token's context vector is the sum of the index vectors of its neighbours over all documents;
its vector is both, normalised. A document is the mean of its tokens' vectors, and nothing else is put into the
network: two layers in numpy, learned from the labels. Its temperature is fitted on training rows that the
weights have not seen, so that scores are probabilities.

The network learns from at most SAMPLE labelled rows, those of smallest hash of doc_id; context vectors are counted over
every whole text, in whole numbers, so that no order of rows matters, and scoring reads every whole text. Labels, languages,
sources and ids are never inputs of a score. Null and empty texts have the zero vector and get its score. Of rows
that repeat a doc_id one text, that of smallest hash, is learned from; of repeated labels the larger. Without any labelled row every
score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .textbatch import LOWER, grown, mix, pieces, release, table

SAMPLE = 12_000
BUCKETS, DIM = 1 << 14, 128
WINDOW = 2
HIDDEN = 32
#: Context sums of a task are held in so many parts, and pairs of neighbours up to so many before they are summed.
PARTS, PAIRS = 16, 1 << 21
#: Tokens whose vectors are gathered at once; a longer text is cut from its own start on, so that neighbours do not matter.
STRETCH = 1 << 15
#: Kinds of bytes: 0 white space, 1 letters, 2 digits, 3 symbols.
KIND = np.full(256, 3, np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
UPPER = table(range(65, 91))
#: Markers of words in capitals and of repeated words, and what numbers' hashes are made of.
CAPITALS, REPEATED, NUMBER = np.uint64(0xC0FFEE01), np.uint64(0xC0FFEE02), np.uint64(0xC0FFEE03)


def index_entries(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The eight places of each bucket's index vector and their values, +1 or -1; at the same place they add up."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIM, (BUCKETS, 8)), rng.choice([-1, 1], (BUCKETS, 8))


def index_vectors() -> np.ndarray:
    places, values = index_entries()
    out = np.zeros((BUCKETS, DIM), np.int64)
    np.add.at(out, (np.arange(BUCKETS)[:, None], places), values)
    return out


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all rows' tokens in order, offsets of each row's)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    kind = KIND[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    edge[0] = edge[n] = True
    edge[1:n] |= kind[1:] != kind[:-1]
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    some = kind[starts] > 0
    starts, ends = starts[some], ends[some]
    own = kind[starts]
    power, inverse = grown(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * power[:n])])
    size = ends - starts
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + size.astype(np.uint64))
    hashes = np.where(own == 2, mix(NUMBER + size.astype(np.uint64)), hashes)
    upper = np.concatenate([[0], np.cumsum(UPPER[buf])])
    word = own == 1
    capital = word & (size > 1) & ((upper[ends] - upper[starts]) * 2 > size)
    row = np.searchsorted(offs, starts, "right")
    again = np.zeros(len(starts), bool)
    at = np.flatnonzero(word)
    same = (hashes[at[1:]] == hashes[at[:-1]]) & (row[at[1:]] == row[at[:-1]])
    again[at[1:][same]] = True
    place = np.arange(len(starts)) + np.cumsum(capital) + np.cumsum(again) - capital - again
    out = np.empty(len(starts) + int(capital.sum()) + int(again.sum()), np.uint64)
    out[place] = hashes
    out[place[capital] + 1] = mix(np.array([CAPITALS]))[0]
    out[place[again] + 1 + capital[again]] = mix(np.array([REPEATED]))[0]
    counts = np.bincount(row - 1, 1 + capital + again, len(offs) - 1).astype(np.int64) if len(row) else np.zeros(len(offs) - 1, np.int64)
    return (out >> np.uint64(50)).astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


def features(vectors: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The mean of each row's token vectors, the same whatever rows stand beside it."""
    bucket, at = tokens(buf, offs)
    count = np.diff(at)
    per = -(-count // STRETCH)
    row = np.repeat(np.arange(len(count)), per)
    first = at[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * STRETCH
    last = np.minimum(first + STRETCH, at[row + 1])
    out = np.zeros((len(count), DIM), np.float64)
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(last, first[a] + STRETCH, "right")))
        sums = np.add.reduceat(vectors[bucket[first[a] : last[b - 1]]], first[a:b] - first[a], axis=0)
        np.add.at(out, row[a:b], sums)
        a = b
    return (out / np.maximum(1, count)[:, None]).astype(np.float32)


def neighbour_pairs(bucket: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each pair of tokens up to WINDOW apart in a row, both ways."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = []
    for lag in range(1, WINDOW + 1):
        if len(bucket) > lag:
            ok = np.flatnonzero(row[lag:] == row[:-lag])
            out += [bucket[ok] * BUCKETS + bucket[ok + lag], bucket[ok + lag] * BUCKETS + bucket[ok]]
    return np.concatenate([np.zeros(0, np.int32), *out])


def add_pairs(total: np.ndarray, entries: tuple[np.ndarray, np.ndarray], pairs: np.ndarray) -> None:
    """Adds the index vectors of the pairs' second tokens to the rows of their first."""
    key, n = np.unique(pairs, return_counts=True)
    own, other = key // BUCKETS * DIM, key % BUCKETS
    for places, values in zip(entries[0].T, entries[1].T, strict=True):
        total += np.bincount(own + places[other], n * values[other], BUCKETS * DIM).astype(np.int64).reshape(BUCKETS, DIM)


def context_sums(docs: DataFrame, text: str) -> np.ndarray:
    """Each bucket's sum of its neighbours' index vectors over all texts."""
    entries = index_entries()
    rows = BUCKETS // PARTS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, DIM), np.int64)
        held, size = [], 0
        for batch in batches:
            for _, _, buf, offs in pieces(batch.column(0), 1 << 19):
                held.append(neighbour_pairs(*tokens(buf, offs)))
                size += len(held[-1])
                if size >= PAIRS:
                    add_pairs(total, entries, np.concatenate(held))
                    held, size = [], 0
        if held:
            add_pairs(total, entries, np.concatenate(held))
            held = []
        release()
        if total.any():
            own = TaskContext.get().partitionId() % 32
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "own": pa.array([own] * PARTS, pa.int32()), "sums": pa.array([total[i * rows : (i + 1) * rows].tobytes() for i in range(PARTS)], pa.binary())})

    def added(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, np.zeros(rows * DIM, np.int64)
        for batch in group:
            for i, own, x in zip(*(batch.column(c).to_pylist() for c in ("part", "own", "sums")), strict=True):
                key = (i, own)
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0]], pa.int32()), "own": pa.array([key[1]], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "part int, own int, sums binary"
    parts = docs.select(F.col(text).alias("text")).mapInArrow(gather, kind)
    for keys in (("part", "own"), ("part",)):  # a task adds up sums of a thirty-second of all tasks first
        parts = parts.groupBy(*keys).applyInArrow(added, kind)
    out = np.zeros((BUCKETS, DIM), np.float64)
    for r in parts.collect():  # PARTS rows
        out[r["part"] * rows : (r["part"] + 1) * rows] = np.frombuffer(r["sums"], np.int64).reshape(rows, DIM)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Row by row sums, so that a row's logit does not depend on how many rows come with it."""
        a, b, c, d = self.layers
        return (np.einsum("nh,ho->no", np.tanh(np.einsum("nw,wh->nh", self.scaled(x), a) + b), c) + d)[:, 0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = 80) -> Model:
    """Trains on four fifths of the rows and fits the temperature on the others."""
    width = x.shape[1]
    zero = [np.zeros((width, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32), np.zeros((HIDDEN, 1), np.float32), np.zeros(1, np.float32)]
    if not len(y):
        return Model(vectors, np.zeros(width), np.ones(width), zero, 1.0)
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(y))
    cut = max(1, len(y) * 4 // 5)
    fit, held = part[:cut], part[cut:]
    model = Model(vectors, x[fit].mean(0), x[fit].std(0) + 1e-4, [rng.normal(0, width**-0.5, (width, HIDDEN)).astype(np.float32), zero[1], rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)).astype(np.float32), zero[3]], 1.0)
    z = model.scaled(x)
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in model.layers]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for s in range(0, len(order), 128):
            i = order[s : s + 128]
            a, b, c, d = model.layers
            h = np.tanh(z[i] @ a + b)
            g = ((sigmoid((h @ c + d)[:, 0]) - y[i]) / len(i))[:, None].astype(np.float32)
            back = (g @ c.T) * (1 - h * h)
            grads = [z[i].T @ back + 1e-4 * a, back.sum(0), h.T @ g + 1e-4 * c, g.sum(0)]
            step += 1
            for k, grad in enumerate(grads):
                m, v = moment[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                model.layers[k] = model.layers[k] - 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if len(held):
        logits = model.logits(x[held])
        loss = [(-np.log(np.where(y[held] > 0.5, p := sigmoid(logits / t), 1 - p) + 1e-12).mean(), t) for t in np.geomspace(0.25, 8, 61)]
        model.temperature = float(min(loss)[1])
    return model


def training_part(doc_id: Column) -> Column:
    """Whether a row may be learned from: crc32 of its id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns label (0 or 1) from at most sample labelled rows that training_part allows.

    Rows without id, label or a label other than 0 and 1 teach nothing; null texts are empty. See the module for repeated ids.
    """
    spark = docs.sparkSession
    chosen = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = chosen.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & training_part(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, (1.3 * sample + 1000) / max(1, chosen.count()))  # about as many as are wanted come to the sort
    chosen = chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    chosen = chosen.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(sample)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # at most sample pairs of numbers: a bounded broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = written(rows.select("label", "text").repartition(8), "quality")
    unit = lambda x: x / np.maximum(1e-6, np.linalg.norm(x, axis=1, keepdims=True))
    vectors = (0.5 * unit(index_vectors().astype(np.float64)) + unit(context_sums(docs, text))).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in pieces(batch.column("text")):
                x = features(shared.value, buf, offs)
                yield pa.RecordBatch.from_pydict({"label": batch.column("label").slice(a, b - a), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = rows.mapInArrow(pooled, "label int, x binary").collect()
    got.sort(key=lambda r: (r["x"], r["label"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got]) if got else np.zeros((0, DIM), np.float32)
    return fitted(vectors, x, np.array([r["label"] for r in got], np.float64))


def score_quality(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a probability of label 1; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            got = [own.probabilities(features(own.vectors, buf, offs)) for _, _, buf, offs in pieces(texts, 1 << 18)]
            release()
            yield pa.array(np.concatenate([np.zeros(0), *got]), pa.float64())

    return docs.withColumn(out, score(F.col(text)))
