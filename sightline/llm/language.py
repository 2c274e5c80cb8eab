"""Language identification by a linear-chain conditional random field over words (operator 4).

A word's features are itself (lexicon), its first and last one to three bytes (affixes) and its byte trigrams, hashed
into one table of weights per language; languages follow each other with learned transitions. Forward-backward over
stretches of up to STEPS words gives each word's language probabilities, so that code-switched text is labelled word by
word; a text's language is the one with the highest mean.

Training reads at most ROWS rows a language, those of smallest hash, and CHARS characters in all. Each language has an
equal share of these, and what it leaves goes to the others; a share is spent in hash order, and a language whose rows all
exceed it keeps its shortest, so none goes without rows. Training follows the gradient of
the likelihood with the rows' languages as labels; from the second pass on a word that the model holds for another
language by far is relabelled, from which the transitions learn switches.

Null texts and texts without a letter are "und" with score 0; so is everything if no language was learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .textbatch import LOWER, mix, pieces, table, words

ROWS, CHARS = 500, 6_000_000
STEPS = 48
SIZE = 1 << 16
PASSES, BATCH = 4, 400
LETTERS = table([*range(65, 91), *range(97, 123), *range(128, 256)])
ASCII_LETTERS = table([*range(65, 91), *range(97, 123)])


def word_features(buf: np.ndarray, offs: np.ndarray):
    """(rows of words' first features, trigram features by byte, bounds of words' bytes, offsets of rows' words)."""
    starts, ends, hashes, at = words(buf, offs, LETTERS)
    n = len(buf)
    keep = LETTERS[buf]
    clean = np.where(keep, LOWER[buf], 32).astype(np.uint64)
    size = ends - starts
    columns = [(hashes % np.uint64(SIZE)).astype(np.int64)]
    kind = 0
    for forward in (True, False):
        value = np.zeros(len(starts), np.uint64)
        for k in range(3):
            place = starts + k if forward else ends - 1 - k
            value = value * np.uint64(256) + np.where(k < size, clean[np.clip(place, 0, max(0, n - 1))], 0).astype(np.uint64)
            kind += 1
            columns.append(SIZE + (mix(value * np.uint64(16) + np.uint64(kind)) % np.uint64(SIZE)).astype(np.int64))
    before, after = np.empty(n, np.uint64), np.empty(n, np.uint64)
    if n:
        before[0], before[1:] = 32, clean[:-1]
        after[-1], after[:-1] = 32, clean[1:]
        before[offs[:-1][offs[:-1] < n]] = 32
        after[offs[1:][offs[1:] > 0] - 1] = 32
    inside = np.flatnonzero(keep)
    tri = SIZE + (mix(((before[inside] * np.uint64(256) + clean[inside]) * np.uint64(256) + after[inside]) * np.uint64(16)) % np.uint64(SIZE)).astype(np.int64)
    return np.stack(columns, axis=1) if len(starts) else np.zeros((0, 7), np.int64), tri, np.concatenate([[0], np.cumsum(size)]), at


def emissions(weights: np.ndarray, first: np.ndarray, tri: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros((0, weights.shape[1]), np.float32)
    out = np.add.reduceat(weights[tri], bounds[:-1], axis=0)
    for k in range(first.shape[1]):
        out += weights[first[:, k]]
    return out


def stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, number of words) of stretches of up to STEPS words within rows."""
    count = np.diff(at)
    per = -(-count // STEPS)
    row = np.repeat(np.arange(len(count)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    return at[row] + nth * STEPS, np.minimum(STEPS, count[row] - nth * STEPS)


def forward_backward(emit: np.ndarray, first: np.ndarray, size: np.ndarray, move: np.ndarray, begin: np.ndarray, pairs: bool = False):
    """Word probabilities, and the expected transitions and beginnings if pairs is set."""
    n_lang = emit.shape[1]
    out = np.zeros((len(emit), n_lang))
    moves, begins = np.zeros((n_lang, n_lang)), np.zeros(n_lang)
    if not len(first):
        return out, moves, begins
    steps = int(size.max())
    index = np.minimum(first[:, None] + np.arange(steps)[None], len(emit) - 1).T
    valid = (np.arange(steps)[:, None] < size[None])
    e = emit[index].astype(np.float64)
    e = np.where(valid[:, :, None], np.exp(np.clip(e - e.max(2, keepdims=True), -60, 0)), 1.0)
    a = np.exp(move - move.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    start = np.exp(begin - begin.max())
    alpha[0] = start * e[0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, steps):
        x = (alpha[t - 1] @ a) * e[t]
        x /= np.maximum(x.sum(1, keepdims=True), 1e-300)
        alpha[t] = np.where(valid[t][:, None], x, alpha[t - 1])
    for t in range(steps - 2, -1, -1):
        x = (e[t + 1] * beta[t + 1]) @ a.T
        x /= np.maximum(x.sum(1, keepdims=True), 1e-300)
        beta[t] = np.where(valid[t + 1][:, None], x, 1.0)
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(2, keepdims=True), 1e-300)
    out[index[valid]] = gamma[valid]
    if pairs:
        begins = gamma[0].sum(0)
        for t in range(1, steps):
            xi = alpha[t - 1][:, :, None] * a[None] * (e[t] * beta[t])[:, None, :]
            xi /= np.maximum(xi.sum((1, 2), keepdims=True), 1e-300)
            moves += xi[valid[t]].sum(0)
    return out, moves, begins


@dataclass
class Field:
    langs: list[str]
    weights: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def probabilities(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language probabilities of words, offsets of rows' words)."""
        first, tri, bounds, at = word_features(buf, offs)
        return forward_backward(emissions(self.weights, first, tri, bounds), *stretches(at), self.move, self.begin)[0], at


def fitted(rows: list[tuple[str, str]], seed: int = 5) -> Field:
    """From (language, text) rows, by gradient steps with per-weight rates."""
    langs = sorted({x for x, _ in rows})
    n_lang = len(langs)
    field = Field(langs, np.zeros((2 * SIZE, n_lang), np.float32), np.zeros((n_lang, n_lang)), np.zeros(n_lang))
    if n_lang < 2:
        return field
    number = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    batches = []
    for a in range(0, len(order), BATCH // 8):
        own = [rows[i] for i in order[a : a + BATCH // 8]]
        for _, _, buf, offs in pieces(pa.array([t for _, t in own], pa.string()), 1 << 30):
            first, tri, bounds, at = word_features(buf, offs)
            if len(first):
                batches.append((first, tri, bounds, stretches(at), np.repeat([number[x] for x, _ in own], np.diff(at))))
    rate = [np.full(field.weights.shape, 1.0, np.float32), np.full(field.move.shape, 1.0), np.full(n_lang, 1.0)]
    for step in range(PASSES):
        for k, (first, tri, bounds, (s, size), label) in enumerate(batches):
            p, moves, begins = forward_backward(emissions(field.weights, first, tri, bounds), s, size, field.move, field.begin, pairs=True)
            if step == 1:  # words of another language within a row
                best = p.argmax(1)
                label = np.where(p[np.arange(len(p)), best] > 0.9, best, label)
                batches[k] = (first, tri, bounds, (s, size), label)
            g = p.astype(np.float32)
            g[np.arange(len(g)), label] -= 1
            owner = np.repeat(np.arange(len(g)), np.diff(bounds))
            flat = np.concatenate([first.reshape(-1), tri])
            who = np.concatenate([np.repeat(np.arange(len(g)), first.shape[1]), owner])
            grad = np.stack([np.bincount(flat, g[who, j], 2 * SIZE) for j in range(n_lang)], axis=1).astype(np.float32) / 64
            follow = np.ones(len(label), bool)
            follow[s] = False
            later = np.flatnonzero(follow)
            seen = np.bincount(label[later - 1] * n_lang + label[later], minlength=n_lang**2).reshape(n_lang, n_lang)
            gm, gb = (moves - seen) / max(1, len(later)), (begins - np.bincount(label[s], minlength=n_lang)) / max(1, len(s))
            for x, gx, r, speed in ((field.weights, grad, rate[0], 0.3), (field.move, gm, rate[1], 0.5), (field.begin, gb, rate[2], 0.5)):
                r += gx * gx
                x -= (speed * gx / np.sqrt(r)).astype(x.dtype)
    return field


def training_part(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def shares(wanted: dict[str, int], total: int) -> dict[str, int]:
    """Equal parts of total; what a language does not want is dealt to those that want more."""
    out = {}
    for i, (x, n) in enumerate(sorted(wanted.items(), key=lambda w: (w[1], w[0]))):
        out[x] = min(n, total // (len(wanted) - i))
        total -= out[x]
    return out


def train_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS, chars: int = CHARS) -> Field:
    """Learns from rows with a text and a language that training_part allows.

    Of each language the rows of smallest hash of (doc_id, text) are taken, so rows that repeat an id are rows of their own.
    Null and empty texts and null languages teach nothing. Without any row every text is "und".
    """
    spark = docs.sparkSession
    hash_ = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    usable = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(training_part(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("text") != ""))
    counts = usable.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return fitted([])
    # a language's share of hashes lets about as many rows through as are wanted, so that its window is small
    share = spark.createDataFrame([(r["lang"], int(min(1.0, (1.3 * rows + 200) / r["count"]) * (1 << 30))) for r in counts], "lang string, most long")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    few = usable.withColumn("h", hash_).join(F.broadcast(share), "lang").where("h <= most")
    got = written(few.withColumn("place", place).where(F.col("place") <= rows).select("lang", "place", "text", F.length("text").alias("size")), "languages")
    sizes = sorted((r["lang"], r["place"], r["size"]) for r in got.select("lang", "place", "size").collect())
    left: dict[str, int] = {}
    for x, _, n in sizes:
        left[x] = left.get(x, 0) + n
    left = shares(left, chars)
    kept = []
    for x, i, n in sizes:
        if n <= left[x]:
            kept.append((x, i))
            left[x] -= n
    with_rows = {x for x, _ in kept}
    least = {x: (n, i) for x, i, n in sorted(sizes, key=lambda r: (-r[2], -r[1])) if x not in with_rows}
    kept += [(x, i) for x, (_, i) in least.items()]
    # at most rows pairs a language, and chars characters: bounded
    chosen = got.join(F.broadcast(spark.createDataFrame(kept, "lang string, place int")), ["lang", "place"])
    return fitted([(r["lang"], r["text"]) for r in sorted(chosen.select("place", "lang", "text").collect(), key=lambda r: (r["place"], r["lang"]))])


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
SPANS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))


def has_letter(raw: np.ndarray) -> bool:
    return bool(ASCII_LETTERS[raw].any()) or any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def label_languages(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the mean probability of that language; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf(RESULT)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            names, scores = [], []
            for a, b, buf, offs in pieces(texts):
                p, at = own.probabilities(buf, offs) if own.langs else (np.zeros((0, 0)), np.zeros(b - a + 1, np.int64))
                total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
                for i in range(b - a):
                    n = int(at[i + 1] - at[i])
                    if n and has_letter(buf[offs[i] : offs[i + 1]]):
                        mean = (total[at[i + 1]] - total[at[i]]) / n
                        best = int(mean.argmax())
                        names.append(own.langs[best])
                        scores.append(min(1.0, max(0.0, float(mean[best]))))
                    else:
                        names.append("und")
                        scores.append(0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    rest = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.select(*[docs[c] for c in rest], label(docs[text]).alias("__label")).select(*[F.col(f"`{c}`") for c in rest], "__label.lang_pred", "__label.score")


def label_words(docs: DataFrame, field: Field, text: str = "text", out: str = "word_langs") -> DataFrame:
    """docs with an array of (word, lang, score) of each text's words in order."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf(SPANS)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            rows = []
            for a, b, buf, offs in pieces(texts):
                p, at = own.probabilities(buf, offs) if own.langs else (np.zeros((0, 0)), np.zeros(b - a + 1, np.int64))
                starts, ends, _, _ = words(buf, offs, LETTERS)
                raw = buf.tobytes()
                best = p.argmax(1) if len(p) else []
                for i in range(b - a):
                    rows.append([{"word": raw[starts[w] : ends[w]].decode("utf-8", "replace"), "lang": own.langs[best[w]], "score": float(p[w, best[w]])} for w in range(at[i], at[i + 1])])
            yield pa.array(rows, kind)

    return docs.withColumn(out, label(F.col(text)))
