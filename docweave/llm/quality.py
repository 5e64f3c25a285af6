"""A quality classifier: random-indexing word vectors, pooled by document, then a two-layer network.

1. Words are runs of letters, digits and other non-ASCII bytes, in lower case, and runs of other marks. Case and repetition are words of
   their own in front of a word, as in common preprocessing: one says that it was written in capitals, one that it began with one,
   one that it equals one of the six words before it. Every word is hashed to a bucket, which owns a sparse ternary index
   vector; its vector is that with the sum, at unit length, of those of the words within two places of it over all documents.
2. A document is the mean of its words' vectors.
3. A network of one hidden layer, written in numpy, learns the labels of a bounded sample of
   training rows; a temperature, fitted on rows it has not seen, calibrates its probabilities.

Null and empty texts have zero vectors and are scored as such. Null labels teach nothing; an id
with several labels counts with their largest. Without labels every score is 0.5; with one kind
of label, every score is that kind's smoothed share. Repeated rows give repeated results. Other
columns of the input are ignored. Long texts are read in parts of about STEP bytes, cut at white space; no context reaches
across a cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import held_out, rows_of, slices, table

BUCKET_BITS, DIMENSIONS, NONZERO, REACH = 14, 64, 2, 2
BUCKETS = 1 << BUCKET_BITS
#: The words for what stands before another word: rows behind the buckets.
AGAIN, CAPITALS, CAPITAL = range(BUCKETS, BUCKETS + 3)
ROWS = BUCKETS + 3
#: Words back to which a repetition is told.
REPEAT_REACH = 6
#: Labelled documents that the network learns from: that many are expected of more.
MOST_LABELLED = 20_000
#: Bytes that one step of the vectorised loop handles.
STEP = 1_000_000

_SPACE, _WORD, _MARK = 0, 1, 2
_CLASS = np.full(256, _MARK, dtype=np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[b for b in range(128) if chr(b).isalnum()] + list(range(128, 256))] = _WORD
_CUT = re.compile(rb"[ \t\n\v\f\r]")
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each row: NONZERO places and their signs, from a fixed seed."""
    rng = np.random.default_rng(7)
    places = np.argsort(rng.random((ROWS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], size=(ROWS, NONZERO))


def parts_of(raw: bytes, step: int | None = None) -> Iterator[bytes]:
    """``raw`` in parts that end at the first white space behind every ``step`` bytes."""
    step, begin = step or STEP, 0
    while len(raw) - begin > step:
        found = _CUT.search(raw, begin + step)
        end = found.end() if found else len(raw)
        yield raw[begin:end]
        begin = end
    yield raw[begin:]


def stepped(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, parts) of about STEP bytes together."""
    owners: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for part in parts_of(text.encode()):
            if parts and size + len(part) > STEP:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The row of each word of all parts, with the words before words, and the number of words of each part."""
    b = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    kind = _CLASS[b]
    edge = np.flatnonzero(np.diff(kind)) + 1
    begins = np.concatenate([[0], edge]) if len(b) else np.zeros(0, dtype=np.int64)
    ends = np.concatenate([edge, [len(b)]]) if len(b) else begins
    real = kind[begins] != _SPACE
    begins, ends = begins[real], ends[real]
    latin = np.zeros(len(b), dtype=bool)  # the second bytes of Latin-1 letters
    latin[1:] = b[:-1] == 0xC3
    upper = (b >= 65) & (b <= 90) | latin & (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
    lower = (b >= 97) & (b <= 122) | latin & (b >= 0xA0) & (b != 0xB7)
    low = b + 32 * upper.astype(np.uint8)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(b) + 1, _BASE, dtype=np.uint64))
        inverse = np.cumprod(np.full(len(b) + 1, _INVERSE, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        hashes = (sums[ends] - sums[begins]) * inverse[begins]
        hashes = (hashes ^ hashes >> np.uint64(31)) * _BASE
    n_upper, n_lower = (np.diff(np.concatenate([[0], np.cumsum(of)])[np.stack([begins, ends])], axis=0)[0] for of in (upper, lower))
    capitals = (n_upper > 1) & (n_lower == 0)
    capital = (n_upper > 0) & ~capitals
    last = np.cumsum([len(r) + 1 for r in raw])
    per = np.diff(np.searchsorted(begins, np.concatenate([[0], last])))
    place = np.arange(len(begins)) - np.repeat(np.cumsum(per) - per, per)
    again = np.zeros(len(begins), dtype=bool)
    for k in range(1, REPEAT_REACH + 1):
        again[k:] |= (hashes[k:] == hashes[:-k]) & (place[k:] >= k)
    size = 1 + again.astype(np.int64) + capitals + capital
    at = np.cumsum(size) - 1  # of the words themselves; what stands before them fills the places in front
    out = np.empty(int(size.sum()), dtype=np.int64)
    out[at] = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    out[at[capitals] - 1], out[at[capital] - 1] = CAPITALS, CAPITAL
    out[(at - size + 1)[again]] = AGAIN
    ahead = np.concatenate([[0], np.cumsum(size)])
    upto = np.cumsum(per)
    return out, ahead[upto] - ahead[upto - per]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Shape (ROWS, DIMENSIONS): the context sums over all texts, at unit length, and the index vectors."""
    schema = pa.schema([("row", pa.int64()), ("sums", pa.list_(pa.int64()))])
    places, signs = index_vectors()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(ROWS * DIMENSIONS)
        for _, texts in slices(batches, step=STEP):
            for _, parts in stepped(texts):
                rows, per = tokens(parts)
                owner = np.repeat(np.arange(len(per)), per)
                for reach in range(1, REACH + 1):
                    same = owner[reach:] == owner[:-reach]
                    for of, by in ((slice(None, -reach), slice(reach, None)), (slice(reach, None), slice(None, -reach))):
                        here, other = rows[of][same], rows[by][same]
                        for k in range(NONZERO):
                            sums += np.bincount(here * DIMENSIONS + places[other, k], signs[other, k], minlength=len(sums))
        whole = sums.astype(np.int64).reshape(-1, DIMENSIONS)
        at = np.flatnonzero(whole.any(1))
        if len(at):
            yield rows_of(schema, row=at, sums=list(whole[at]))

    counted = docs.select("text").mapInArrow(count, "row long, sums array<long>")
    total = counted.groupBy("row").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(DIMENSIONS)]).alias("sums")).toArrow()
    out = np.zeros((ROWS, DIMENSIONS))
    if total.num_rows:
        out[total.column("row").to_numpy()] = total.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    for k in range(NONZERO):
        out[np.arange(len(out)), places[:, k]] += signs[:, k]
    return out.astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Shape (texts, DIMENSIONS): the mean vector of each text's words."""
    sums, n = np.zeros((len(texts), DIMENSIONS)), np.zeros(len(texts))
    for owners, parts in stepped(texts):
        rows, per = tokens(parts)
        full = np.flatnonzero(per)
        if len(full):
            begins = (np.cumsum(per) - per)[full]
            for lo in range(0, len(full), 256):  # some parts at a time, so that few vectors lie side by side
                hi = min(lo + 256, len(full))
                end = begins[hi] if hi < len(full) else len(rows)
                np.add.at(sums, np.array(owners)[full[lo:hi]], np.add.reduceat(vectors[rows[begins[lo] : end]], begins[lo:hi] - begins[lo], axis=0))
        np.add.at(n, owners, per)
    return (sums / np.maximum(n, 1)[:, None]).astype(np.float32)


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    #: The score where there was nothing to learn, else None.
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_temperature(logits: np.ndarray, y: np.ndarray, coldest: float = 1e-3, hottest: float = 1e3) -> float:
    """The temperature of least loss on rows that the network has not seen, to 12 digits.

    The loss is convex in the inverse temperature, so its slope is halved in. Labels count as one label of the other kind more among all
    would have them, for rows that the logits tell apart without an error have no best temperature else.
    """
    ones = y.sum()
    target = np.where(y > 0.5, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    low, high = 1 / hottest, 1 / coldest
    for _ in range(60):
        inverse = np.sqrt(low * high)
        slope = ((1 / (1 + np.exp(-np.clip(inverse * logits, -500, 500))) - target) * logits).sum()
        low, high = (low, inverse) if slope > 0 else (inverse, high)
    return float(1 / np.sqrt(low * high))


def learn(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4) -> Network:
    """Adam over mini-batches; one row in five is kept back for the temperature."""
    none = np.zeros(0)
    if len(set(y.tolist())) < 2:
        return Network(none, none, none, none, none, 0.0, 1.0, (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5)
    rng = np.random.default_rng(11)
    order = rng.permutation(len(x))
    x, y = x[order].astype(np.float64), y[order].astype(np.float64)
    back = max(1, len(x) // 5)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / spread
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        shuffled = back + rng.permutation(len(x) - back) if len(x) > back else np.arange(len(x))
        for lo in range(0, len(shuffled), 256):
            at = shuffled[lo : lo + 256]
            inner = np.tanh(z[at] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(inner @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
            through = np.outer(error, p[2]) * (1 - inner**2)
            grads = [z[at].T @ through + decay * p[0], through.sum(0), inner.T @ error + decay * p[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    raw = np.tanh(z[:back] @ p[0] + p[1]) @ p[2] + p[3]
    return Network(mean, spread, p[0], p[1], p[2], float(p[3][0]), fit_temperature(raw, y[:back]))


@dataclass(frozen=True)
class Classifier:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.network.scores(pooled(texts, self.vectors))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labelled: int = MOST_LABELLED) -> Classifier:
    """Vectors of all documents; the network from about ``most_labelled`` of the labelled ones, picked by a hash of their ids."""
    vectors = word_vectors(docs)
    rows = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    share = min(1.0, most_labelled / max(rows.count(), 1))
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    schema = pa.schema([("x", pa.list_(pa.float32())), ("y", pa.float64())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, step=STEP):
            yield rows_of(schema, x=list(pooled(texts, vectors)), y=piece.column("y"))

    # about 16 bytes a row and most_labelled rows: small by its definition
    learnt = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "y").mapInArrow(features, "x array<float>, y double").toArrow()
    x = learnt.column("x").combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS) if learnt.num_rows else np.zeros((0, DIMENSIONS))
    y = learnt.column("y").to_numpy()
    order = np.lexsort((*x.T[:4], y))  # the same network whatever order the rows came in
    return Classifier(vectors, learn(x[order], y[order]))


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id and score of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, step=STEP):
            yield rows_of(schema, doc_id=piece.column("doc_id"), score=classifier.scores(texts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
