"""Language identification as a mixture of languages.

Training counts hashed byte n-grams of every training text by language. For each document,
expectation-maximisation estimates what share of its n-grams each language wrote. The set of
languages is selected by penalised likelihood: starting from all, the least language is left
out as long as the loss of log-likelihood stays under half a logarithm of the document's length
a language (overlapping n-grams count once per n bytes). The largest share names the document.

Null texts and texts without a letter get ``und`` with score 0. Rows without a language teach
nothing; where no row teaches, every text is ``und``. Ties go to the language first in order.
Repeated rows give repeated results. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import held_out, rows_of, slices, table

NGRAM, BUCKETS = 4, 1 << 13
#: A model holds BUCKETS numbers a language, so this bounds what is sent to the tasks (16 MB).
MOST_LANGUAGES = 512
UNDETERMINED = "und"
#: Bytes that are no letters become spaces; bytes of other characters stay.
_LETTERS_ONLY = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def hashed_ngrams(text: str) -> np.ndarray:
    """The bucket of each n-gram of the lower-cased letters, runs of anything else being one space."""
    raw = b" ".join((" " + text.lower() + " ").encode().translate(_LETTERS_ONLY).split())
    b = np.frombuffer(b"  " + raw + b" ", dtype=np.uint8).astype(np.uint32)
    if len(b) < NGRAM:
        return np.zeros(0, dtype=np.int64)
    n = len(b) - NGRAM + 1
    gram = b[:n] | b[1 : n + 1] << 8 | b[2 : n + 2] << 16 | b[3 : n + 3] << 24
    return (gram * np.uint32(2654435761) >> np.uint32(19)).astype(np.int64)


def _expect(p: np.ndarray, c: np.ndarray, rounds: int = 40, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """Shares of the languages (rows of ``p``) and the log-likelihood of the counts ``c``."""
    total = c.sum()
    share = np.full(len(p), 1 / len(p))
    if len(p) > 1:
        for _ in range(rounds):
            old, share = share, share * (p @ (c / (share @ p))) / total
            if np.abs(share - old).max() < close:
                break
    return share, float(c @ np.log(share @ p))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: Probability of each bucket by language.
    table: np.ndarray

    def proportions(self, text: str) -> dict[str, float]:
        """Shares by language, for the selected languages alone; empty if undetermined."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return {}
        at, c = np.unique(hashed_ngrams(text), return_counts=True)
        c = c.astype(np.float64)
        p, keep = self.table[:, at], np.arange(len(self.languages))
        share, fit = _expect(p, c)
        if (share < 1e-3).any():  # far from any use: leave these out at once
            keep = np.flatnonzero(share >= 1e-3)
            share, fit = _expect(p[keep], c)
        penalty = 0.5 * np.log(max(c.sum() / NGRAM, 2))
        while len(keep) > 1:
            fewer = np.delete(keep, share.argmin())
            other, worse = _expect(p[fewer], c)
            if (fit - worse) / NGRAM > penalty:
                break
            keep, share, fit = fewer, other, worse
        return {self.languages[k]: float(s) for k, s in zip(keep, share)}

    def predict(self, text: str) -> tuple[str, float]:
        shares = self.proportions(text)
        if not shares:
            return UNDETERMINED, 0.0
        best = max(shares, key=lambda k: (shares[k], -self.languages.index(k)))
        return best, min(1.0, shares[best])


def train(rows: DataFrame) -> Model:
    """From columns text and lang: the counts of all rows, smoothed."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for piece, texts in slices(batches):
            for lang, text in zip(piece.column("lang").to_pylist(), texts):
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS, dtype=np.int64)
                seen[lang] += np.bincount(hashed_ngrams(text), minlength=BUCKETS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield rows_of(schema, lang=[lang] * len(at), bucket=at, n=n[at])

    counts = rows.where("lang is not null and text is not null").select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    total = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(total.column("lang").to_pylist()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a model holds {MOST_LANGUAGES}")
    place = {k: i for i, k in enumerate(languages)}
    n = np.full((len(languages), BUCKETS), 0.5)
    np.add.at(n, ([place[k] for k in total.column("lang").to_pylist()], total.column("bucket").to_numpy()), total.column("n").to_numpy())
    return Model(tuple(languages), n / n.sum(1, keepdims=True))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"))).select("text", "lang")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and proportions (of the selected languages) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("proportions", pa.map_(pa.string(), pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            shares = [model.proportions(t) for t in texts]
            best = [max(s, key=lambda k: (s[k], -model.languages.index(k))) if s else UNDETERMINED for s in shares]
            yield rows_of(schema, doc_id=piece.column("doc_id"), lang_pred=best, score=[min(1.0, s.get(b, 0.0)) for s, b in zip(shares, best)], proportions=[list(s.items()) for s in shares])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, proportions map<string,double>")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.34) -> DataFrame:
    """The rows, with all their columns, whose largest language share is ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            found = [model.predict(t) for t in texts]
            yield piece.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found]))

    return docs.mapInArrow(run, docs.schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(training_rows(docs)))
    return found.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", F.size("proportions").cast("long").alias("n_languages"))
