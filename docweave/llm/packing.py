"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces of ``max_length`` and then by the binary digits
of what remains, so every piece has a power of two as length and is a sequence of its own:
no sequence crosses documents and none needs padding. Pieces of equal length share a
bucket, and the ids of a bucket's sequences lie together. Where the documents have a position (that of a
mixture), the sequences of every bucket are numbered in its order.

Null text is the empty text (the end id alone). Special-token strings inside a text are
ordinary text. Repeated rows and repeated ids give sequences of their own. An empty table
gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm.common import rows_of, slices, table
from docweave.llm.wordcodes import WordCodes

MAX_LENGTH = 4096
END_ID = 2
#: Positions whose pieces of one length are numbered together.
POSITIONS_PER_RUN = 4096
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])


#: Words of letters that stay single letters under the tokenizer's normalisation: one token run each.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from 256 on, in order.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
_AS_WRITTEN = {b: chr(256 + i) for i, b in enumerate(_OTHERS)}


def word_encoder(path: str):
    """An encoder for WordCodes: plain words go to the model at once, others through the whole tokenizer."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    merge = tokenizer.model.tokenize

    def ids_of(word: bytes) -> list[int]:
        if word.isalpha():  # ASCII letters alone
            return [t.id for t in merge(word.lower().decode())]
        text = word.decode()
        low = text.lower()
        if not _LETTERS.fullmatch(low):
            return tokenizer.encode(text, add_special_tokens=False).ids
        return [t.id for t in merge(low.encode().decode("latin-1").translate(_AS_WRITTEN))]

    def run(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = [ids_of(w) for w in words]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        return np.fromiter(chain.from_iterable(coded), dtype=np.int32, count=int(sizes.sum())), sizes

    return run


def by_words(path: str) -> bool:
    """Whether a tokenizer's ids of a text are those of its words in lower case, one after another, with the marks behind a word by themselves."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    same = ids("The ÉTÉ\n\tof  x1 ") == ids("the été of x1") == ids("the") + ids("été") + ids("of") + ids("x1")
    return same and ids("word.") == ids("word") + ids(".") and ids("été!!") == ids("été") + ids("!!")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_lengths(n: int, max_length: int = MAX_LENGTH) -> list[int]:
    """Full pieces first, then the binary digits of the rest from the highest."""
    full, rest = divmod(n, max_length)
    return [max_length] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def cut_documents(docs: DataFrame, vocabulary: str | None = None, max_length: int = MAX_LENGTH, end_id: int = END_ID, position: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, and ``position`` if it names a column of whole numbers.

    ``max_length`` must be a power of two. ``vocabulary`` is the file's path, the same on every executor;
    by default each executor's own copy of the public file is taken.
    """
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    extra = [position] if position else []
    schema = pa.schema([*PIECES, *[(c, pa.int64()) for c in extra]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or default_vocabulary()
        if by_words(path):
            cache = WordCodes(word_encoder(path), split_endings=True)
        else:
            from tokenizers import Tokenizer

            cache, tokenizer = None, Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
        for piece, texts in slices(batches):
            if cache is None:
                whole = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
                ids, ends = np.fromiter(chain.from_iterable(whole), dtype=np.int64), np.cumsum(list(map(len, whole)))
            else:
                words = [t.encode().lower().split() for t in texts]  # the tokenizer lower-cases anyway
                counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                ids, sizes = cache.ids(cache.codes([w for ws in words for w in ws]))
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
            out: dict[str, list] = {k: [] for k in schema.names}
            begin = 0
            for doc_id, end, *at in zip(piece.column("doc_id").to_pylist(), ends.tolist(), *[piece.column(c).to_pylist() for c in extra]):
                own = np.append(ids[begin:end], end_id).astype("<u4").tobytes()
                begin, start, total = end, 0, len(own) // 4
                for length in piece_lengths(total, max_length):
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids"].append(own[4 * start : 4 * (start + length)])
                    out["doc_tokens"].append(total)
                    for c, x in zip(extra, at):
                        out[c].append(x)
                    start += length
            yield rows_of(schema, **out)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).cast("long").alias(c) for c in extra])
    return read.mapInArrow(cut, ", ".join(["doc_id long, start long, length long, ids binary, doc_tokens long", *[f"`{c}` long" for c in extra]]))


def bucket_sequences(pieces: DataFrame, salts: int = 4096, position: str | None = None) -> DataFrame:
    """Give every piece a sequence of its own, numbered inside its length bucket.

    ``sequence_id`` = log2(length) * 2^58 + salt * 2^38 + number. The salt is a hash of the document,
    so a length that a third of all pieces have is numbered by many tasks. Every piece fills its
    sequence from offset 0. With ``position`` (0 to 2^44 - 1; the column is left out of the result) the
    salt is the run of positions instead, in units of 2^26, so ids of a bucket rise with the position.
    """
    salt = F.expr(f"`{position}` div {POSITIONS_PER_RUN}") if position else F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts))
    bucket = F.round(F.log2("length")).cast("long")
    order = Window.partitionBy("__bucket", "__salt").orderBy(*[position] if position else [], "doc_id", "start", "doc_tokens", *[c for c in ("ids_crc32",) if c in pieces.columns])
    marked = pieces.withColumns({"__bucket": bucket, "__salt": salt}).withColumn("__n", F.row_number().over(order))
    number = F.shiftleft(F.col("__bucket"), 58) + F.shiftleft(F.col("__salt").cast("long"), 26 if position else 38) + F.col("__n")
    return marked.withColumns({"sequence_id": number, "offset": F.lit(0).cast("long")}).drop("__bucket", "__salt", "__n", *[position] if position else [])


def pack(docs: DataFrame, position: str | None = None, **options) -> DataFrame:
    """Pieces of all documents with their ids and sequences."""
    return bucket_sequences(cut_documents(docs, position=position, **options).withColumn("ids_crc32", F.crc32("ids")), position=position)


def digest(docs: DataFrame, position: str | None = None, **options) -> DataFrame:
    """As ``pack``, with the checksum of each piece's ids in place of the ids."""
    pieces = cut_documents(docs, position=position, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", *[position] if position else [])
    return bucket_sequences(pieces, position=position)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
