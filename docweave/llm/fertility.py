"""Quality rules from public tokenizers' fertility.

Two public vocabularies, one with byte fallback (piece) and one on bytes (byte), encode each whole text, white space included, and
measure characters per token, the share of tokens that are bytes of a character (byte fallback) and the entropy of the tokens:
its mean over runs of 256 tokens, as a share of that of as many distinct ones, so that it does not depend on a text's length.
Bands per script reject texts outside them. Bands are measured over all documents that pass the base rules: a script's
quartiles, less or more three times the distance between them. A script of few documents has no bands. Base measures
(words, word characters, symbols, repeated lines and repeated eight-word windows) come with them.

Words are the runs of other characters than ASCII white space. Null is the empty text: no words,
base_failed. Repeated rows give repeated results. Other columns of the input are ignored by
``measure``; ``keep_good`` returns them all, whatever their names.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import cut_lineage, fresh_name, rows_of, slices, table
from docweave.llm.wordcodes import WordCodes

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
#: Tokens of a run whose entropy is taken.
RUN = 256
#: Distances between the quartiles that a band reaches beyond them, and documents that a script's bands need.
REACH, LEAST_DOCS = 3.0, 50
#: Measures with bands, and the least that counts as the distance between their quartiles.
BANDED = {"chars_per_token": 0.25, "byte_share": 0.05, "entropy_share": 0.05}
VOCABULARIES = ("piece", "byte")
#: Bytes of text, or of a part of a long text, that are looked up at a time, and words and cells that a task remembers.
PIECE_BYTES, STEP, MOST_REMEMBERED = 2_000_000, 1_500_000, 200_000
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A run of white space with the word behind it. No token of either vocabulary reaches from a word into the white space behind it ...
_CELL = re.compile(rb"[ \n]*[^ \n]+|[ \n]+")
#: ... but for texts with these characters, which are encoded whole: other white space (the byte vocabulary's pattern has Unicode's), NUL and
#: the piece vocabulary's own mark of a space.
_ODD_ASCII = re.compile(rb"[\0\t\v\f\r]")
_ODD = re.compile(rb"[\0\t\v\f\r]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f|\x96\x81)|\xe3\x80\x80")


@lru_cache(4)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(4)
def byte_model(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def script_of(text: str) -> str:
    """The script of most letters among its distinct characters weighed by use; the first in order on a tie."""
    if text.isascii():
        return "LATIN" if re.search("[A-Za-z]", text) else ""
    found: Counter[str] = Counter()
    for ch, n in Counter(text).items():
        if ch.isalpha():
            found[unicodedata.name(ch, "?").split(" ")[0].split("-")[0]] += n
    return min(found, key=lambda k: (-found[k], k)) if found else ""


def repeated_words(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, their first occurrence included."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    mixed = codes.astype(np.uint64)
    hashes = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        mixed = (mixed + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        for k in range(window):
            hashes = (hashes + mixed[k : k + n]) * _MIX
            hashes ^= hashes >> np.uint64(32)
    order = np.sort(hashes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(hashes, twice))
    _, which, many = np.unique(np.lib.stride_tricks.sliding_window_view(codes, window)[at], axis=0, return_inverse=True, return_counts=True)
    at = at[many[which.ravel()] > 1]  # the words themselves decide, not their hash
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def run_entropy(ids: np.ndarray, run: int = RUN) -> float:
    """The mean over runs of ``run`` tokens of their entropy as a share of that of as many distinct tokens; runs count by their length."""
    n = len(ids)
    if n < 2:
        return 0.0
    keys, counts = np.unique(np.arange(n) // run * (1 << 32) + ids, return_counts=True)
    owner = keys >> 32
    size = np.bincount(owner, counts)
    # the entropy of a run of s tokens is log2 s less the mean of log2 of each token's count
    share = 1 - np.bincount(owner, counts * np.log2(counts)) / size / np.log2(np.maximum(size, 2))
    real = size > 1
    return float((share * size)[real].sum() / size[real].sum())


COLUMNS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("script", pa.string()),
    *((f"{m}_{v}", pa.int64() if m == "n_tokens" else pa.float64()) for v in VOCABULARIES for m in ("n_tokens", *BANDED)),
]
_KINDS = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType(), pa.string(): T.StringType()}


class Meter:
    """Measures lists of texts."""

    def __init__(self, vocabularies: tuple[str, str] | None = None):
        piece, byte = vocabularies or default_vocabularies()
        self.piece, self.byte = piece_model(piece), byte_model(byte)
        self.shift = self.piece.get_piece_size()  # ids of the byte vocabulary begin there
        self.cells = WordCodes(self._encode_cells, max_words=MOST_REMEMBERED)
        self.words: dict[bytes, int] = {}
        self.word_of = np.zeros(0, dtype=np.int64)
        tokens = [self.byte.decode_single_token_bytes(i) for i in range(self.byte.n_vocab)]
        self.byte_length = np.array(list(map(len, tokens)))
        pieces = [self.piece.is_byte(i) or self.piece.is_unknown(i) for i in range(self.shift)]
        self.is_byte = np.array(pieces + [not _is_text(t) for t in tokens])

    def _encode_cells(self, cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both vocabularies for each cell as it stands in a text. A cell behind the mark 0 begins one."""
        texts = [c.decode() for c in cells]
        first = self.piece.encode([t[1:] if t[0] == "\0" else "x" + t for t in texts], num_threads=1)
        first = [ids if t[0] == "\0" else ids[1:] for t, ids in zip(texts, first)]
        n = np.fromiter(map(len, first), dtype=np.int64, count=len(cells))
        one = np.fromiter(chain.from_iterable(first), dtype=np.int64, count=int(n.sum()))
        two, m = self._byte_ids(cells)
        begin = np.cumsum(n + m) - n - m
        out = np.empty(len(one) + len(two), dtype=np.int32)
        out[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(len(one))] = one
        out[np.repeat(begin + n - np.cumsum(m) + m, m) + np.arange(len(two))] = two + self.shift
        return out, n + m

    def _byte_ids(self, cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte vocabulary, end to end, and how many each cell has.

        Cells that begin with white space and end with a word are encoded together, for no token crosses their ends; the
        tokens' lengths tell them apart.
        """
        joined = np.array([c[0] in b" \n" and c[-1] not in b" \n" for c in cells], dtype=bool)
        together = [c for c, j in zip(cells, joined.tolist()) if j]
        ids = np.array(self.byte.encode_ordinary(b"".join(together).decode()), dtype=np.int64)
        ends = np.cumsum(np.fromiter(map(len, together), dtype=np.int64, count=len(together)))
        alone = [self.byte.encode_ordinary(c.removeprefix(b"\0").decode()) for c, j in zip(cells, joined.tolist()) if not j]
        sizes = np.zeros(len(cells), dtype=np.int64)
        sizes[joined] = np.diff(np.searchsorted(np.cumsum(self.byte_length[ids]), ends, side="left") + 1, prepend=0)
        sizes[~joined] = list(map(len, alone))
        own = np.repeat(joined, sizes)
        out = np.empty(int(sizes.sum()), dtype=np.int64)
        out[own] = ids
        out[~own] = np.fromiter(chain.from_iterable(alone), dtype=np.int64)
        return out, sizes

    def _look_up(self, cells: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of cells: the number of each one's word (-1: none), their ids end to end, and how many each has."""
        codes = self.cells.codes(cells)
        if self.cells.rows < len(self.word_of):
            self.word_of = np.zeros(0, dtype=np.int64)  # the cache began anew; the words keep their numbers
        if self.cells.rows > len(self.word_of):
            fresh = [c.strip(b" \n\0") for c in islice(self.cells.index, len(self.word_of), None)]
            number = [self.words.setdefault(w, len(self.words)) if w else -1 for w in fresh]
            self.word_of = np.concatenate([self.word_of, np.array(number, dtype=np.int64)])
        return self.word_of[codes], *self.cells.ids(codes)

    def _read(self, raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, ids) of each text; numbers are the same for equal words of all these texts."""
        if len(self.words) > MOST_REMEMBERED:
            self.words = {}
            self.cells._clear()
            self.word_of = np.zeros(0, dtype=np.int64)
        cells, ends = [], []
        for raw in raws:
            own = _CELL.findall(raw)
            if own:
                own[0] = b"\0" + own[0]
            cells += own
            ends.append(len(cells))
        words, ids, sizes = self._look_up(cells)
        id_ends = np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
        return [(w[w >= 0], ids[a:b]) for lo, hi, a, b in zip([0, *ends], ends, [0, *id_ends], id_ends) for w in [words[lo:hi]]]

    def _read_long(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """As ``_read``, a part of a long text at a time."""
        cells, words, ids, held = _CELL.finditer(raw), [], [], 0
        first = True
        while part := list(islice((m[0] for m in cells), PIECE_BYTES // 8)):
            if first:
                part[0], first = b"\0" + part[0], False
            w, i, _ = self._look_up(part)
            words.append(w[w >= 0])
            ids.append(i)
        return np.concatenate(words), np.concatenate(ids)

    def _read_whole(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Of a text with odd white space."""
        text = raw.decode()
        number = [self.words.setdefault(w, len(self.words)) for w in raw.split()]
        ids = np.array(self.piece.encode(text) + [i + self.shift for i in self.byte.encode_ordinary(text)], dtype=np.int64)
        return np.array(number, dtype=np.int64), ids

    def __call__(self, texts: list[str]) -> dict[str, list]:
        raws = [t.encode() for t in texts]
        kind = [2 if (_ODD_ASCII if r.isascii() else _ODD).search(r) else 1 if len(r) > PIECE_BYTES else 0 for r in raws]
        plain = iter(self._read([r for r, k in zip(raws, kind) if k == 0]))
        out: dict[str, list] = {name: [] for name, _ in COLUMNS}
        for text, raw, k in zip(texts, raws, kind):
            words, ids = next(plain) if k == 0 else self._read_long(raw) if k == 1 else self._read_whole(raw)
            for name, value in self._row(text, np.frombuffer(raw, dtype=np.uint8), words, ids).items():
                out[name].append(value)
        return out

    def _row(self, text: str, data: np.ndarray, words: np.ndarray, ids: np.ndarray) -> dict:
        n, repeats = len(words), repeated_words(words)
        row = {
            "n_words": n, "word_chars": len(text) - int(_SPACE[data].sum()), "n_symbols": int(_SYMBOL[data].sum()), "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeats,
            "base_failed": n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n, "script": script_of(text),
        }
        second = ids >= self.shift
        for name, own in zip(VOCABULARIES, (ids[~second], ids[second])):
            tokens = len(own)
            row |= {f"n_tokens_{name}": tokens, f"chars_per_token_{name}": len(text) / tokens if tokens else 0.0, f"byte_share_{name}": float(self.is_byte[own].mean()) if tokens else 0.0, f"entropy_share_{name}": run_entropy(own)}
        return row


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def measure(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id and all measures of every row."""
    schema = pa.schema([("doc_id", pa.int64()), *COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(vocabularies)
        for piece, texts in slices(batches, step=STEP):
            yield rows_of(schema, doc_id=piece.column("doc_id"), **meter(texts))

    kinds = T.StructType([T.StructField(f.name, _KINDS[f.type]) for f in schema])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def bands(measures: DataFrame, reach: float = REACH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """script and, for every measure with bands, its least and most: one row a script, from all documents that pass the base rules."""
    every = [(f"{m}_{v}", least) for v in VOCABULARIES for m, least in BANDED.items()]
    quartiles = [F.percentile_approx(name, F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000)).alias(name) for name, _ in every]
    rows = measures.where("not base_failed").groupBy("script").agg(F.count(F.lit(1)).alias("n_docs"), *quartiles).where(F.col("n_docs") >= least_docs)
    edges: list[Column] = []
    for name, least in every:
        wide = F.greatest(F.col(name)[1] - F.col(name)[0], F.lit(least)) * reach
        edges += [(F.col(name)[0] - wide).alias(f"least_{name}"), (F.col(name)[1] + wide).alias(f"most_{name}")]
    return rows.select(F.col("script").alias("band_script"), *edges)


def judged(rows: DataFrame, measured: dict[str, str], limits: DataFrame, kept: str) -> DataFrame:
    """``rows`` with the verdict in column ``kept``; ``measured`` names the column of each measure.

    A script is a name from the Unicode standard: its bands are some two hundred rows at most, and are broadcast.
    """
    inside = F.lit(True)
    for v in VOCABULARIES:
        for m in BANDED:
            name = f"{m}_{v}"
            inside &= F.coalesce(F.col(measured[name]).between(F.col(f"b.least_{name}"), F.col(f"b.most_{name}")), F.lit(True))
    joined = rows.alias("r").join(F.broadcast(limits).alias("b"), F.col(measured["script"]) == F.col("b.band_script"), "left")
    return joined.select("r.*", (~F.col(measured["base_failed"]) & inside).alias(kept))


def with_verdicts(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, all measures and kept of every row."""
    measures = cut_lineage(measure(docs, vocabularies))
    return judged(measures, {name: f"r.{name}" for name, _ in COLUMNS}, bands(measures), "kept")


def keep_good(docs: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """The rows, with all their columns, that the rules keep. Texts are measured once: rows and measures are kept in the shared folder."""
    mine = {name: fresh_name(docs, f"__rule_{name}") for name, _ in COLUMNS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(vocabularies)
        for piece, texts in slices(batches, step=STEP):
            found = meter(texts)
            yield pa.RecordBatch.from_arrays([*piece.columns, *(pa.array(found[name], type=kind) for name, kind in COLUMNS)], names=[*piece.schema.names, *mine.values()])

    marked = cut_lineage(docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(mine[name], _KINDS[kind]) for name, kind in COLUMNS)])))
    limits = bands(marked.select(*(F.col(own).alias(name) for name, own in mine.items())))
    verdict = fresh_name(docs, "__rule_kept")
    return judged(marked, {name: f"r.{own}" for name, own in mine.items()}, limits, verdict).where(F.col(verdict)).drop(verdict, *mine.values())


def op4_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdicts(table(spark, sf_dir, "documents"))
