"""Fill-in-middle transformation with a sparse exception index.

A text is handled as its UTF-8 bytes. The index records only the multibyte characters: the byte at
which each begins and the excess bytes up to and with it. A byte cut turns into a code-point cut by one
binary search among them (``searchsorted``), a code-point cut into a byte cut by another; what lies
between two exceptions is ASCII, where both counts rise alike, so an ASCII text has an empty index and
its cuts are arithmetic alone.

Cuts fall behind units: tokens (white space and the word after it; white space at the end is a unit of its own) or
code points. Both cuts and the form are drawn from the SHA-256 of the seed and the document's id.
Outputs are, with the marks ``<P>``, ``<S>`` and ``<M>``:

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* plain: the text itself, also where the text is empty or has a mark, so that ``restored`` is always exact.

Null text is the empty text: form plain, n zero. A null id hashes as the empty string. Repeated rows stay
rows of their own with equal results, texts of any length are looked at in blocks beside their bytes, and an empty table gives an
empty table. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import STEP_BYTES, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of a hundred documents with units so many are transformed, and of a hundred of those so many get the form spm.
RATE, SPM = 50, 80
#: Bytes that one step looks at.
BLOCK = 1 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Exceptions:
    """Where the multibyte characters of a text begin, and the excess bytes of all of them up to and with each."""

    at: np.ndarray
    excess: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray) -> Exceptions:
        found, sizes = [], []
        for begin in range(0, len(data), BLOCK):
            part = data[begin : begin + BLOCK]
            lead = np.flatnonzero(part >= 0xC0)
            found.append((lead + begin).astype(np.int32))
            byte = part[lead]
            sizes.append((1 + (byte >= 0xE0) + (byte >= 0xF0)).astype(np.int8))
        if not found:
            return cls(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32))
        return cls(np.concatenate(found), np.concatenate(sizes).cumsum(dtype=np.int32))

    def points(self, byte: int) -> int:
        """The code points before a byte at which a character begins."""
        k = int(np.searchsorted(self.at, byte))
        return byte - (int(self.excess[k - 1]) if k else 0)

    def byte(self, points: int) -> int:
        """The byte at which the code point of this number begins."""
        starts = self.at - np.concatenate([np.zeros(1, dtype=np.int32), self.excess[:-1]]) if len(self.at) else self.at  # the exceptions' own code points
        k = int(np.searchsorted(starts, points))
        return points + (int(self.excess[k - 1]) if k else 0)


def _ends(data: np.ndarray, begin: int) -> np.ndarray:
    """Ends of the tokens in the block at ``begin``, the text's last end left out: bytes of words before white space."""
    space = _SPACE[data[begin : begin + BLOCK + 1]]
    return np.flatnonzero(~space[:-1] & space[1:]) + begin + 1


def count_tokens(data: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of tokens, and the token ends before each block."""
    if not len(data):
        return 0, np.zeros(1, dtype=np.int64)
    counts = [len(_ends(data, begin)) for begin in range(0, len(data), BLOCK)]
    before = np.concatenate([[0], np.cumsum(counts)])
    return int(before[-1]) + 1, before  # the last token ends with the text, be it a word or white space


def token_end(data: np.ndarray, before: np.ndarray, n: int, number: int) -> int:
    """The byte behind ``number`` of ``n`` tokens."""
    if number == 0:
        return 0
    if number == n:
        return len(data)
    block = int(np.searchsorted(before, number)) - 1
    return int(_ends(data, block * BLOCK)[number - 1 - int(before[block])])


def draws(key: str, seed: int = SEED) -> tuple[int, int, int, int]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{key}".encode()).digest()[:16])


def transformed(data: bytes, key: str, seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "token") -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix and middle in code points, output. ``unit``: token or character."""
    view = np.frombuffer(data, dtype=np.uint8)
    exceptions, before = None, None
    if unit == "token":
        n, before = count_tokens(view)
    else:
        exceptions = Exceptions.of(view)
        n = exceptions.points(len(view))
    h1, h2, h3, h4 = draws(key, seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not data or h3 % 100 >= rate or any(m in data for m in marks):
        return n, "plain", None, None, data
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    exceptions = exceptions or Exceptions.of(view)
    if unit == "token":
        a, b = (token_end(view, before, n, k) for k in (low, high))
        first, second = exceptions.points(a), exceptions.points(b)
    else:
        a, b, first, second = exceptions.byte(low), exceptions.byte(high), low, high
    prefix, middle, suffix = marks[0] + data[:a], marks[2] + data[a:b], marks[1] + data[b:]
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, first, second - first, b"".join((suffix, prefix, middle) if form == "spm" else (prefix, suffix, middle))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "token") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output of every row."""
    if unit not in ("token", "character"):
        raise ValueError("unit is token or character")
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, size = [], 0
            for i in range(batch.num_rows):
                key, data = ids[i].as_py(), (texts[i].as_buffer() if texts[i].is_valid else None)
                rows.append((key, *transformed(data.to_pybytes() if data else b"", "" if key is None else str(key), seed, rate, spm, unit)))
                size += len(rows[-1][-1])
                if size > STEP_BYTES or i == batch.num_rows - 1:
                    columns = list(zip(*rows))
                    whole = pa.array(columns[-1], type=pa.binary()).view(pa.string())
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, type=f.type) for c, f in zip(columns[:-1], schema)), whole], schema=schema)
                    rows, size = [], 0

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    three = lambda *order: F.concat(*[F.get(parts, F.lit(i)) for i in order])  # noqa: E731  the first part is empty: an output begins with a mark
    return F.when(form == "psm", three(1, 3, 2)).when(form == "spm", three(2, 3, 1)).otherwise(output)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
tokens AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
    [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS d FROM texts),
cuts AS (SELECT *, len(t) AS n, least(d[1] % (len(t) + 1), d[2] % (len(t) + 1)) AS a, greatest(d[1] % (len(t) + 1), d[2] % (len(t) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM tokens),
parts AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
