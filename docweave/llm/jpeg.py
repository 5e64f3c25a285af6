"""Baseline JPEG columns: entropy coding and decoding in numpy, DC thumbnails and their hashes.

Decoding runs in lock step over the restart segments of many images at once: each numpy
operation decodes one Huffman symbol of every segment. It takes any baseline stream (8 bits,
Huffman, one scan, any sampling factors, with or without restart markers).

Storing bytes losslessly: 64 bytes are the 64 quantised coefficients of one luminance block in
zigzag order, byte b as b - 128 below 128 and b - 127 from there, so none is zero and no run
lengths arise. The tables give a value of s bits a code of 9 - s bits: every block takes 72
bytes before stuffing. Each block is a restart segment. A comment holds the payload's length.

Null texts are empty texts, stored as 64 zero bytes. Streams that are null or no baseline JPEG
get nulls and an error text. Repeated rows give repeated results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import rows_of, slices, table

BLOCK = 64
#: Bytes of payload or of streams that one lock-step pass handles.
STEP = 1_500_000
COMMENT = b"payload bytes "


# ---------------------------------------------------------------- storing


@lru_cache(1)
def _words() -> np.ndarray:
    """The nine bits of each byte: the code of its size, then its amplitude."""
    value = np.arange(256) - np.where(np.arange(256) < 128, 128, 127)
    size = np.array([int(abs(v)).bit_length() for v in value])
    code = (1 << (9 - size)) - 2
    amplitude = np.where(value > 0, value, value + (1 << size) - 1)
    return (code << size | amplitude).astype(np.uint16)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(blocks_wide: int, blocks_high: int, payload: int) -> bytes:
    sizes = bytes(range(8, 0, -1))
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xFE, COMMENT + str(payload).encode()),
        _segment(0xDB, b"\0" + b"\x08" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * blocks_high, 8 * blocks_wide, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + b"\x01" * 8 + b"\0" * 8 + sizes),
        _segment(0xC4, b"\x10" + b"\x01" * 8 + b"\0" * 8 + sizes),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, struct.pack(">BBBBBB", 1, 1, 0, 0, 63, 0)),
    ])


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % BLOCK or (0 if data else BLOCK))


def store(payloads: list[bytes]) -> list[bytes]:
    """A JPEG of each payload (a positive multiple of 64 bytes)."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    wide = np.ceil(np.sqrt(counts)).astype(np.int64)
    high = -(-counts // np.maximum(wide, 1))
    filled = b"".join(p + b"\0" * (BLOCK * int(w * h) - len(p)) for p, w, h in zip(payloads, wide, high))
    w = _words()[np.frombuffer(filled, dtype=np.uint8)].reshape(-1, 8)
    packed = np.empty((len(w), 9), dtype=np.uint8)
    for i in range(9):
        high_bits = (w[:, i - 1] & (1 << i) - 1) << (8 - i) if i else 0
        packed[:, i] = high_bits | (w[:, i] >> (i + 1) if i < 8 else 0)
    blocks = packed.reshape(-1, 72)
    per = wide * high
    ends = np.cumsum(per)
    number = np.arange(len(blocks)) - np.repeat(ends - per, per)
    coded = np.empty((len(blocks), 74), dtype=np.uint8)
    coded[:, :72] = blocks
    coded[:, 72] = 0xFF
    coded[:, 73] = 0xD0 + number % 8
    times = np.ones(coded.shape, dtype=np.int64)
    stuffed = blocks == 0xFF
    times[:, :72] += stuffed
    total = np.cumsum(times.ravel())
    stream = np.repeat(coded.ravel(), times.ravel())
    stream[total[np.flatnonzero(times.ravel() == 2)] - 1] = 0
    stops = total[ends * 74 - 1]
    out, begin = [], 0
    for payload, a, b, stop in zip(payloads, wide.tolist(), high.tolist(), stops.tolist()):
        out.append(_header(a, b, len(payload)) + stream[begin : stop - 2].tobytes() + b"\xff\xd9")
        begin = stop
    return out


# ---------------------------------------------------------------- decoding


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    #: (component id, horizontal and vertical sampling, quantisation table)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    #: By class << 4 | number: the 16 counts and the values.
    huffman: dict[int, bytes] = field(default_factory=dict)
    #: (component, DC table, AC table) in the scan's order.
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    restart: int = 0
    comment: bytes = b""
    data: int = 0


def parse(stream: bytes) -> Frame:
    """The headers up to the scan's data; ValueError if it is no baseline JPEG."""
    if stream[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    f, at = Frame(), 2
    while True:
        while at + 1 < len(stream) and stream[at] == 0xFF and stream[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(stream) or stream[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker, size = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4])
        body = stream[at + 4 : at + 2 + size]
        at += 2 + size
        if at > len(stream):
            raise ValueError("cut off in its headers")
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                f.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if n == 128 else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                f.huffman[body[0]] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            bits, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not f.width or not f.height:
                raise ValueError("only frames of 8 bits and a known size")
            f.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            f.restart = int.from_bytes(body[:2])
        elif marker == 0xFE:
            f.comment = body
        elif marker == 0xDA:
            order = {part[0]: i for i, part in enumerate(f.parts)}
            f.scan = [(order[body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if len(f.scan) != len(f.parts):
                raise ValueError("only one scan with all components")
            f.data = at
            return f


@lru_cache(64)
def _lookup(spec: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each next 16 bits: the code's bits (0: none), run, size, and the value if it lies in the 16 bits."""
    bits, run, size, value = (np.zeros(1 << 16, dtype=np.int64) for _ in range(4))
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            low, high = code << (16 - length), (code + 1) << (16 - length)
            s = spec[at] & 15
            bits[low:high], run[low:high], size[low:high] = length, spec[at] >> 4, s
            if s and length + s <= 16:
                raw = np.arange(low, high) >> (16 - length - s) & (1 << s) - 1
                value[low:high] = np.where(raw >> (s - 1), raw, raw - (1 << s) + 1)
            code, at = code + 1, at + 1
        code <<= 1
    return bits, run, size, value


def _layout(f: Frame) -> tuple[list[tuple[int, int, int]], int, int]:
    """The blocks of one unit as (component, DC table, AC table), and the units across and down."""
    if len(f.parts) == 1:
        return [f.scan[0]], -(-f.width // 8), -(-f.height // 8)
    h, v = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    blocks = [x for x in f.scan for _ in range(f.parts[x[0]][1] * f.parts[x[0]][2])]
    return blocks, -(-f.width // (8 * h)), -(-f.height // (8 * v))


def decode(streams: list[bytes], frames: list[Frame]) -> list[np.ndarray]:
    """Of each stream: coefficients, shape (units, blocks of a unit, 64), DC values absolute, in zigzag order."""
    joined = np.frombuffer(b"".join(s[f.data :] + b"\xff\xd9" for s, f in zip(streams, frames)) + bytes(8), dtype=np.uint8)
    lengths = np.array([len(s) - f.data + 2 for s, f in zip(streams, frames)])
    begins = np.cumsum(lengths) - lengths
    mark = np.flatnonzero(joined[:-1] == 0xFF)
    after = joined[mark + 1]
    keep = np.ones(len(joined), dtype=bool)
    keep[mark[after == 0] + 1] = False
    real = (after != 0) & (after != 0xFF)
    keep[mark[real]] = keep[mark[real] + 1] = False
    place = np.cumsum(keep) - keep
    restart = mark[real & (after >= 0xD0) & (after <= 0xD7)]
    clean = np.concatenate([joined[keep], np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    window = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, f in enumerate(frames):
        groups[(tuple(sorted(f.huffman.items())), tuple(_layout(f)[0]), f.restart)].append(i)
    out: list[np.ndarray] = [np.zeros(0)] * len(frames)
    for (tables_, blocks, every), members in groups.items():
        starts, units, spans = [], [], []
        for i in members:
            total = _layout(frames[i])[1] * _layout(frames[i])[2]
            lo, hi = np.searchsorted(restart, [begins[i], begins[i] + lengths[i]])
            n = -(-total // every) if every else 1
            if hi - lo < n - 1:
                raise ValueError("cut off in its scan")
            own = np.concatenate([[begins[i]], restart[lo : lo + n - 1] + 2])
            spans.append((len(units), n, total))
            starts.append(place[own] * 8)
            units += [every] * (n - 1) + [total - every * (n - 1)] if every else [total]
        values = _lock_step(window, np.concatenate(starts), np.array(units), blocks, dict(tables_))
        for i, (first, n, total) in zip(members, spans):
            part = values[first : first + n].reshape(-1, len(blocks), 64)
            out[i] = part[:total]
    return out


def _lock_step(window: np.ndarray, position: np.ndarray, units: np.ndarray, blocks: tuple, tables_: dict[int, bytes]) -> np.ndarray:
    most = int(units.max())
    out = np.zeros((len(units), most, len(blocks), 64), dtype=np.int16)
    before = np.zeros((len(units), max(b[0] for b in blocks) + 1), dtype=np.int64)
    end = len(window) * 8 - 32
    position = position.copy()

    def symbol(rows: np.ndarray, spec: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bits, run, size, value = _lookup(spec)
        at = position[rows]
        peek = (window[np.minimum(at, end) >> 3] >> (16 - (at & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF
        n, s, v = bits[peek], size[peek], value[peek]
        if not n.all():
            raise ValueError("a code that no table has")
        if (long := n + s > 16).any():
            later = at[long] + n[long]
            raw = (window[np.minimum(later, end) >> 3] >> (16 - (later & 7)).astype(np.uint32)).astype(np.int64) & 0xFFFF
            raw >>= 16 - s[long]
            v[long] = np.where(raw >> (s[long] - 1), raw, raw - (1 << s[long]) + 1)
        position[rows] = at + n + s
        return run[peek], s, v

    for unit in range(most):
        live = np.flatnonzero(units > unit)
        for b, (part, dc, ac) in enumerate(blocks):
            before[live, part] += symbol(live, tables_[dc])[2]
            out[live, unit, b, 0] = before[live, part]
            rows, k = live, np.zeros(len(live), dtype=np.int64)
            while len(rows):
                run, s, v = symbol(rows, tables_[16 + ac])
                k += run + 1
                ends = (s == 0) & (run < 15)
                if (k[~ends] > 63).any():
                    raise ValueError("more than 64 coefficients in a block")
                if ends.any():
                    rows, k, v = rows[~ends], k[~ends], v[~ends]
                out[rows, unit, b, k] = v
                if (done := k >= 63).any():
                    rows, k = rows[~done], k[~done]
    return out


def luminance(f: Frame, values: np.ndarray) -> np.ndarray:
    """The thumbnail: one 8-bit pixel per block of the first component, from its DC value alone."""
    blocks, across, down = _layout(f)
    first = [i for i, b in enumerate(blocks) if b[0] == 0]
    h, v = (f.parts[0][1], f.parts[0][2]) if len(f.parts) > 1 else (1, 1)
    dc = values[:, first, 0].astype(np.int64).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    step = int(f.quant[f.parts[0][3]][0])
    return np.clip((dc * step + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray, side: int = 8) -> str:
    """A bit for each cell of a side x side grid: whether it is brighter than the mean of the cells."""
    rows, columns = np.arange(side) * thumb.shape[0] // side, np.arange(side) * thumb.shape[1] // side
    if min(thumb.shape) >= side:
        sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, 0), columns, 1)
        cells = sums / np.outer(np.diff(np.append(rows, thumb.shape[0])), np.diff(np.append(columns, thumb.shape[1])))
    else:
        cells = thumb[np.ix_(rows, columns)].astype(np.float64)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def stored_payload(f: Frame, values: np.ndarray) -> bytes:
    """The bytes that ``store`` put in."""
    if not f.comment.startswith(COMMENT):
        raise ValueError("no stored payload")
    flat = values.ravel()[: int(f.comment[len(COMMENT) :])]
    return (flat + np.where(flat < 0, 128, 127)).astype(np.uint8).tobytes()


# ---------------------------------------------------------------- Spark


def text_to_jpeg(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the JPEG that holds the text's UTF-8 bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, step=STEP):
            raw = [t.encode() for t in texts]
            yield rows_of(schema, doc_id=piece.column("doc_id"), n_bytes=list(map(len, raw)), media=store([padded(r) for r in raw]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decoded(streams: list[bytes | None]) -> Iterator[tuple[Frame | None, np.ndarray | None, str | None]]:
    """Of each stream: its frame and coefficients, or why it has none. One bad stream spoils no other."""
    frames: list[Frame | None] = []
    errors: list[str | None] = []
    for s in streams:
        try:
            frames.append(parse(s or b""))
            errors.append(None)
        except (ValueError, IndexError, KeyError, struct.error) as e:
            frames.append(None)
            errors.append(str(e) or "broken headers")
    good = [i for i, f in enumerate(frames) if f]
    try:
        values = dict(zip(good, decode([streams[i] for i in good], [frames[i] for i in good]) if good else []))
    except (ValueError, IndexError, KeyError):
        values = {}
        for i in good:
            try:
                values[i] = decode([streams[i]], [frames[i]])[0]
            except (ValueError, IndexError, KeyError) as e:
                errors[i] = str(e) or "broken scan"
    for i, f in enumerate(frames):
        yield (f, values[i], None) if i in values else (None, None, errors[i])


def image_features(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """key, width, height, components, thumbnail (a byte per pixel), thumb_width, thumb_hash, payload (if stored here), error."""
    kinds = [("width", pa.int64(), "long"), ("height", pa.int64(), "long"), ("components", pa.int64(), "long"), ("thumbnail", pa.binary(), "binary"), ("thumb_width", pa.int64(), "long"), ("thumb_hash", pa.string(), "string"), ("payload", pa.binary(), "binary"), ("error", pa.string(), "string")]
    schema = pa.schema([("key", pa.int64()), ("stream", pa.binary()), *[k[:2] for k in kinds]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, streams in _parts(batch):
                out: dict[str, list] = {name: [] for name, *_ in kinds}
                for f, values, error in decoded(streams):
                    row = dict.fromkeys(out) | {"error": error}
                    if f:
                        thumb = luminance(f, values)
                        row |= {"width": f.width, "height": f.height, "components": len(f.parts), "thumbnail": thumb.tobytes(), "thumb_width": thumb.shape[1], "thumb_hash": thumbnail_hash(thumb)}
                        row["payload"] = stored_payload(f, values) if f.comment.startswith(COMMENT) else None
                    for name, value in row.items():
                        out[name].append(value)
                yield rows_of(schema, key=piece.column("key"), stream=piece.column("stream"), **out)

    given = media.select(F.col(key).cast("long").alias("key"), F.col(column).alias("stream"))
    return given.mapInArrow(run, "key long, stream binary, " + ", ".join(f"{n} {t}" for n, _, t in kinds)).withColumnsRenamed({"key": key, "stream": column})


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    streams = batch.column("stream").to_pylist()
    begin = total = 0
    for i, s in enumerate(streams):
        size = len(s or b"")
        if i > begin and total + size > STEP:
            yield batch.slice(begin, i - begin), streams[begin:i]
            begin, total = i, 0
        total += size
    if begin < len(streams):
        yield batch.slice(begin), streams[begin:]


def digests(media: DataFrame) -> DataFrame:
    """The digest columns of what ``text_to_jpeg`` stored, from the bytes read back."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *[(n, pa.string() if "sha256" in n or n == "feature" else pa.int64()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, streams in _parts(batch):
                out: dict[str, list] = {n: [] for n in names}
                for s, (f, values, error) in zip(streams, decoded(streams)):
                    if error:
                        raise ValueError(error)
                    payload, thumb = stored_payload(f, values), luminance(f, values)
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(s), hashlib.sha256(s).hexdigest(), f"{f.width}x{f.height}:{thumbnail_hash(thumb)}")
                    for n, value in zip(names, row):
                        out[n].append(value)
                yield rows_of(schema, doc_id=piece.column("doc_id"), n_bytes=piece.column("n_bytes"), **out)

    given = media.select("doc_id", "n_bytes", F.col("media").alias("stream"))
    return given.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(text_to_jpeg(table(spark, sf_dir, "documents")))
