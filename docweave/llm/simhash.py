"""SimHash near-duplicates by Golay-code fuzzy hashing.

1. Each whole text gets a 64-bit SimHash of its word shingles (XXH64, seed 42).
2. Equal fingerprints are one node. A fingerprint is split into three segments (22, 21 and 21
   bits, each filled up to the 23 bits of a Golay word). Up to three differing bits leave at
   least one bit in each segment, or two segments with one error between them, so the pairs of
   segments are looked up with one error in both (first pair) or one in either (other pairs).
   Golay decoding turns that into equal keys: a node offers the indices of all code words near
   its segments. Both keys of a pair make one 24-bit join key.
3. Nodes that share a key are compared; those that differ in at most three bits are linked. Within a
   key a search removes each node once it is reached, so a group of copies gives one edge a
   node, never all its pairs.
4. The links' connected components are found by alternating stars over the linked nodes alone.

Null and wordless texts have fingerprint zero and are linked like any other. Texts of fewer
words than a shingle have one shingle, the whole sequence. Repeated rows stay repeated rows of
the result. Rows with a null id count as members but never name a component unless no member
has an id; then its component id is null. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm import golay
from docweave.llm.common import cut_lineage, fresh_name, rows_of, slices, table

SHINGLE, SEED, MOST_BITS = 3, 42, 3
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it."""
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield rows_of(schema, doc_id=piece.column("doc_id"), fp=fps)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def key_pairs(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, positions) in several parts: every join key of every fingerprint."""
    wide = fps.view(np.uint64)
    keys = [golay.fuzzy_keys((wide >> np.uint64(first)).astype(np.int64) & ((1 << bits) - 1)) for first, bits in SEGMENTS]
    for table_no, (a, b) in enumerate(((0, 1), (1, 2), (0, 2))):
        for i in range(6):
            for j in range(6):
                if table_no and i and j:
                    continue  # one error between both segments: one of them has its own code word
                at = np.flatnonzero((keys[a][:, i] >= 0) & (keys[b][:, j] >= 0))
                yield (table_no << 24) + (keys[a][at, i] << 12) + keys[b][at, j], at


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of differing bits (numpy counts those of a signed number's absolute value)."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def link_run(fps: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: (reached from, reached)."""
    left, edges = fps.copy(), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            pivot = front.pop()
            near = differing(left, pivot) <= most
            if near.any():
                edges += [(int(pivot), int(x)) for x in left[near]]
                front += list(left[near])
                left = left[~near]
    return edges


def fingerprint_links(nodes: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Edges (a, b) that connect every two fingerprints at most ``most`` (up to 3) bits apart, directly or through others.

    ``nodes`` has distinct values in ``fp``.
    """
    if most > MOST_BITS:
        raise ValueError("the segments tolerate three differing bits")
    pair = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for keys, at in key_pairs(fps):
                yield rows_of(pair, key=keys, fp=fps[at])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and fingerprint; the last run of a batch may go on in the next."""
        keys, fps = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def runs(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            two = two[differing(fps[two], fps[two + 1]) <= most]
            more = [e for k in np.flatnonzero(size > 2) for e in link_run(fps[bounds[k] : bounds[k + 1]], most)]
            found = np.concatenate([np.stack([fps[two], fps[two + 1]], 1), np.array(more, dtype=np.int64).reshape(-1, 2)])
            return rows_of(edge, a=found[:, 0], b=found[:, 1])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if len(keys) and (whole := int(np.searchsorted(keys, keys[-1]))):
                yield runs(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield runs(keys, fps)

    offered = nodes.select("fp").mapInArrow(offer, "key long, fp long")
    dealt = offered.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(compare, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that each end of an edge can reach.

    Alternating stars: every round joins each node's neighbours to the smallest of them, which at
    least halves the depth of the trees; rounds are cut by checkpoints and end when nothing changes.
    """
    links = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select("u", "v", "m")
        links = cut_lineage(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def components(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """fp, root, component_id for every distinct fingerprint: the smallest fingerprint and the smallest doc_id it can reach."""
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(fingerprint_links(nodes, most)).withColumnRenamed("node", "fp")
    joined = cut_lineage(nodes.join(linked, "fp", "left"))
    named = joined.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    alone = joined.where("root is null").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return alone.unionByName(joined.where("root is not null").join(named, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    fps = cut_lineage(fingerprints(docs, shingle))
    return fps.join(components(fps, most), "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (null last), one of equal rows."""
    mark_name = fresh_name(docs, "__simhash_fp")
    fps = cut_lineage(fingerprints(docs, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("k")
    best = fps.join(components(fps, most), "fp").groupBy("root").agg(first).select("k.doc_id", "k.fp")
    many = fps.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n"))
    pair = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.fp") == F.col(f"{b}.fp"))
    keepers = cut_lineage(best.alias("a").join(many.alias("b"), pair("a", "b")).select("a.doc_id", "a.fp", "b.n"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(fps)], names=[*piece.schema.names, mark_name])

    marked = docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(mark_name, T.LongType())]))
    mine = F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{mark_name}") == F.col("k.fp"))
    once = marked.alias("d").join(keepers.where("n = 1").alias("k"), mine, "left_semi")
    repeated = marked.alias("d").join(keepers.where("n > 1").alias("k"), mine, "left_semi").dropDuplicates(["doc_id", mark_name])
    return once.unionByName(repeated).drop(mark_name)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
