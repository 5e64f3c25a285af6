"""A trie of conversation prefixes, its subtree totals by parallel tree contraction.

1. Turns are ordered by range partitions, so a conversation that holds a third of all rows is cut among many tasks. Every
   task numbers the turns of its segments and folds their digests into polynomials modulo the prime 2^127 - 1;
   the few conversations that lie in several segments get the number and the polynomial before each from the segments alone.
   A prefix's polynomial is its node, and its parent's follows from the last turn.
2. ``shared_prefixes`` gives conversation c the first h turns of c - c % 5 in front of its own turns behind its first
   h (h = crc32 of c's digits modulo 9): polynomials are moved, no sequence is built.
3. ``subtree_totals`` contracts the tree in rounds of joins. Rake: leaves leave and add their totals to their parents.
   Compress: of every chain of nodes with one child those leave whose depth has the round's bit, unless the child leaves
   too; the child takes the place and carries what the node has. Rounds grow with the logarithm of the nodes, not with the
   depth. Then the nodes that were compressed away are opened again, last round first: each is its child's total and
   what it had itself.
4. The ids of the conversations that end at a node are joined to texts in range partitions and hashed in order.

Order of turns: a null role or text is empty, null turns come first, rows of equal turns are in the order of role, of the text's
beginning and of its digest, repeated rows are turns of their own. Rows without a conversation id belong to no
conversation and are left out. An empty table has no node. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import cut_lineage, rows_of, table

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix polynomial").digest()) % PRIME
BACK = pow(BASE, -1, PRIME)
ROOT = bytes(16)
#: Turns that a conversation may have of another at most, and the conversations that share theirs.
MOST_SHARED, FAMILY = 8, 5
#: Bytes of joined ids that one row holds.
PIECE = 1 << 16


def _int(value: bytes | None) -> int:
    return int.from_bytes(value) if value else 0


def _bytes(value: int) -> bytes:
    return (value % PRIME).to_bytes(16)


def turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, idx (from 1), prefix (polynomial of the turns up to it), digest, n_bytes of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("head"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "head", "digest", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "n_bytes")
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("k", pa.int64()), ("run", pa.binary()), ("digest", pa.binary()), ("n_bytes", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, k, run = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            ks, runs = [], []
            for c, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k, run = (k + 1, run) if c == conv else (1, 0)
                conv, run = c, (run * BASE + _int(d) + 1) % PRIME
                ks.append(k)
                runs.append(_bytes(run))
            yield rows_of(schema, conv_id=batch.column(0), part=[part] * len(ks), k=ks, run=runs, digest=batch.column(1), n_bytes=batch.column(2))

    cut = cut_lineage(dealt.mapInArrow(fold, "conv_id long, part int, k long, run binary, digest binary, n_bytes long"))
    # a partition has two conversations at most that go on in another one, so this table has two rows a partition
    sizes = cut.groupBy("conv_id", "part").agg(F.max("k").alias("size"))
    several = sizes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    ends = cut.join(sizes.join(several, "conv_id").select("conv_id", "part", F.col("size").alias("k"), F.lit(1).alias("last")), ["conv_id", "part", "k"])

    def before(segments: pd.DataFrame) -> pd.DataFrame:
        segments, number, run, out = segments.sort_values("part"), 0, 0, []
        for part, size, own in zip(segments.part, segments.k, segments.run):
            out.append((number, _bytes(run)))
            number, run = number + size, (run * pow(BASE, int(size), PRIME) + _int(own)) % PRIME
        return pd.DataFrame({"conv_id": segments.conv_id, "part": segments.part, "number": [n for n, _ in out], "past": [b for _, b in out]})

    past = ends.select("conv_id", "part", "k", "run").groupBy("conv_id").applyInPandas(before, "conv_id long, part int, number long, past binary")
    joined = cut.join(past, ["conv_id", "part"], "left")
    return moved(joined.select("conv_id", (F.col("k") + F.coalesce("number", F.lit(0))).alias("idx"), "run", "digest", "n_bytes", "k", F.col("past").alias("plus"), F.lit(None).cast("binary").alias("minus"))).select("conv_id", "idx", F.col("node").alias("prefix"), "digest", "n_bytes")


def moved(rows: DataFrame) -> DataFrame:
    """conv_id, idx, node, parent, digest, n_bytes: node is the polynomial ``run`` with ``plus`` in front of its last k turns in place of ``minus``."""
    schema = pa.schema([("conv_id", pa.int64()), ("idx", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("digest", pa.binary()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, parents = [], []
            for own, digest, k, plus, minus in zip(*(batch.column(c).to_pylist() for c in ("run", "digest", "k", "plus", "minus"))):
                shift = _int(plus) - _int(minus)
                value = (_int(own) + (shift * pow(BASE, k, PRIME) if shift else 0)) % PRIME
                nodes.append(_bytes(value))
                parents.append(_bytes((value - _int(digest) - 1) * BACK))
            yield rows_of(schema, node=nodes, parent=parents, **{c: batch.column(c) for c in ("conv_id", "idx", "digest", "n_bytes")})

    return rows.select("conv_id", "idx", "run", "digest", "n_bytes", "k", "plus", "minus").mapInArrow(run, "conv_id long, idx long, node binary, parent binary, digest binary, n_bytes long")


def shared_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, ends) of the rebuilt conversations: conv_id, depth, node, parent, n_bytes; and conv_id, node where each one ends.

    ``turns`` are those of ``numbered_turns``, materialised.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    none = F.lit(None).cast("binary")
    head = F.when(F.col("idx") <= MOST_SHARED, F.struct("idx", "prefix", "digest", "n_bytes"))
    convs = turns.groupBy("conv_id").agg(F.max("idx").alias("size"), F.array_sort(F.collect_list(head)).alias("head"))
    convs = cut_lineage(convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("head").alias("first"))
    known = convs.join(bases, "base", "left").withColumn("first", F.slice(F.coalesce("first", F.array().cast("array<struct<idx:bigint,prefix:binary,digest:binary,n_bytes:bigint>>")), 1, F.col("h").cast("int")))
    at = lambda column, n: F.get(column, n.cast("int") - 1)["prefix"]
    known = known.select("conv_id", "size", "h", "first", F.size("first").cast("long").alias("lead"), at(F.col("first"), F.size("first")).alias("plus"), at(F.col("head"), F.col("h")).alias("minus"))
    known = cut_lineage(known)
    shared = known.select("conv_id", F.explode("first").alias("f")).select("conv_id", "f.idx", F.col("f.prefix").alias("run"), "f.digest", "f.n_bytes", F.lit(0).cast("long").alias("k"), none.alias("plus"), none.alias("minus"))
    own = turns.where(F.col("idx") > h).join(known.select("conv_id", "h", "lead", "plus", "minus"), "conv_id")
    own = own.select("conv_id", (F.col("lead") + F.col("idx") - F.col("h")).alias("idx"), F.col("prefix").alias("run"), "digest", "n_bytes", (F.col("idx") - F.col("h")).alias("k"), "plus", "minus")
    rows = cut_lineage(moved(shared.unionByName(own)).select("conv_id", F.col("idx").alias("depth"), "node", "parent", "n_bytes"))
    length = known.select("conv_id", (F.col("lead") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("depth"))
    ends = rows.join(length, ["conv_id", "depth"]).select("conv_id", "node")
    return rows, ends.unionByName(length.where("depth = 0").select("conv_id", F.lit(ROOT).alias("node")))


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of the ids that end at each node, ascending, joined by commas.

    A hash has an order, so the last step of a node is one task's; it reads whole pieces of PIECE bytes, one at a time.
    """
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (n != node or size > PIECE):
                    for column, value in zip(out, (node, first, ",".join(held))):
                        column.append(value)
                    held, size = [], 0
                node, first = n, first if held else c
                held.append(str(c))
                size += len(held[-1]) + 1
            yield rows_of(schema, node=out[0], first=out[1], piece=out[2])
        if held:
            yield rows_of(schema, node=[node], first=[first], piece=[",".join(held)])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, node, state = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]), None, None
        for batch in batches:
            out: list[tuple] = []
            for n, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n == node:
                    state.update(b"," + piece.encode())
                else:
                    if state:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(piece.encode())
            yield rows_of(two, node=[n for n, _ in out], ends_sha256=[d for _, d in out])
        if state:
            yield rows_of(two, node=[node], ends_sha256=[state.hexdigest()])

    sorted_ids = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    cut = sorted_ids.mapInArrow(pieces, "node binary, first long, piece string")
    return cut.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """node, leaves, saved: sums over each node's subtree.

    ``nodes``: node, parent (null for the root), depth, leaves and saved (the node's own). Depths rise from parent to child.
    """
    n_children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    start = nodes.join(n_children, "node", "left").select("node", "parent", "depth", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"), "leaves", "saved")
    zero = F.lit(0).cast("long")
    start = start.withColumns({"up_leaves": zero, "up_saved": zero, "opened": F.lit(None).cast("binary"), "own_leaves": zero, "own_saved": zero})
    active = cut_lineage(start)
    bits = max(1, int(active.agg(F.max("depth")).first()[0] or 0).bit_length())
    raked, spliced, turn = [], [], 0
    while True:
        n, n_spliced = active.agg(F.count("parent"), F.count("opened")).first()
        if n_spliced:
            spliced.append(active.where("opened is not null").select("opened", "node", "own_leaves", "own_saved"))
        raked.append(active.where("deg = 0").select("node", "leaves", "saved"))
        if not n:
            break
        free = (F.col("deg") == 1) & F.col("parent").isNotNull() & (F.shiftright(F.col("depth"), turn % bits).bitwiseAND(F.lit(1)) == 1)
        marked = active.drop("opened", "own_leaves", "own_saved").withColumn("free", free)
        leaf = F.col("deg") == 0
        sums = {"gone": F.lit(1), "more_leaves": F.col("leaves") + F.col("up_leaves"), "more_saved": F.col("saved") + F.col("up_saved")}
        children = marked.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(*[F.sum(F.when(leaf, v).otherwise(0)).alias(k) for k, v in sums.items()], F.max("free").alias("child_free"))
        inner = marked.where("deg > 0").join(children, "node").select(
            "node", "parent", "depth", (F.col("deg") - F.col("gone")).alias("deg"), (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"),
            "up_leaves", "up_saved", (F.col("free") & (F.col("gone") == 0) & ~F.col("child_free")).alias("leaves_now"),
        )
        away = inner.where("leaves_now").select(
            F.col("node").alias("opened"), F.col("parent").alias("above"), F.col("leaves").alias("v_leaves"), F.col("saved").alias("v_saved"), (F.col("leaves") + F.col("up_leaves")).alias("v_up_leaves"), (F.col("saved") + F.col("up_saved")).alias("v_up_saved"),
        )
        met = inner.where("not leaves_now").join(away, F.col("parent") == F.col("opened"), "left")
        plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
        active = cut_lineage(met.select(
            "node", F.when(F.col("opened").isNotNull(), F.col("above")).otherwise(F.col("parent")).alias("parent"), "depth", "deg", "leaves", "saved",
            plus("up_leaves", "v_up_leaves").alias("up_leaves"), plus("up_saved", "v_up_saved").alias("up_saved"), "opened",
            (F.col("v_leaves") + F.col("up_leaves")).alias("own_leaves"), (F.col("v_saved") + F.col("up_saved")).alias("own_saved"),
        ))
        turn += 1
    totals = [cut_lineage(reduce(DataFrame.unionByName, raked))]
    for log in reversed(spliced):
        done = reduce(DataFrame.unionByName, totals)
        again = log.join(done, "node").select(F.col("opened").alias("node"), (F.col("leaves") + F.col("own_leaves")).alias("leaves"), (F.col("saved") + F.col("own_saved")).alias("saved"))
        totals.append(cut_lineage(again))
    return reduce(DataFrame.unionByName, totals)


def prefix_trie(rows: DataFrame, ends: DataFrame, n_convs: DataFrame) -> DataFrame:
    """The nodes with their totals: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows``, ``ends``: those of ``shared_prefixes``; ``n_convs``: one row, the number of conversations and the smallest id (n, least).
    """
    made = rows.groupBy("node", "parent", "depth", "n_bytes").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    zero = F.lit(0).cast("long")
    root = n_convs.where("n > 0").select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), zero.alias("depth"), zero.alias("n_bytes"), F.col("n").alias("n_convs"), F.col("least").alias("conv_id"))
    nodes = made.unionByName(root)
    children = made.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)))
    own = nodes.select("node", "parent", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    totals = subtree_totals(own).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    done = nodes.join(totals, "node").join(parents, "parent", "left").join(end_digests(ends), "node", "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut_lineage(numbered_turns(table(spark, sf_dir, "conversations")))
    rows, ends = shared_prefixes(turns)
    return prefix_trie(rows, ends, turns.where("idx = 1").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")))


OP11_SQL = """
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
bytes AS (SELECT DISTINCT c, [CAST(ascii(substr(CAST(c AS VARCHAR), CAST(k AS INTEGER), 1)) AS BIGINT) FOR k IN range(1, length(CAST(c AS VARCHAR)) + 1)] AS b FROM own),
convs AS (SELECT c, xor(list_reduce(list_prepend(4294967295, b), lambda a, x: list_reduce(list_prepend(xor(a, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda v, w: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295) % 9 AS h FROM bytes),
led AS (SELECT v.c, o.i, o.role, o.text FROM convs v JOIN own o ON o.c = v.c - v.c % 5 AND o.i <= v.h),
leads AS (SELECT c, count(*) AS n FROM led GROUP BY c),
built AS (SELECT * FROM led UNION ALL SELECT v.c, coalesce(l.n, 0) + o.i - v.h, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.i > v.h LEFT JOIN leads l ON l.c = v.c),
lists AS (SELECT c, list(sha256(length(role) || ':' || role || text) ORDER BY i) AS seq, list(strlen(text) ORDER BY i) AS sizes FROM built GROUP BY c),
every AS (SELECT v.c, coalesce(l.seq, []) AS seq, coalesce(l.sizes, []) AS sizes FROM convs v LEFT JOIN lists l ON l.c = v.c),
spread AS (SELECT c, unnest(range(0, len(seq) + 1)) AS d, seq, sizes FROM every),
prefixes AS (SELECT c, d, sha256(array_to_string(seq[1:d], ',')) AS k, CASE WHEN d > 0 THEN sha256(array_to_string(seq[1:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(seq) AS is_end FROM spread),
nodes AS (SELECT k, any_value(up) AS up, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256 FROM prefixes GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
ups AS (SELECT p.k, n.k AS below, coalesce(c.n, 0) = 0 AS leaf, (n.n_convs - 1) * n.size AS saved FROM nodes n JOIN prefixes p ON p.c = n.conv_id AND p.d <= n.depth LEFT JOIN kids c ON c.k = n.k),
sums AS (SELECT k, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM ups GROUP BY k)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.k = n.up LEFT JOIN kids c ON c.k = n.k JOIN sums s ON s.k = n.k
"""
